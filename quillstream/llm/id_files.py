"""Token-id files, compressed by an adaptive context-mixing range coder.

Documents are encoded, ended by one id and written in ascending id order as
shards of rows; a row holds whole documents and their ids as a record of many
blocks of ``BLOCK`` ids. Each block is coded from a fresh model and has a CRC-32
of its ids, so a damaged block shows and harms no other.

An id is coded as: was it the id that last followed the last two ids (order 2)?
else, the one that last followed the last id (order 1)? else its four hex digits
by adaptive counts of the digits before (order 0). The probability of each of
the first two answers is mixed from three adaptive predictions (of the entry's
own record, of the two orders' agreement, and of the block so far) whose
weights follow their success. All arithmetic is in whole numbers, so files read
back alike anywhere. Tasks write and read records in the JVM (``IdCoder.java``), a block at
a time. ``compress_ids`` and ``expand_ids`` do so without Spark and with the same bytes:
the blocks of a record advance together, one id of each at a time, as numpy lanes.
Writing and reading run the same model code.

A byte-level vocabulary whose merges are in the order of its ids, and each of whose ids
is what its own bytes encode to, gives the same ids by ranks, which tiktoken does several
times as fast; others, and texts that its patterns can't hold (long runs of blanks), go
through the tokenizers library.

Defined cases: a null text is empty, which is the end id alone; rows without an
id come first; rows that repeat an id are ordered by text hash; an empty table
gives empty files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import work_path
from .tokens import worker_cache

BLOCK = 2048
LANES = 1024
SLOTS = 2048
ROW_IDS = 512 * BLOCK
END_ID = 2
MAGIC = b"QIDS"
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_16, _48 = np.uint64(16), np.uint64(48)

#: how a byte-level vocabulary cuts texts before it merges
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_compiled: dict = {}

FILES = "shard int, seq int, doc_ids array<long>, lengths array<int>, record binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class RangeCoder:
    """Carry-less range coders side by side, one for each lane; writes when
    made without input, else reads it."""

    def __init__(self, lanes: int, size: int = 0, data: np.ndarray | None = None, first: np.ndarray | None = None):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.reading = data is not None
        self.at = np.zeros(lanes, np.int64)
        if self.reading:
            self.data, self.at = np.concatenate([data, np.zeros(8, np.uint16)]), first.astype(np.int64)
            self.code = np.zeros(lanes, np.uint64)
            for _ in range(4):
                self.code = (self.code << _16) | self.data[self.at]
                self.at += 1
        else:
            self.out = np.zeros((lanes, size), np.uint16)

    def target(self, lanes, total):
        """Reading: where in ``total`` the coded value lies."""
        return np.minimum((self.code[lanes] - self.low[lanes]) // (self.range[lanes] // total), total - np.uint64(1))

    def put(self, lanes, start, size, total):
        part = self.range[lanes] // total
        low, rng = self.low[lanes] + part * start, part * size
        self.low[lanes], self.range[lanes] = low, rng
        while True:
            settled = (low ^ (low + rng)) < _TOP
            short = ~settled & (rng < _BOTTOM)
            rng = np.where(short, (~low + np.uint64(1)) & (_BOTTOM - np.uint64(1)), rng)
            go = np.flatnonzero(settled | short)
            if not len(go):
                return
            lanes, low, rng = lanes[go], low[go], rng[go]
            if self.reading:
                self.code[lanes] = (self.code[lanes] << _16) | self.data[np.minimum(self.at[lanes], len(self.data) - 1)]
            else:
                self.out[lanes, self.at[lanes]] = (low >> _48).astype(np.uint16)
            self.at[lanes] += 1
            low, rng = low << _16, rng << _16
            self.low[lanes], self.range[lanes] = low, rng

    def bit(self, lanes, p, value):
        """A yes or no of probability ``p`` / 65536; the value, read or given."""
        total, p = np.uint64(1 << 16), p.astype(np.uint64)
        if self.reading:
            value = self.target(lanes, total) < p
        self.put(lanes, np.where(value, np.uint64(0), p), np.where(value, p, total - p), total)
        return value

    def symbol(self, lanes, counts, value):
        """One of 16 by its counts."""
        cum = np.cumsum(counts, axis=1, dtype=np.uint64)
        total = cum[:, -1]
        if self.reading:
            value = (cum <= self.target(lanes, total)[:, None]).sum(1)
        i = np.arange(len(lanes))
        size = counts[i, value].astype(np.uint64)
        self.put(lanes, cum[i, value] - size, size, total)
        return value

    def finish(self) -> list[np.ndarray]:
        lanes = np.arange(len(self.low))
        for _ in range(4):
            self.out[lanes, self.at] = (self.low >> _48).astype(np.uint16)
            self.low <<= _16
            self.at += 1
        return [self.out[i, :n] for i, n in enumerate(self.at)]


class _Order:
    """Last followers of hashed contexts, and how often they were right."""

    def __init__(self, lanes: int):
        self.mark = np.full((lanes, SLOTS), -1, np.int64)
        self.id = np.zeros((lanes, SLOTS), np.int32)
        self.trust = np.zeros((lanes, SLOTS), np.int8)

    def find(self, lanes, context):
        slot = ((context * 0x9E3779B1) >> 11) % SLOTS
        return slot, np.where(self.mark[lanes, slot] == context, self.id[lanes, slot], -1), self.trust[lanes, slot].astype(np.int64)

    def learn(self, lanes, context, slot, guess, trust, ids):
        right = guess == ids
        self.mark[lanes, slot] = context
        self.id[lanes, slot] = ids
        self.trust[lanes, slot] = np.where(right, np.minimum(trust + 1, 7), 0)


class _Mixer:
    """Probability of one kind of answer, mixed from three predictions."""

    def __init__(self, lanes: int):
        self.p = [np.full((lanes, n), 1 << 15, np.int64) for n in (8, 3, 1)]
        self.weight = [np.full(lanes, 32, np.int64) for _ in self.p]

    def code(self, coder, lanes, contexts, value):
        ps = [t[lanes, c] for t, c in zip(self.p, contexts)]
        ws = [w[lanes] for w in self.weight]
        mixed = np.clip(sum(p * w for p, w in zip(ps, ws)) // sum(ws), 64, 65535 - 64)
        value = coder.bit(lanes, mixed, value)
        goal = np.where(value, 65535, 0)
        miss = np.abs(goal - mixed)
        for t, c, p, w, weight in zip(self.p, contexts, ps, ws, self.weight):
            weight[lanes] = np.clip(w + np.where(np.abs(goal - p) <= miss, 1, -1), 1, 255)
            t[lanes, c] = p + ((goal - p) >> 4)
        return value


def _model(coder: RangeCoder, sizes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Runs the model over blocks (rows of ``ids``; sizes descending), coding
    or reading them; the ids."""
    n = len(sizes)
    if ids is None:
        ids = np.zeros((n, int(sizes.max(initial=0))), np.int32)
    two, one = _Order(n), _Order(n)
    ask_two, ask_one = _Mixer(n), _Mixer(n)
    digits = [np.ones((n, 1, 16), np.uint16), np.ones((n, 16, 16), np.uint16), np.ones((n, 256, 16), np.uint16), np.ones((n, 1024, 16), np.uint16)]
    a = np.zeros(n, np.int64)
    b = np.zeros(n, np.int64)
    reading = coder.reading
    for t in range(ids.shape[1]):
        k = int(np.searchsorted(-sizes, -t, "left"))        # blocks longer than t come first
        lanes = np.arange(k)
        a, b = a[:k], b[:k]
        got = ids[:k, t].astype(np.int64)
        c2, c1 = (a << 20) | b, b
        s2, g2, t2 = two.find(lanes, c2)
        s1, g1, t1 = one.find(lanes, c1)
        open_ = np.ones(k, bool)
        at = np.flatnonzero(g2 >= 0)
        if len(at):
            agree = np.where(g1[at] < 0, 0, np.where(g1[at] == g2[at], 1, 2))
            yes = ask_two.code(coder, at, (t2[at], agree, 0), got[at] == g2[at])
            if reading:
                got[at[yes]] = g2[at[yes]]
            open_[at[yes]] = False
        at = np.flatnonzero(open_ & (g1 >= 0) & (g1 != g2))
        if len(at):
            yes = ask_one.code(coder, at, (t1[at], (g2[at] >= 0).astype(np.int64), 0), got[at] == g1[at])
            if reading:
                got[at[yes]] = g1[at[yes]]
            open_[at[yes]] = False
        at = np.flatnonzero(open_)
        if len(at):
            whole = np.zeros(len(at), np.int64)
            for level, table in enumerate(digits):
                ctx = whole if level < 3 else (whole * 0x9E3779B1 >> 7) % 1024
                counts = table[at, ctx]
                d = coder.symbol(at, counts, (got[at] >> (12 - 4 * level)) & 15)
                counts[np.arange(len(at)), d] += 24
                big = counts.sum(1) > 4000
                counts[big] = (counts[big] >> 1) | 1
                table[at, ctx] = counts
                whole = (whole << 4) | d
            if reading:
                got[at] = whole
        if reading:
            ids[:k, t] = got
        two.learn(lanes, c2, s2, g2, t2, got)
        one.learn(lanes, c1, s1, g1, t1, got)
        a, b = b, got
    return ids


def compress_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A record: header, (ids, 16-bit words, CRC-32) of each block, the words."""
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("ids are of 16 bits")
    count = -(-n // block)
    sizes = np.full(count, block, np.int64)
    if count:
        sizes[-1] = n - block * (count - 1)
    table = np.zeros((count, block if count > 1 else n), np.int32)
    table.reshape(-1)[:n] = ids
    body = []
    for lo in range(0, count, LANES):
        part = slice(lo, min(lo + LANES, count))
        coder = RangeCoder(len(sizes[part]), 3 * table.shape[1] + 16)
        _model(coder, sizes[part], table[part])
        body += coder.finish()
    head = [struct.pack("<4sII", MAGIC, block, count)]
    head += [struct.pack("<III", s, len(w), zlib.crc32(table[i, :s].astype("<u4").tobytes())) for i, (s, w) in enumerate(zip(sizes, body))]
    return b"".join(head + [w.astype("<u2").tobytes() for w in body])


def expand_ids(record: bytes) -> np.ndarray:
    """The ids of a record; raises ValueError if a block does not check."""
    magic, block, count = struct.unpack_from("<4sII", record)
    if magic != MAGIC:
        raise ValueError("not a record of ids")
    head = np.frombuffer(record, "<u4", 3 * count, 12).reshape(count, 3).astype(np.int64)
    data = np.frombuffer(record, "<u2", -1, 12 + 12 * count).astype(np.uint16)
    first = np.cumsum(head[:, 1]) - head[:, 1]
    out = []
    for lo in range(0, count, LANES):
        part = slice(lo, min(lo + LANES, count))
        ids = _model(RangeCoder(len(first[part]), data=data, first=first[part]), head[part, 0], None)
        for row, (size, _, crc) in zip(ids, head[part]):
            if zlib.crc32(row[:size].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum differs")
            out.append(row[:size])
    return np.concatenate(out) if out else np.empty(0, np.int32)


def by_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks that give the ids of a tokenizers file, if there are any: for a plain byte-level
    vocabulary with merges in the order of its ids. Merging by rank may join two ids that no merge
    names; before it does, the bytes of their union are cut in another way than into that id's
    own two parts, so it does not happen where every id's bytes encode to the id itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = (model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
             and len(added) <= 1 and not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not plain:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]       # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in added}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if (any(c not in byte for w in vocab for c in w) or any(x not in vocab for x in byte)
            or [vocab.get(x + y) for x, y in pairs] != list(range(256, 256 + len(pairs))) or len(vocab) != 256 + len(pairs)):
        return None
    rank = {(vocab[x], vocab[y]): vocab[x + y] for x, y in pairs}
    for w, i in vocab.items():
        ids = [vocab[c] for c in w]
        while len(ids) > 1:
            best, at = min((rank.get(p, len(vocab)), k) for k, p in enumerate(zip(ids, ids[1:])))
            if best == len(vocab):
                break
            ids[at:at + 2] = [best]
        if ids != [i]:
            return None
    return {bytes(byte[c] for c in w): i for w, i in vocab.items()}


def _encoder(path: str, ranks: dict[bytes, int] | None):
    """Function from texts to the arrays of their ids."""
    cache, key = worker_cache(), (path, ranks is None)
    if key not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        if ranks is None:
            cache[key] = lambda texts: [np.array(e.ids, np.uint32) for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import tiktoken

            fast = tiktoken.Encoding("ids", pat_str=BYTE_LEVEL, mergeable_ranks=ranks,
                                     special_tokens={t.content: i for i, t in tk.get_added_tokens_decoder().items()})

            def ids(text):
                try:
                    return fast.encode_to_numpy(text, allowed_special="all")
                except ValueError:                          # the pattern's stack ran out
                    return np.array(tk.encode(text, add_special_tokens=False).ids, np.uint32)

            cache[key] = lambda texts: [ids(t) for t in texts]
    return cache[key]


def _coder(spark):
    """Column functions (compress, expand) of ``IdCoder.java``. Its classes, compiled once for an
    application by the compiler Spark brings along, go to the executors as a jar."""
    app = spark.sparkContext.applicationId
    if app not in _compiled:
        compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
        with open(os.path.join(os.path.dirname(__file__), "IdCoder.java"), encoding="utf-8") as f:
            compiler.cook(f.read())
        classes = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="qs-coder-"), f"id-coder-{app}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes:
                z.writestr(f"{name}.class", bytes(classes[name]))
        spark.sparkContext._jsc.addJar(jar)
        _compiled[app] = compiler.getClassLoader()
    session = spark._jsparkSession
    for name, kind in (("qs_compress_ids", "IdCoder$Compress"), ("qs_expand_ids", "IdCoder$Expand")):
        session.udf().register(name, _compiled[app].loadClass(kind).newInstance(), session.parseDataType('"binary"'))
    return (lambda c: F.call_function("qs_compress_ids", c)), (lambda c: F.call_function("qs_expand_ids", c))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_ids: int = ROW_IDS) -> None:
    """Writes the documents' ids as files below ``path``, in ascending id order."""
    ranks = docs.sparkSession.sparkContext.broadcast(by_ranks(tokenizer))

    def encode(batches):
        ids_of = _encoder(tokenizer, ranks.value)
        shard, seq, held, held_ids, total, end = TaskContext.get().partitionId(), 0, [], [], 0, np.array([end_id], np.uint32)

        def row():
            ids = np.concatenate([x for doc in held for x in (doc, end)])
            if ids.max() > 0xFFFF:
                raise ValueError("ids are of 16 bits")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([held_ids], pa.list_(pa.int64())),
                 pa.array([[len(x) + 1 for x in held]], pa.list_(pa.int32())), pa.array([ids.astype("<u2").tobytes()], pa.binary())],
                names=["shard", "seq", "doc_ids", "lengths", "record"])

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), ids_of(texts)):
                    held.append(ids)
                    held_ids.append(doc)
                    total += len(ids) + 1
                    if total >= row_ids:
                        yield row()
                        seq, held, held_ids, total = seq + 1, [], [], 0
        if held:
            yield row()

    compress, _ = _coder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ordered.mapInArrow(encode, FILES).withColumn("record", compress("record")).write.parquet(path)


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(shard, seq, place, doc_id, n_tokens, ids_crc32, ids) of every document; the last
    only if it is wanted, as Spark doesn't see that a column of ``mapInArrow`` is dropped."""
    names = ["shard", "seq", "place", "doc_id", "n_tokens", "ids_crc32", "ids"][:6 + with_ids]

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(r["record"], "<u2").astype("<u4")
                cut = np.concatenate([[0], np.cumsum(r["lengths"])]).astype(int)
                n = len(r["lengths"])
                columns = [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["seq"]] * n, pa.int32()), pa.array(cut[:-1], pa.int64()),
                           pa.array(r["doc_ids"], pa.int64()), pa.array(r["lengths"], pa.int64()),
                           pa.array([zlib.crc32(ids[x:y]) for x, y in zip(cut, cut[1:])], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    _, expand = _coder(spark)
    return spark.read.schema(FILES).parquet(path).withColumn("record", expand("record")).mapInArrow(
        decode, "shard int, seq int, place long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """RESULT of every row, from files written and read back."""
    spark = docs.sparkSession
    path = work_path(spark, "ids")
    write_ids(docs, path, tokenizer, end_id)
    rows = spark.read.schema(FILES).parquet(path).select(
        "shard", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    shards = rows.groupBy("shard").agg(F.sum("n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = (rows.withColumn("_in", inside).join(shards.withColumn("_before", before), "shard")
              .select("shard", "seq", (F.col("_before") + F.col("_in")).alias("_first")))
    return (read_ids(spark, path, with_ids=False).join(firsts, ["shard", "seq"])
            .select("doc_id", (F.col("_first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"))
