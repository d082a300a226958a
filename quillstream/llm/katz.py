"""Katz backoff language model, learned, stored and scored in the cluster.

With h the words before w, and h' the same without the farthest one,
P(w | h) = d_r * c(h,w) / c(h) for an n-gram seen r times in training, with
Good-Turing discounts d_r of its order for r up to ``GT_MAX`` (1 above), and else
alpha(h) * P(w | h'): a context without a discounted n-gram gives up half a count.
alpha(h) gives what discounting left to the words not seen after h, divided by
their share of P(. | h'), so that every context's probabilities add up to 1; it is 1
for a context not seen. Order 1 is the base, (c(w) + 1) / (N + V + 1), the one class of
unknown words included. The order is a parameter (3: up to two words before). A
text's tokens are its lower-cased words and one end; before the first word stand
start marks.

Counts are never held in one place. Texts are taken in blocks of about
``BLOCK_TOKENS`` tokens.

1. Each block sends its distinct words, by hash to buckets; a bucket numbers
   and counts its words over all blocks and answers the blocks (table
   ``vocabulary``, order 1). The numbered blocks are written (``tokens``).
2. Each block sends its distinct training n-grams with their counts to the bucket
   of the word before last, that is of the nearest context word, so that a bucket
   holds every order of its contexts. A word that would fill a bucket is split by the
   n-gram's last word. Buckets add up the counts (table ``counts``, by context
   hash; counts of lower orders are its sums) and their counts of counts.
3. From the lowest order up, buckets compute totals and backoff weights of their
   contexts (tables by context hash, for each order). The parts of a split word
   send their contexts' sums to buckets of the whole context, which add them and
   return the weights.
4. Each block sends its n-grams with their text to the same buckets, where they
   meet the tables and are evaluated recursively; sums of logarithms return to the
   block.

Defined cases: a null text is empty, which is the end alone; null ids train;
repeated rows are texts of their own; without training tokens N and V are 0 and
every score is 0 = log10(1/1); an empty table gives no rows; where the counts of
counts allow no Good-Turing discount up to 5, the largest lower bound that
does is used, and else one half is taken off each count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, mix, row_blocks, stored, text_bytes, words
from .language import held_out

GT_MAX = 5
ORDER = 3
BLOCK_TOKENS = 800_000
BUCKET_TOKENS = 400_000
VOCAB_BUCKET = 500_000
END = np.uint64(0x1B873593CC9E2D51)
START = np.uint64((1 << 40) - 1)         # a context number that no word has

SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    a = np.ascontiguousarray(a.astype(np.uint64))
    planes = a.view(np.uint8).reshape(-1, 8).T if len(a) else np.empty((8, 0), np.uint8)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    raw = np.ascontiguousarray(planes[:used]).tobytes()
    return len(a).to_bytes(8, "little") + bytes([used]) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    n, used = int.from_bytes(b[:8], "little"), b[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = pa.decompress(bytes(b[9:]), decompressed_size=n * used, codec="zstd", asbytes=True)
        out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.view(np.uint64).reshape(-1)


def _blocks(batches, buckets: int):
    """(number, vocabulary in bucket order, bucket cuts, words as places in it,
    first token of each text, ids, held out)."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list = []
    tokens = 0

    def flush():
        h = np.concatenate([x[0] for x in held])
        vocab, at = np.unique(h, return_inverse=True)
        bucket = (mix(vocab) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(vocab), np.int64)
        place[order] = np.arange(len(vocab))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        first = np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in held]))])
        return ((part << 24) + seq, vocab[order], cuts, place[at], first,
                [i for x in held for i in x[2]], np.concatenate([x[3] for x in held]))

    for b in batches:
        data, offs = text_bytes(b.column("text"))
        ids, out = b.column("doc_id").to_pylist(), b.column("held_out").to_numpy(zero_copy_only=False)
        for lo, hi in row_blocks(offs):
            w = words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], NOT_SPACE)
            held.append((np.insert(w.hash, w.first[1:], END), np.diff(w.first) + 1, ids[lo:hi], out[lo:hi]))
            tokens += len(held[-1][0])
            if tokens >= BLOCK_TOKENS:
                yield flush()
                held, tokens, seq = [], 0, seq + 1
    if held:
        yield flush()


def _vocabulary(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, numbers, counts): each block's words, as the buckets
    number them, and their training counts over all blocks; bucket totals have
    block -1 and hold (N, V, texts trained on, all tokens)."""
    def send(batches):
        for number, vocab, cuts, at, first, _, out in _blocks(batches, buckets):
            train = np.repeat(~out, np.diff(first))
            n = np.bincount(at[train], minlength=len(vocab))
            filled = np.flatnonzero(np.diff(cuts))
            for k in filled:
                part = slice(cuts[k], cuts[k + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([k], pa.int32()), pa.array([vocab[part].tobytes()], pa.binary()),
                     pa.array([pack(n[part])], pa.binary()), pa.array([[int((~out).sum()), len(at)]] if k == filled[0] else [[0, 0]], pa.list_(pa.int64()))],
                    names=["block", "bucket", "words", "counts", "size"])

    def count(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        blocks = t.column("block").to_numpy()[order]
        h = [np.frombuffer(t.column("words")[int(i)].as_py(), np.uint64) for i in order]
        c = [unpack(t.column("counts")[int(i)].as_py()) for i in order]
        size = np.array(t.column("size").to_pylist()).sum(0)
        bucket = t.column("bucket")[0].as_py()
        vocab, at = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(at, np.concatenate(c).astype(np.float64), len(vocab)).astype(np.int64)
        cut = np.cumsum([0] + [len(x) for x in h])
        stats = np.array([total.sum(), (total > 0).sum(), *size])
        return pa.Table.from_arrays(
            [pa.array([*blocks, -1], pa.int64()), pa.array([bucket] * (len(blocks) + 1), pa.int32()),
             pa.array([pack(at[a:b] * buckets + bucket) for a, b in zip(cut, cut[1:])] + [pack(stats)], pa.binary()),
             pa.array([pack(total[at[a:b]]) for a, b in zip(cut, cut[1:])] + [b""], pa.binary())],
            names=["block", "bucket", "numbers", "counts"])

    sent = rows.mapInArrow(send, "block long, bucket int, words binary, counts binary, size array<long>")
    return sent.groupBy("bucket").applyInArrow(count, "block long, bucket int, numbers binary, counts binary")


def _salts(count: np.ndarray, tokens: int, buckets: int) -> np.ndarray:
    """Parts of a context: 1, or more for a word with over a quarter of a bucket."""
    return np.maximum(1, -(-count.astype(np.int64) * 4 * buckets // max(1, tokens)))


def discounts(n_r: dict[int, int]) -> np.ndarray:
    """d_1 .. d_GT_MAX from the numbers of pairs seen r times (Katz's form)."""
    for k in range(GT_MAX, 0, -1):
        n = [n_r.get(r, 0) for r in range(k + 2)]
        if all(n[1:]):
            tail = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array(d + [1.0] * (GT_MAX - k))
    return np.array([(r - 0.5) / r for r in range(1, GT_MAX + 1)])


def _tokens(rows: DataFrame, vocabulary: DataFrame, vocab_buckets: int) -> DataFrame:
    """(block, numbers, counts, sizes, ids, out): every block's tokens as word
    numbers with their training counts."""
    def stream(batches):
        for number, vocab, cuts, at, first, ids, out in _blocks(batches, vocab_buckets):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([pack(at)], pa.binary()), pa.array([pack(np.diff(first))], pa.binary()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([pack(out)], pa.binary())], names=["block", "tokens", "sizes", "ids", "out"])

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        at = unpack(left.column("tokens")[0].as_py()).astype(np.int64)
        order = np.argsort(right.column("bucket").to_numpy())
        numbers, counts = (np.concatenate([unpack(right.column(c)[int(i)].as_py()) for i in order])[at] for c in ("numbers", "counts"))
        return pa.Table.from_arrays(
            [left.column("block"), pa.array([pack(numbers)], pa.binary()), pa.array([pack(counts)], pa.binary()),
             left.column("sizes"), left.column("ids"), left.column("out")], names=["block", "numbers", "counts", "sizes", "ids", "out"])

    streams = rows.mapInArrow(stream, "block long, tokens binary, sizes binary, ids array<long>, out binary")
    return (streams.groupBy("block").cogroup(vocabulary.filter("block >= 0").groupBy("block"))
            .applyInArrow(number, "block long, numbers binary, counts binary, sizes binary, ids array<long>, out binary"))


def _order(keys) -> np.ndarray:
    """np.lexsort of whole numbers up to START (the last key first, equal rows in their order), from sorts
    of single words, which are several times as fast as stable ones: keys are put side by
    side as far as 64 bits go, and what is there becomes its rank when the next doesn't fit."""
    n = len(keys[0])
    if n == 0:
        return np.empty(0, np.int64)

    def ranks(x):
        o = np.argsort(x)
        at = np.empty(n, np.uint64)
        at[o] = np.cumsum(_changes([x[o]])) - 1
        return at

    word, bits = np.zeros(n, np.uint64), 0
    for key in [*keys[::-1], np.arange(n)]:
        key = key.astype(np.uint64)
        start = key == START
        if start.any():                 # behind the others, in as few bits
            key[start] = key[~start].max(initial=0) + np.uint64(1)
        width = int(key.max()).bit_length()
        if bits + width > 64:
            word = ranks(word)
            bits = int(word.max()).bit_length()
        if bits + width > 64:
            key = ranks(key)
            width = int(key.max()).bit_length()
        word, bits = word << np.uint64(width) | key if bits else key, bits + width
    return np.argsort(word)


def _histories(number: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The words before each token, nearest first; START before a text."""
    place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [np.where(place >= k, np.roll(number, k), START) for k in range(1, order)]


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before; rows are sorted."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _grams(blocks: DataFrame, order: int, buckets: int, n: int, v: int, texts: int, train: bool) -> DataFrame:
    """(bucket, block, body, ids): the n-grams a block sends to a bucket, with
    counts (``train``) or else, for all texts, with the text of each; then
    bucket -1 - block holds the block's texts and their base scores."""
    def send(batches):
        for r in (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
            number, sizes = unpack(r["numbers"]), unpack(r["sizes"]).astype(np.int64)
            count, out = unpack(r["counts"]).astype(np.int64), unpack(r["out"])
            text = np.repeat(np.arange(len(sizes)), sizes)
            before = _histories(number, sizes, order)
            first = before[0] == START
            ctx_count = np.where(first, texts, np.roll(count, 1))
            keys, bodies, ids = [], [], []
            if not train:
                base = np.bincount(text, np.log10((count + 1) / (n + v + 1)), len(sizes))
                known = np.bincount(text, count > 0, len(sizes)).astype(np.int64)
                keys.append(-1 - r["block"])
                bodies.append([pack(sizes), pack(known), base.tobytes(), r["out"]])
                ids.append(r["ids"])
            salts = _salts(ctx_count, n, buckets)
            bucket = mix(before[0]) + np.where(salts > 1, mix(number) % salts.astype(np.uint64), 0).astype(np.uint64)
            bucket = (bucket % np.uint64(buckets)).astype(np.int64)
            learn = out[text] == 0
            # the parts of a split word also need the weights of contexts learned in other parts
            use = np.flatnonzero(learn | (salts > 1)) if train else np.arange(len(number))
            use = use[_order((number[use], *(h[use] for h in before[::-1]), bucket[use]))]       # texts stay in order
            cuts = np.searchsorted(bucket[use], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                o = use[cuts[k]:cuts[k + 1]]
                gram = [*(h[o] for h in before), number[o]]
                gram[0] = np.diff(gram[0], prepend=np.uint64(0))
                if train:
                    at = np.flatnonzero(_changes([h[o] for h in before] + [number[o]]))
                    gram[0] = np.diff(before[0][o][at], prepend=np.uint64(0))
                    gram[1:] = [g[at] for g in gram[1:]]
                    bodies.append([*map(pack, gram), pack(count[o][at]), pack(np.add.reduceat(learn[o].astype(np.int64), at)),
                                   pack(np.unique(before[0][o][salts[o] > 1]))])
                else:
                    bodies.append([*map(pack, gram), pack(count[o]), pack(text[o])])
                keys.append(int(k))
                ids.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([r["block"]] * len(keys), pa.int64()), pa.array(bodies, pa.list_(pa.binary())),
                 pa.array(ids, pa.list_(pa.int64()))], names=["bucket", "block", "body", "ids"])

    return blocks.mapInArrow(send, "bucket long, block long, body array<binary>, ids array<long>")


def _read(body: list[bytes]) -> list[np.ndarray]:
    """The columns of a body, the nearest context word restored."""
    columns = [unpack(x) for x in body]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def _counts(sent: DataFrame, order: int) -> DataFrame:
    """(bucket, body, n_r): each bucket's distinct n-grams in order with their
    last words' counts, their own counts and the split words; n_r: the numbers
    of n-grams seen 1 .. GT_MAX + 1 times, for each order from 2."""
    def add(t: pa.Table) -> pa.Table:
        parts = [_read(x) for x in t.column("body").to_pylist()]
        *gram, count, seen, hot = (np.concatenate(x) for x in zip(*parts))
        o = _order(gram[-1:] + gram[-2::-1])
        gram, count, seen = [g[o] for g in gram], count[o], seen[o]
        at = np.flatnonzero(_changes(gram))
        gram, count, seen = [g[at] for g in gram], count[at], np.add.reduceat(seen, at)
        b = _Bucket(gram, seen)
        n_r = np.concatenate([np.bincount(np.minimum(b.seen[k], GT_MAX + 2), minlength=GT_MAX + 3)[1:GT_MAX + 2] for k in range(2, order + 1)])
        body = [pack(np.diff(gram[0], prepend=np.uint64(0))), *map(pack, [*gram[1:], count, seen, np.unique(hot)])]
        return pa.Table.from_arrays([t.column("bucket").slice(0, 1), pa.array([body], pa.list_(pa.binary())), pa.array([n_r.tolist()], pa.list_(pa.int64()))],
                                    names=["bucket", "body", "n_r"])

    return sent.groupBy("bucket").applyInArrow(add, "bucket long, body array<binary>, n_r array<long>")


class _Bucket:
    """N-grams of a bucket in every order: ``gram[k]`` the order-k n-gram of each
    row, ``seen[k]`` its count, ``of[k]`` its context, ``first[k]`` a row of it,
    ``head[k]`` a row of each context; contexts are numbered in sorted order.
    Rows before ``learned`` are of texts to score, those from it of the counts table."""

    def __init__(self, gram: list[np.ndarray], n: np.ndarray, learned: int = 0):
        self.words, self.learned = gram, learned
        self.gram, self.seen, self.of, self.first, self.head = {}, {}, {}, {}, {}
        for k in range(2, len(gram) + 1):
            before = gram[:k - 1]
            o = _order([gram[-1], *before[::-1]])
            ctx = _changes([x[o] for x in before])
            new = ctx | _changes([gram[-1][o]])
            self.gram[k] = np.empty(len(o), np.int64)
            self.gram[k][o] = np.cumsum(new) - 1
            self.seen[k] = np.bincount(self.gram[k], n, int(new.sum())).astype(np.int64)
            self.of[k] = (np.cumsum(ctx) - 1)[new]
            self.first[k], self.head[k] = o[new], o[ctx]

    def sums(self, k: int, lower: np.ndarray, d: np.ndarray):
        """For each context of order k: tokens, n-grams with a discount,
        discounted tokens, share of the lower order's probability of the seen words."""
        r = self.seen[k]
        factor = np.append(d, 1.0)[np.minimum(np.maximum(r, 1), GT_MAX + 1) - 1]
        size = len(self.head[k])
        add = [np.bincount(self.of[k], x, size) for x in (r, (r > 0) & (factor < 1), factor * r, np.where(r > 0, lower[self.first[k]], 0.0))]
        return np.stack(add, 1)

    def climb(self, k: int, lower: np.ndarray, d: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Probability of each row at order k from that at order k - 1; weights
        (total, scale, alpha) of the contexts of the counts table, in their order."""
        r = self.seen[k]
        known = np.zeros(len(self.head[k]), bool)
        known[self.of[k][self.gram[k][self.learned:]]] = True
        total, scale, alpha = np.zeros(len(known)), np.ones(len(known)), np.ones(len(known))
        total[known], scale[known], alpha[known] = weights.T
        factor = np.append(d, 1.0)[np.minimum(np.maximum(r, 1), GT_MAX + 1) - 1]
        star = scale[self.of[k]] * factor * r / np.maximum(total[self.of[k]], 1)
        return np.where((r > 0)[self.gram[k]], star[self.gram[k]], alpha[self.of[k]][self.gram[k]] * lower)


def _weights_of(sums: np.ndarray) -> np.ndarray:
    """(total, scale, alpha) of contexts from their sums."""
    total, discounted, mass, share = sums.T
    seen = np.maximum(total, 1)
    scale = np.where((discounted == 0) & (total > 0), 1 - 0.5 / seen, 1.0)
    return np.stack([total, scale, np.where(total > 0, (1 - scale * mass / seen) / (1 - share), 1.0)], 1)


def _planes(a: np.ndarray) -> list[bytes]:
    """Rows of numbers, column by column, compressed."""
    return [len(a).to_bytes(8, "little")] + [pa.compress(np.ascontiguousarray(c).tobytes(), "zstd", asbytes=True) if len(a) else b"" for c in a.T]


def _rows(planes: list[bytes]) -> np.ndarray:
    n = int.from_bytes(planes[0], "little")
    return np.stack([np.frombuffer(pa.decompress(bytes(c), decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b"", np.float64)
                     for c in planes[1:]], 1)


def _model(t: pa.Table):
    """((n-grams, last words' counts, counts), split words, weights by order) of a
    bucket, from its rows of the counts (order 0) and weights tables."""
    grams, hot, weights, whole = None, None, {}, []
    for k, owner, body in zip(*(t.column(c).to_pylist() for c in ("order", "owner", "body"))):
        if k == 0:
            *gram, count, seen, hot = _read(body)
            grams = gram, count, seen
        elif owner < 0:
            weights[k] = _rows(body)
        else:
            whole.append((k, body))
    for k, body in whole:               # of split words, from all parts
        weights[k][unpack(body[0]).astype(np.int64)] = _rows(body[1:])
    return grams, hot, weights


def _weights(tables: DataFrame, k: int, d: list[np.ndarray], n: int, v: int, buckets: int) -> DataFrame:
    """(order, bucket, owner, body): weights of the order-k contexts of each bucket
    (owner -1), and places and weights of those of split words.
    ``tables`` holds the counts and the weights of the orders below k."""
    def send(t: pa.Table) -> pa.Table:
        (gram, count, seen), hot, weights = _model(t)
        p = (count.astype(np.float64) + 1) / (n + v + 1)
        b = _Bucket(gram, seen)
        for j in range(2, k):
            p = b.climb(j, p, d[j], weights[j])
        sums = b.sums(k, p, d[k])
        bucket = t.column("bucket")[0].as_py()
        ctx = [w[b.head[k]] for w in b.words[:k - 1]]
        split = np.flatnonzero(np.isin(ctx[0], hot))
        rows = [(bucket, -1, _planes(_weights_of(sums)))]
        key = np.zeros(len(split), np.uint64)
        for c in ctx:
            key = mix(key * np.uint64(31) + c[split])
        owner = key % np.uint64(buckets)
        for o in np.unique(owner):
            mine = split[owner == o]
            rows.append((bucket, int(o), [pack(mine), *(pack(c[mine]) for c in ctx), *_planes(sums[mine])]))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary())))],
                                    names=["bucket", "owner", "body"])

    def add(t: pa.Table) -> pa.Table:
        bodies = t.column("body").to_pylist()
        ctx = [np.concatenate([unpack(b[i]) for b in bodies]) for i in range(1, k)]
        parts = [_rows(b[k:]) for b in bodies]
        sums = np.concatenate(parts)
        o = _order(ctx[::-1])
        at = np.flatnonzero(_changes([c[o] for c in ctx]))
        whole = np.empty_like(sums)
        whole[o] = np.repeat(np.add.reduceat(sums[o], at), np.diff(np.append(at, len(o))), 0)
        cut = np.cumsum([0] + [len(x) for x in parts])
        weights = _weights_of(whole)
        return pa.Table.from_arrays(
            [t.column("bucket"), t.column("owner"), pa.array([[b[0], *_planes(weights[x:y])] for x, y, b in zip(cut, cut[1:], bodies)], pa.list_(pa.binary()))],
            names=["bucket", "owner", "body"])

    schema = "bucket long, owner long, body array<binary>"
    parts = stored(tables.groupBy("bucket").applyInArrow(send, schema), f"sums-{k}")
    back = stored(parts.filter("owner >= 0").groupBy("owner").applyInArrow(add, schema), f"split-{k}")
    return parts.filter("owner < 0").unionByName(back).withColumn("order", F.lit(k))


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER) -> DataFrame:
    """SCORES of every row under the model of ``order`` (2 or more); learned
    from the rows outside the held-out fold."""
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(modulus, remainder).alias("held_out"))
    size = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    vocab_buckets = max(1, math.ceil(size / 40 / VOCAB_BUCKET))
    vocabulary = stored(_vocabulary(rows, vocab_buckets), "vocabulary")
    stats = [unpack(r.numbers).astype(np.int64) for r in vocabulary.filter("block = -1").select("numbers").collect()]
    n, v, texts, tokens = (int(x) for x in np.sum(stats, 0)) if stats else (0, 0, 0, 0)
    buckets = max(1, math.ceil(tokens / BUCKET_TOKENS))
    blocks = stored(_tokens(rows, vocabulary, vocab_buckets), "tokens")
    counts = stored(_counts(_grams(blocks, order, buckets, n, v, texts, True), order), "counts")

    width = GT_MAX + 1
    found = counts.agg(*(F.sum(F.col("n_r")[i]) for i in range(width * (order - 1)))).first()
    d = [None, None] + [discounts({r: found[width * k + r - 1] or 0 for r in range(1, width + 1)}) for k in range(order - 1)]
    tables = counts.select(F.lit(0).alias("order"), "bucket", F.lit(-1).cast("long").alias("owner"), "body")
    for k in range(2, order + 1):
        tables = tables.unionByName(_weights(tables, k, d, n, v, buckets))

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks_, bodies = left.column("block").to_pylist(), left.column("body").to_pylist()
        out = []
        if len(left) and left.column("bucket")[0].as_py() < 0:
            out = list(zip(blocks_, bodies, left.column("ids").to_pylist()))
        elif len(left):
            parts = [_read(x) for x in bodies]
            *gram, count, text = (np.concatenate(x) for x in zip(*parts))
            block = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            seen = np.zeros(len(count), np.int64)
            weights = {k: np.empty((0, 3)) for k in range(2, order + 1)}
            if len(right):
                (grams, have, times), _, weights = _model(right)
                gram = [np.concatenate(x) for x in zip(gram, grams)]
                count, seen = np.concatenate([count, have]), np.concatenate([seen, times.astype(np.int64)])
            p = (count.astype(np.float64) + 1) / (n + v + 1)
            b = _Bucket(gram, seen, len(block))
            for k in range(2, order + 1):
                p = b.climb(k, p, d[k], weights[k])
            value, text = np.log10(p[:len(block)]), text.astype(np.int64)
            for i, number in enumerate(blocks_):
                mine = block == i
                at = np.unique(text[mine])
                out.append((number, [pack(at), np.bincount(text[mine], value[mine])[at].tobytes()], None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate((pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())))],
                                    names=["block", "body", "ids"])

    asked = _grams(blocks, order, buckets, n, v, texts, False)
    values = (asked.groupBy("bucket").cogroup(tables.groupBy("bucket"))
              .applyInArrow(evaluate, "block long, body array<binary>, ids array<long>"))

    def gather(t: pa.Table) -> pa.Table:
        rows_ = list(zip(t.column("ids").to_pylist(), t.column("body").to_pylist()))
        doc_ids, body = next(r for r in rows_ if r[0] is not None)
        sizes, known, out_ = (unpack(body[i]).astype(np.int64) for i in (0, 1, 3))
        total = np.zeros(len(sizes))
        for ids, part in rows_:
            if ids is None:
                total[unpack(part[0]).astype(np.int64)] += np.frombuffer(part[1], np.float64)
        return pa.Table.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(out_ > 0), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)),
             pa.array(np.frombuffer(body[2], np.float64)), pa.array(total)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return values.groupBy("block").applyInArrow(gather, SCORES)
