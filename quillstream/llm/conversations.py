"""Repair of damaged conversations by a run-length min-plus dynamic program.

A repaired conversation is an optional system row followed by user/assistant
pairs (``(s?(ua)+)?`` in role initials). Rows are kept, reroled, deleted or
completed by inserted rows; the cheapest edits win, and of several cheapest
ones the one whose audit string is least in ASCII order.

1. ``marked``: equal rows of a place are collapsed to one row with a count, and
   every row gets its first fault. All but the first of equal rows are
   duplicates, so a row and its count are at most two runs.
2. ``placed``: rows are range-partitioned by conversation and turn, sorted and
   numbered. A conversation may span many partitions; no task holds all of it.
3. ``_pieces``: a piece is a conversation's part of one block of ``BLOCK``
   rows. Its (role, fault) symbols are collapsed to runs, and each run of
   length n advances the cost table by powers M, M^2, M^4, ... of its symbol's
   4 x 4 min-plus transition, which are computed once and cached.
4. ``_ends``: for conversations of several pieces only, the pieces' matrices
   (16 numbers each) are composed to the cost-to-go at the end of every piece,
   and the pieces' choices to the state at the start of every piece.
5. ``edits``: each piece unrolls its runs to the edits of every row, halving a
   run by the cached powers. In a state each edit leads to one next state, so
   taking the least letter among the cheapest edits gives the least audit.
6. ``report``: counts and audits are aggregates; the hash of a repaired
   conversation is fed row by row from sorted partitions.

Defined cases: null role and text count as one space; a null turn comes first
and is left out of ``gaps``; null conversation ids form one conversation; rows
of one turn are taken by role and text; equal rows are adjacent; a null in the
damage key is one space; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK_BITS = 14             # rows of a block, as a power of two
FAR = 1 << 60
#: states: nothing yet, after the system row, after a user row, after an assistant row
AFTER = (2, 2, 3, 2)        # state after the role that a state expects
EXPECTS = "uuau"
FINISH = (0, 2 * INSERT, INSERT, 0)
MUST_DELETE = 8             # symbol; others are 2 * role + truncated
ROLES = "sua"
_powers: dict[int, list] = {}


def moves(symbol: int, state: int):
    """(letter, cost, next state) of the edits that use up a row, by letter."""
    yield "D", DELETE, state
    if symbol != MUST_DELETE:
        role, extra = ROLES[symbol >> 1:][:1], TRUNCATED * (symbol & 1)
        if role == "s" and state == 0:
            yield "K", KEEP + extra, 1
        elif role == EXPECTS[state]:
            yield "K", KEEP + extra, AFTER[state]
        yield "R", REROLE + extra, AFTER[state]


def _times(a, b):
    return [[min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)] for i in range(4)]


def advance(m, v):
    return [min(m[i][0] + v[0], m[i][1] + v[1], m[i][2] + v[2], m[i][3] + v[3]) for i in range(4)]


def transition(symbol: int):
    """Cost from a state before a row, inserts included, to a state after it."""
    step = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, to in moves(symbol, s):
            step[s][to] = min(step[s][to], cost)
    inserts = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        inserts[s][s] = 0
        inserts[s][AFTER[s]] = min(inserts[s][AFTER[s]], INSERT)
        inserts[s][AFTER[AFTER[s]]] = min(inserts[s][AFTER[AFTER[s]]], 2 * INSERT)
    return _times(inserts, step)


def power(symbol: int, bit: int):
    """The transition of 2**bit rows of a symbol (cached)."""
    have = _powers.setdefault(symbol, [transition(symbol)])
    while len(have) <= bit:
        have.append(_times(have[-1], have[-1]))
    return have[bit]


def before_run(symbol: int, n: int, after):
    """Cost to go before a run of ``n`` rows, from that after it."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            after = advance(power(symbol, bit), after)
    return after


def piece_matrix(runs):
    m = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for symbol, n in runs:
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                m = _times(m, power(symbol, bit))
    return m


def unroll(symbol: int, n: int, after, state: int):
    """Edits of each of the ``n`` rows of a run, and the state after it."""
    if n == 1:
        cost, letters = advance(power(symbol, 0), after), []
        while True:
            for letter, c, to in moves(symbol, state):
                if letter > "I" and cost[AFTER[state]] + INSERT == cost[state]:
                    break
                if c + after[to] == cost[state]:
                    return ["".join(letters) + letter], to
            letters.append("I")
            state = AFTER[state]
    half = 1 << ((n - 1).bit_length() - 1)
    first, state = unroll(symbol, half, before_run(symbol, n - half, after), state)
    rest, state = unroll(symbol, n - half, after, state)
    return first + rest, state


def unroll_runs(runs, end, state: int):
    """Edits of the rows of a piece's runs, and the state after them."""
    after = [end]
    for symbol, n in reversed(runs):
        after.append(before_run(symbol, n, after[-1]))
    out = []
    for (symbol, n), a in zip(runs, reversed(after[:-1])):
        edits, state = unroll(symbol, n, a, state)
        out += edits
    return out, state


def collapse(symbols, copies):
    """Runs (symbol, rows) of rows with counts; copies after the first are duplicates."""
    runs: list[list[int]] = []
    for s, c in zip(symbols, copies):
        for symbol, n in ((s, 1), (MUST_DELETE, c - 1)):
            if n and runs and runs[-1][0] == symbol:
                runs[-1][1] += n
            elif n:
                runs.append([symbol, n])
    return runs


def _plain(rows: DataFrame) -> DataFrame:
    """Rows with nulls of role and text as one space, and the id in two columns."""
    conv = F.col("conv_id").cast("long")
    return rows.select(F.coalesce(conv, F.lit(0)).alias("c"), conv.isNull().alias("cn"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) modulo 20: dropped, emptied,
    without sentence ends, repeated, or with role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("long").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("long").cast("string"), space))
    kind = F.col("_kind")
    return rows.withColumn("_kind", F.crc32(key.cast("binary")) % 20).filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """One row of each (conversation, turn, role, text) with its copies, and
    the symbol of its first copy."""
    one = _plain(rows).groupBy("c", "cn", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    same = [F.xxhash64("role", "text").alias("h1"), F.md5(F.concat("role", F.lit("\0"), "text")).alias("h2")]
    one = stored(one.select("*", place.alias("place"), *same), "rows")
    first = one.groupBy("c", "cn", "h1", "h2").agg(F.min("place").alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("blank") | F.col("again"), MUST_DELETE).otherwise(2 * role + F.when(ended, 0).otherwise(1))
    return (one.join(first, ["c", "cn", "h1", "h2"]).withColumn("blank", blank).withColumn("again", F.col("place") > F.col("first"))
            .select("c", "cn", "turn", "role", "text", initial.alias("initial"), "copies", symbol.cast("int").alias("symbol"),
                    F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
                    F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("again"), 0).otherwise(1)).alias("duplicate"),
                    F.when(F.col("blank") | F.col("again") | ended, 0).otherwise(1).alias("truncated")))


def placed(rows: DataFrame) -> DataFrame:
    """Marked rows in order, numbered by ``at``."""
    order = [F.col("c"), F.col("cn"), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = marked(rows).repartitionByRange(*order, F.substring("text", 1, 64))
    return stored(ranged.sortWithinPartitions(*order, "text").withColumn("at", F.monotonically_increasing_id()), "placed")


PIECE = "c long, cn boolean, block long, first string, last string, broken long, matrix array<long>"
ENDS = "c long, cn boolean, block long, cost long, broken long, end array<long>, tail boolean"
EDITS = "at long, edits string, start int"


def _by_piece(t: pa.Table):
    """Row lists of each conversation of a block, in order."""
    rows = t.combine_chunks().sort_by("at").to_pydict()
    keys = list(zip(rows["cn"], rows["c"]))
    lo = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[lo]:
            yield keys[lo], {k: v[lo:i] for k, v in rows.items()}
            lo = i


def _broken(initials, copies) -> int:
    """Adjacent pairs of rows that no conversation holds."""
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return bad + sum(n - 1 for a, n in zip(initials, copies) if a + a not in ("su", "ua", "au"))


def _pieces(block: pa.Table) -> pa.Table:
    out = []
    number = block.column("block")[0].as_py()
    for (cn, c), rows in _by_piece(block):
        m = piece_matrix(collapse(rows["symbol"], rows["copies"]))
        out.append({"c": c, "cn": cn, "block": number, "first": rows["initial"][0], "last": rows["initial"][-1],
                    "broken": _broken(rows["initial"], rows["copies"]), "matrix": sum(m, [])})
    return pa.Table.from_pylist(out, pa.schema([("c", pa.int64()), ("cn", pa.bool_()), ("block", pa.int64()), ("first", pa.string()),
                                                ("last", pa.string()), ("broken", pa.int64()), ("matrix", pa.list_(pa.int64()))]))


def _ends(pieces: pa.Table) -> pa.Table:
    """Cost to go after each piece of one conversation, and its broken pairs."""
    p = pieces.combine_chunks().sort_by("block").to_pylist()
    v, out = list(FINISH), []
    for i in range(len(p) - 1, -1, -1):
        m = [p[i]["matrix"][4 * k:4 * k + 4] for k in range(4)]
        row = {k: p[i][k] for k in ("c", "cn", "block")} | {"end": v, "tail": i == len(p) - 1, "cost": None, "broken": p[i]["broken"]}
        if i:
            row["broken"] += p[i - 1]["last"] + p[i]["first"] not in ("su", "ua", "au")
        v = advance(m, v)
        out.append(row)
    out[-1]["cost"] = v[0]
    return pa.Table.from_pylist(out, pa.schema([("c", pa.int64()), ("cn", pa.bool_()), ("block", pa.int64()), ("cost", pa.int64()),
                                                ("broken", pa.int64()), ("end", pa.list_(pa.int64())), ("tail", pa.bool_())]))


def _maps(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """State after a piece for each state before it."""
    end = {(e["cn"], e["c"]): e for e in ends.to_pylist()}
    out = []
    for key, r in _by_piece(rows) if rows.num_rows else ():
        if key in end:
            runs = collapse(r["symbol"], r["copies"])
            out.append({"c": key[1], "cn": key[0], "block": r["block"][0],
                        "to": [unroll_runs(runs, end[key]["end"], s)[1] for s in range(4)]})
    return pa.Table.from_pylist(out, pa.schema([("c", pa.int64()), ("cn", pa.bool_()), ("block", pa.int64()), ("to", pa.list_(pa.int32()))]))


def _starts(maps: pa.Table) -> pa.Table:
    """State before each piece of one conversation."""
    state, out = 0, []
    for p in maps.combine_chunks().sort_by("block").to_pylist():
        out.append({"c": p["c"], "cn": p["cn"], "block": p["block"], "start": state})
        state = p["to"][state]
    return pa.Table.from_pylist(out, pa.schema([("c", pa.int64()), ("cn", pa.bool_()), ("block", pa.int64()), ("start", pa.int32())]))


def _row_edits(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """Edits of each row of a block and the state before it; a conversation's
    last row also has the inserts that finish it."""
    end = {(e["cn"], e["c"]): e for e in ends.to_pylist()}
    at, edits, start = [], [], []
    for key, r in _by_piece(rows) if rows.num_rows else ():
        e = end[key]
        letters, _ = unroll_runs(collapse(r["symbol"], r["copies"]), e["end"], e["start"])
        i, state = 0, e["start"]
        for place, n, initial in zip(r["at"], r["copies"], r["initial"]):
            part = "".join(letters[i:i + n])
            i += n
            at.append(place)
            start.append(state)
            for letter in part:
                state = state_after(letter, state, initial)
            edits.append(part)
        if e["tail"]:
            edits[-1] += "I" * (FINISH[state] // INSERT)
    return pa.Table.from_arrays([pa.array(at, pa.int64()), pa.array(edits, pa.string()), pa.array(start, pa.int32())], names=["at", "edits", "start"])


def state_after(letter: str, state: int, initial: str) -> int:
    if letter == "D":
        return state
    return 1 if letter == "K" and initial == "s" else AFTER[state]


def edits(rows: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows in order, the edits of each row, cost and broken pairs of each piece)."""
    rows = placed(rows).withColumn("block", F.shiftright("at", block_bits))
    narrow = rows.select("c", "cn", "block", "at", "initial", "symbol", "copies")
    pieces = stored(narrow.groupBy("block").applyInArrow(_pieces, PIECE), "pieces")
    many = pieces.groupBy("c", "cn").agg(F.count(F.lit(1)).alias("k"))
    pieces = pieces.join(many, ["c", "cn"])
    m = F.col("matrix")
    alone = pieces.filter("k = 1").select(
        "c", "cn", "block", F.least(*[m[i] + FINISH[i] for i in range(4)]).alias("cost"), "broken",
        F.array(*[F.lit(x).cast("long") for x in FINISH]).alias("end"), F.lit(0).alias("start"), F.lit(True).alias("tail"))
    split = stored(pieces.filter("k > 1").drop("k").groupBy("c", "cn").applyInArrow(_ends, ENDS), "ends")
    key = ["c", "cn", "block"]
    maps = narrow.join(split.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(
        split.groupBy("block")).applyInArrow(_maps, "c long, cn boolean, block long, to array<int>")
    starts = maps.groupBy("c", "cn").applyInArrow(_starts, "c long, cn boolean, block long, start int")
    split = split.join(starts, key).select("c", "cn", "block", "cost", "broken", "end", "start", "tail")
    ends = stored(alone.unionByName(split), "ends")
    done = narrow.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(_row_edits, EDITS)
    return rows, stored(done, "edits"), ends


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(c, cn, at, line, role, text): the repaired rows, inserted ones with an
    empty text."""
    def write(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                state = r["start"]
                for line, letter in enumerate(r["edits"]):
                    role = "assistant" if EXPECTS[state] == "a" else "user"
                    state = state_after(letter, state, r["initial"])
                    if letter != "D":
                        out.append((r["c"], r["cn"], r["at"], line, r["role"] if letter == "K" else role, "" if letter == "I" else r["text"]))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["c", "cn", "at", "line", "role", "text"])

    return (rows.select("c", "cn", "at", "initial", "role", "text").join(done, "at").filter("edits <> repeat('D', length(edits))")
            .mapInArrow(write, "c long, cn boolean, at long, line int, role string, text string"))


def _hashes(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, in order."""
    def feed(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for cn, c, role, text in zip(*(b.column(k).to_pylist() for k in ("cn", "c", "role", "text"))):
                line = f"{role}:{text}".encode()
                if (cn, c) == key:
                    digest.update(b"\n" + line)
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (cn, c), hashlib.sha256(line)
            yield _hash_rows(out)
        if key:
            yield _hash_rows([(*key, digest.hexdigest())])

    order = ["cn", "c", "at", "line"]
    return lines.repartition("cn", "c").sortWithinPartitions(*order).select(*order, "role", "text").mapInArrow(feed, "cn boolean, c long, repaired_sha256 string")


def _hash_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.bool_(), pa.int64(), pa.string()))],
                                      names=["cn", "c", "repaired_sha256"])


def report(original: DataFrame, rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row of every conversation of ``original``: faults of ``rows``, cost
    and audit of their repair, and the hash of the repaired conversation."""
    placed_rows, done, ends = edits(rows, block_bits)
    sums = [F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")]
    counts = (placed_rows.groupBy("c", "cn", "turn").agg(*sums).groupBy("c", "cn")
              .agg(*sums, F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")))
    costs = ends.groupBy("c", "cn").agg(F.max("cost").alias("cost"), F.sum("broken").alias("illegal"))

    def joined(place, part):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, part))), lambda x: x[part]), "")

    audits = (placed_rows.select("c", "cn", "block", "at").join(done, "at").groupBy("c", "cn", "block").agg(joined("at", "edits").alias("part"))
              .groupBy("c", "cn").agg(joined("block", "part").alias("audit")))
    conv = F.col("conv_id").cast("long")
    ids = original.select(F.coalesce(conv, F.lit(0)).alias("c"), conv.isNull().alias("cn")).distinct()
    key = ["c", "cn"]
    whole = ids.join(counts, key, "left").join(costs, key, "left").join(audits, key, "left").join(_hashes(repaired(placed_rows, done)), key, "left")
    zero = [F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.when(~F.col("cn"), F.col("c")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
