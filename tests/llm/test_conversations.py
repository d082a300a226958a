import hashlib
import re
import zlib

import pytest
from pyspark.sql import types as T

from quillstream.llm import conversations as C
from quillstream.llm.queries import QUERIES
from quillstream.session import table

SF = "/root/testdata/sf0.001"
ROW = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if k == 0:
            continue
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, lines) over all edits, by plain steps from the last row to the first."""
    full, expect = {"u": "user", "a": "assistant"}, {"": "u", "s": "u", "u": "a", "a": "u"}
    after = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        if i == len(rows):
            v = dict(after)
        else:
            role, text, fault = rows[i]
            extra, v = 3 if fault == "truncated" else 0, {}
            for state, want in expect.items():
                step = [(4, "D", (), state)]
                if fault not in ("blank", "duplicate"):
                    if role[:1] == want or (role[:1] == "s" and state == ""):
                        step.append((extra, "K", (f"{role}:{text}",), role[:1]))
                    step.append((3 + extra, "R", (f"{full[want]}:{text}",), want))
                v[state] = min(((c + after[to][0], x + after[to][1], line + after[to][2]) for c, x, line, to in step if to in after), default=(10 ** 9, "", ()))
        for _ in range(4):
            for state, want in expect.items():
                if want in v:
                    v[state] = min(v.get(state, (10 ** 9, "", ())), (3 + v[want][0], "I" + v[want][1], (f"{full[want]}:", *v[want][2])))
        after = v
    return after[""]


def brute(rows):
    out = {}
    space = set(" \t\n\v\f\r")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in mine:
            body = [x for x in text if x not in space]
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = cheapest(marked)
        turns = [r[1] for r in mine if r[1] is not None]
        faults = [f for *_, f in marked]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def shown(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want, got = brute(rows), shown(QUERIES["op13_conversation_repair"](spark, SF))
    assert got == want
    assert any(w[5] for w in want.values())


@pytest.mark.parametrize("bits", [14, 2, 0])
def test_odd_rows_over_many_pieces(spark, bits):
    """Nulls in any column, ties, repeated rows, odd roles, conversations cut into pieces of four rows and of one."""
    text = ["Yes.", "no", "", " \t", None, "Why? ", "ok!", "x" * 50000 + ".", "a\nb."]
    role = ["user", "assistant", "system", "tool", None, ""]
    rows = [(c, None if t == 3 else t // 2, role[(c * 7 + t * 5 + t // 4) % 6], text[(c * 3 + t * t) % 9]) for c in range(12) for t in range(14)]
    rows += [(20, t, "user", "same.") for t in range(30)] + [(21, 1, "user", "same.")] * 9 + [(22, 0, "system", "only.")]
    rows += [(None, 0, "user", "q?"), (None, None, "user", "q?"), (None, 1, "assistant", "done."), (23, None, "user", None)]
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as at", "2 as block", "'x' as copies", "3 as c")
    got = shown(C.report(df, C.damage(df), bits))
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], ROW)
    assert C.report(df, C.damage(df)).collect() == []


def test_runs_advance_like_single_rows():
    for symbol in range(9):
        v = list(C.FINISH)
        for n in range(1, 40):
            v = C.advance(C.transition(symbol), v)
            assert v == C.before_run(symbol, n, list(C.FINISH))
    runs = C.collapse([2, 2, 4, 8], [1, 3, 1, 2])
    assert runs == [[2, 2], [8, 2], [4, 1], [8, 2]]
