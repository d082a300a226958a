import re
import zlib
from collections import Counter

from quillstream.llm import spelling as S
from quillstream.llm.queries import QUERIES
from quillstream.session import table

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= least}
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), []).append(w)
            short = w[:i] + w[i + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def shown(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want, got = brute(rows), shown(QUERIES["op11_spelling_variants"](spark, SF))
    assert got == want and sum(w[0] is not None for w in want.values()) > 20
    assert any(w[0] and w[0] != w[1] for w in want.values())


def test_odd_rows(spark, docs_of):
    rows = [(None, None), (None, "colour color COLOR colors"), (1, ""), (1, "colour colour colours colour"), (1, "colour colour colours colour"),
            (2, "éclair éclair éclair eclair eclair eclair éclairs éclairs éclairs Éclair ÷éclair"), (3, "z" * 70000 + " " + "z" * 69999),
            (4, ("z" * 70000 + " ") * 3 + ("z" * 69999 + "y ") * 3), (5, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"),
            (6, "colon colon colon color color color colour1colour"), (None, "naïve_naïve-naïve naive")]
    rows += [(i, "there their there three thee") for i in range(300)]
    assert shown(S.variants(docs_of(rows))) == brute(rows)


def test_full_filters_only_cost_time(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    blocks, first, bits = S.filters(S.word_counts(docs), 256)
    assert bits.nbytes <= 512
    assert shown(S.variants(docs, max_bytes=256)) == brute(rows)


def test_empty_table(spark, docs_of):
    assert S.variants(docs_of([])).collect() == []
