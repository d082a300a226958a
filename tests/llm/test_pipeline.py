import corpus_pipeline as cp
from quillstream.llm import decontaminate, near_duplicates
from quillstream.llm.common import stored
from quillstream.session import table
from test_near_duplicates import brute as groups
from test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    kept = stored(cp.drop_toxic(spark, docs, SF), "t")
    assert kept.columns == columns
    left = {r.doc_id for r in kept.collect()}
    assert all(i in left for i, t in labels.items() if not t)

    rows = {r.doc_id: r.text for r in kept.collect()}
    kept = stored(cp.drop_near_duplicates(spark, kept, SF), "t")
    want = groups(list(rows.items()))
    assert {r.doc_id for r in kept.collect()} == {i for i, g in want.items() if g in (i, None)} and kept.columns == columns

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    kept = stored(cp.cut_repeats(spark, kept, SF), "t")
    assert kept.columns == columns
    got = {r.doc_id: r for r in kept.collect()}
    for (i, t), (_, n, removed, _, _) in zip(rows, repeats(rows, 200, 400, 51)):
        assert removed - 4 <= n - len(got[i].text.encode()) - 0 <= removed + 12 and (removed or got[i].text == t)

    clean = {r.doc_id for r in decontaminate.decontaminate(kept, table(spark, SF, "benchmark")).collect() if not r.contaminated}
    kept = stored(cp.drop_contaminated(spark, kept, SF), "t")
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == columns
    packed = cp.pack(spark, kept, SF).toPandas()
    assert set(packed.doc_id) == clean and packed.groupby("batch").slot.nunique().sum() == len(packed)
    assert cp.run(spark, SF).count() == len(packed)


def test_odd_rows(spark, docs_of):
    rows = [(None, None), (None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"),
            (2, "one two three four five six"), (3, ""), (3, None), (4, "word " * 90000)]
    docs = docs_of(rows).drop("row")
    for name, stage in cp.STAGES[:-1]:
        n = docs.count()
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns[-1] == "score" and docs.count() == n - (2 if name == "near_duplicates" else 0)
    out = cp.pack(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 0, 1, 3, 3, 4]
    assert cp.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0
    assert near_duplicates.without_near_duplicates(docs_of(rows)).columns == docs_of(rows).columns
