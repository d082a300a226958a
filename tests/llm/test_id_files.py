import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillstream.llm import id_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_record_round_trip():
    rng = np.random.default_rng(0)
    cases = [[], [2], [0, 65535, 0], [7] * 5000, rng.integers(0, 65536, 3000), rng.zipf(1.3, 9000) % 50257, list(range(100)) * 50]
    for ids in cases:
        ids = np.array(ids, np.int32)
        for block in (64, 2048):
            assert (id_files.expand_ids(id_files.compress_ids(ids, block)) == ids).all()
    text = np.array(([5, 9, 100, 44, 3000] * 4 + [17]) * 500, np.int32)
    assert len(id_files.compress_ids(text)) < len(text) * 2 / 8
    with pytest.raises(ValueError):
        id_files.compress_ids(np.array([70000]))


def test_damage_shows_and_stays_in_its_block():
    ids = np.random.default_rng(1).integers(0, 50257, 500).astype(np.int32)
    record = bytearray(id_files.compress_ids(ids, 100))
    record[-40] ^= 1
    with pytest.raises(ValueError):
        id_files.expand_ids(bytes(record))


def test_documents(spark, docs_of):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "né", "cat", "\n", "x" * 9, "12"]) for _ in range(rng.randint(0, 300)))) for i in rng.sample(range(1000), 80)]
    rows += [(2000, None), (2001, ""), (2002, "a" * 20000), (rows[0][0], rows[0][1]), (None, "no id")]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in id_files.round_trip(docs_of(rows), PATH).collect())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert id_files.round_trip(docs_of(rows).limit(0), PATH).collect() == []


def test_tasks_write_the_bytes_of_the_reference_coder(spark):
    rng = np.random.default_rng(3)
    cases = [[], [2], [0, 65535, 0], [7] * 5000, rng.integers(0, 65536, 3000), rng.zipf(1.3, 9000) % 50257, list(range(100)) * 50,
             np.array(([5, 9, 100, 44, 3000] * 4 + [17]) * 500)]
    compress, expand = id_files._coder(spark)
    rows = spark.createDataFrame([(i, bytearray(np.array(c, "<u2").tobytes())) for i, c in enumerate(cases)] + [(99, None)], "i int, ids binary")
    records = rows.withColumn("record", compress("ids")).withColumn("back", expand("record")).collect()
    assert len(records) == len(cases) + 1 and records[-1].record is None
    for r, c in zip(sorted(records[:-1]), cases):
        assert bytes(r.record) == id_files.compress_ids(np.array(c, np.int32)) and r.back == r.ids
    record = bytearray(next(r.record for r in records if r.i == 4))
    record[-40] ^= 1
    with pytest.raises(Exception, match="checksum differs"):
        spark.createDataFrame([(record,)], "record binary").select(expand("record")).collect()


def test_ids_by_ranks_are_the_librarys(spark, tmp_path):
    import json

    from tokenizers import Tokenizer
    tk, ranks = Tokenizer.from_file(PATH), id_files.by_ranks(PATH)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "'LL", "é", "e\u0301", "ß", "中文", "👩‍👩‍👧", "\x00", "\u200b", "٣", "²", "Ⅷ", "a", "the", "12", "!?", "<|endoftext|>", "_", "\ufeff"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["", " " * 1_500_000 + "x", "ab" * 5000]
    assert [x.tolist() for x in id_files._encoder(PATH, ranks)(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    spec = json.load(open(PATH))
    spec["model"]["merges"][5:7] = spec["model"]["merges"][6:4:-1]          # merges out of the ids' order
    other = str(tmp_path / "other.json")
    json.dump(spec, open(other, "w"))
    assert ranks is not None and id_files.by_ranks(other) is None


def test_ids_are_read_back(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer
    tk, texts = Tokenizer.from_file(PATH), {1: "the cat", 2: None, 3: "x" * 5000 + " né"}
    id_files.write_ids(docs_of(list(texts.items())), str(tmp_path / "ids"), PATH, row_ids=3)
    got = {r.doc_id: r.ids for r in id_files.read_ids(spark, str(tmp_path / "ids")).collect()}
    assert got == {i: tk.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
