import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillstream.llm import suffix_dedup as sd
from quillstream.session import table


def brute(rows, length=400, whole=0, words=0):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[k:k + length]) for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - length + 1):
            if seen[hash(b[k:k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        spans = 0
        for s, e in zip(edge[::2], edge[1::2]):
            stays = e - s < whole and len(b[s:e].split()) < words
            gone[s:e] = not stays
            spans += not stays
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(got, rows, **kw):
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, **kw), key=key)


def test_whole_table_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sd.deduplicate(docs).collect()
    same(got, rows)
    assert sum(r.n_removed > 0 for r in got) > 5


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("crowd", [1500, 3])
def test_cases(docs_of, crowd):
    rng = random.Random(5)
    passage = prose(rng, 120)
    rows = [(None, None), (1, ""), (2, "a" * 399), (3, "b" * 400), (4, "c" * 401), (5, "xyz" * 500), (6, "xyz" * 140),
            (7, prose(rng, 300)), (7, prose(rng, 300)), (8, "same " + prose(rng, 200))]
    rows += [rows[-1], (9, rows[-1][1])]
    rows += [(20 + i, prose(rng, rng.randint(0, 60)) + passage + prose(rng, rng.randint(0, 60))) for i in range(25)]
    rows += [(60 + i, passage[:398 + i] + prose(rng, 30)) for i in range(5)]
    rows += [(70, "né" * 3000), (71, passage[50:] + passage[50:])]
    same(sd.deduplicate(docs_of(rows), crowd=crowd).collect(), rows)


def test_long_text_is_cut_into_slices(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 5000)
    rng = random.Random(6)
    t = prose(rng, 6000)
    rows = [(1, t), (2, prose(rng, 300) + t[9000:15000]), (3, prose(rng, 900))]
    same(sd.deduplicate(docs_of(rows)).collect(), rows)


@pytest.mark.parametrize("crowd", [1500, 0])
def test_periods_around_the_places_of_a_window(docs_of, crowd):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(p, letters(p) * 3) for p in (368, 369, 370, 738)]
    t = letters(369)
    rows += [(1000, letters(50) + t + t + t[:31] + letters(50))]     # two equal windows, 369 bytes apart
    got = sd.deduplicate(docs_of(rows), crowd=crowd).collect()
    same(got, rows)
    assert {r.doc_id: r.n_removed for r in got}[369] == 1107


def test_empty_table(docs_of):
    assert sd.deduplicate(docs_of([(1, "x")]).limit(0)).collect() == []


def test_repeated_windows_any_length():
    rng = random.Random(7)
    for _ in range(300):
        t = np.array([rng.choice([97, 98, 99, 255]) for _ in range(rng.randint(12, 400))] + [255], np.uint8)
        length = rng.randint(1, 12)
        b = t.tobytes()
        c = Counter(b[i:i + length] for i in range(len(b) - length + 1))
        got = sd.repeated_windows(t, length)
        for i in range(len(b) - length + 1):
            if 255 not in b[i:i + length]:
                assert (c[b[i:i + length]] > 1) == got[i]


def test_passages_of_over_fifty_words_go(docs_of):
    """Under 400 bytes too; a shorter phrase stays, and text without blanks goes from 400 bytes on."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = " ".join(word(rng.randint(3, 7)) for _ in range(55))
    phrase = " ".join(word(rng.randint(4, 7)) for _ in range(45))
    packed, solid = word(390), word(400)        # a blank on each side is shared too
    assert 200 < len(phrase) < 400 and 200 < len(passage) < 400
    rows = [(i, f"{prose(rng, 90)} {i} {shared} {i} {prose(rng, 90)}") for i, shared in
            enumerate([passage, passage, phrase, phrase, packed, packed, solid, solid, prose(rng, 60)])] + [(20, None), (21, "")]
    left = {r.doc_id: r.text for r in sd.without_repeats(docs_of(rows)).collect()}
    want = brute(rows, length=sd.PASSAGE, whole=sd.LENGTH, words=sd.WORDS)
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in left.items()} == {r[0]: r[4] for r in want}
    text = dict(rows)
    for i, cut in enumerate([passage, passage, "", "", "", "", solid, solid, ""]):
        assert (cut not in left[i] if cut else left[i] == text[i])
    assert left[20] is None and left[21] == ""
