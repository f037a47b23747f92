"""Both substring operators against brute force."""

from hashlib import sha256
from random import Random

import numpy as np
import pytest

from scanloom.llm import repeats, substring_dedup, suffix_dedup


def texts(seed: int) -> list[tuple[int, str | None]]:
    r = Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    base = [word() for _ in range(160)]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "ab " * 200), (4, "ab " * 130 + "x"), (5, "\x00é\x00" * 90)]
    for d in range(6, 40):
        w = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            a = r.randint(0, 90)
            cut = r.randint(0, len(w))
            w[cut:cut] = base[a : a + r.randint(20, 80)]
        if w and r.random() < 0.5:
            w[r.randrange(len(w))] = "Z"
        out.append((d, r.choice([" ", "\n", "  "]).join(w)))
    out += [(50, out[7][1]), (51, out[7][1]), (45, out[9][1])]
    return out


def brute_bytes(rows, span):
    raw = {d: (t or "").encode() for d, t in rows}
    seen, gone = set(), {d: np.zeros(len(b), bool) for d, b in raw.items()}
    for d in sorted(raw):
        for s in range(len(raw[d]) - span + 1):
            w = raw[d][s : s + span]
            if w in seen:
                gone[d][s : s + span] = True
            seen.add(w)
    out = {}
    for d, b in raw.items():
        g = gone[d]
        out[d] = (len(b), int(g.sum()), int(np.count_nonzero(g & ~np.r_[False, g[:-1]])) if len(g) else 0, sha256(bytes(x for x, k in zip(b, g, strict=True) if not k)).hexdigest())
    return out


def brute_words(rows, span):
    words = {d: (t or "").encode().split() for d, t in rows}
    seen, out = set(), {}
    for d in sorted(words):
        w, own = words[d], set()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            if key in seen:
                gone[s : s + span] = True
            own.add(key)
        seen |= own
        out[d] = (len(w), int(gone.sum()), sha256(b" ".join(x for x, k in zip(w, gone, strict=True) if not k)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}
    assert got == brute_bytes(rows, 100)
    assert sum(x[1] for x in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df).collect()}
    assert got == brute_words(rows, 50)
    assert sum(x[1] for x in got.values())


def thue_morse(letters: str) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(2048))


@pytest.mark.parametrize("by_rows", [False, True])
def test_long_words_and_buckets(spark, monkeypatch, by_rows):
    """Very long texts and words, words that a polynomial hash confuses, and buckets of many classes, in both ways."""
    monkeypatch.setattr(repeats, "HOT", 1 if by_rows else 40)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1000)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 1000)
    r = Random(8)
    base = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{base} {thue_morse('ab')}"), (2, f"{base} {thue_morse('ba')}"), (3, f"{base} {thue_morse('ab')} x")]
    passage = " ".join(f"p{k}" for k in range(70))
    for d in range(10, 70):
        own = [" ".join(f"{r.choice('abc')}{r.randrange(3)}" for _ in range(r.randrange(60))) for _ in range(2)]
        rows.append((d, f"{own[0]} {passage} {own[1]}"))
    long = " ".join(f"l{r.randrange(50)}" for _ in range(20_000))
    rows += [(80, long), (81, f"{long[:40_000]} cut {long[40_001:]}"), (82, "y" * 60_000), (83, "y" * 50_000 + "z" + "y" * 300), (84, "ab " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows_in_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows_in_a_batch, 3 if by_rows else 7)  # classes and their contents in different batches
    try:
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup(df).collect()}
        assert got == brute_words(rows, 50)
        assert got[2][1] == 0 and got[3][1] == 50
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(df).collect()}
        assert got == brute_bytes(rows, 100)
    finally:
        spark.conf.unset(rows_in_a_batch)


def test_cover_is_a_difference_cover():
    p, d = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in d for b in d} == set(range(p))


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(empty).count() == 0 and substring_dedup.dedup(empty).count() == 0
    long = "word%d " * 0 + " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(None, long), (1, long), (2, long), (2, long)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(df).collect()))
    assert [x[2] > 0 for x in got] == [False, True, True, False]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(df).collect()))
    assert [x[2] > 0 for x in got] == [False, True, True, False]


def test_anchors_in_the_transform():
    """An anchor stands for several bytes of a prefix, and equal surroundings of different anchors are no repeat."""
    r = Random(5)
    text = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    for _ in range(40):
        grams = [text(8) for _ in range(2)]
        classes = []
        for k in range(r.randint(2, 12)):
            a = r.randint(0, 6)
            classes.append((bytes((a,)) + text(a) + r.choice(grams) + text(r.randint(12 - 8, 6)), r.randint(0, 4), k * 100))
        got = {k: set(w.tolist()) for k, w in suffix_dedup.earlier(classes, 12, 8)}
        want = {}
        for k, (body, doc, start) in enumerate(classes):
            for w in range(body[0] + 1):
                x = body[1 + w : 13 + w]
                same = [(d, s + v) for b, d, s in classes for v in range(b[0] + 1) if len(x) == 12 and b[1 + v : 13 + v] == x and b[0] - v == body[0] - w]
                if same and min(same) < (doc, start + w):
                    want.setdefault(k, set()).add(w)
        assert got == want


def test_collection_bwt():
    r = Random(3)
    strings = [bytes(r.choice(b"\x00ab") for _ in range(r.randint(1, 30))) for _ in range(20)]
    bwt, lcp, place = suffix_dedup.collection_bwt(strings, 10)
    string, offset = suffix_dedup.suffixes(bwt, place, np.array([len(x) for x in strings]))
    order = [(strings[a][b:], a) for a, b in zip(string, offset, strict=True)]
    assert [x for x, _ in order] == sorted(x for x, _ in order)
    for k in range(1, len(order)):
        a, b = order[k - 1][0], order[k][0]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(same, 10)
