from random import Random

import numpy as np
import pytest

from scanloom.llm import jaccard_join


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(x), find(d)) for d, x in sets if d is not None)


def corpus(seed):
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 5)))
    boiler = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One two"), (4, "one"), (5, "x " * 300)]
    d = 6
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 30, 120]))] + (boiler if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 2, 40])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
            rows.append((d, r.choice([" ", "\n"]).join(w)))
            d += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, b"k") for d, t in rows], "doc_id long, text string, key binary").repartition(4)
    got = sorted(tuple(r) for r in jaccard_join.classes(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_signatures_meet():
    """Any two sets above the threshold share an entry, whatever the classes."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n, frequent = int(r.integers(1, 80)), r.random()
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[r.random(len(x)) < 0.95], r.integers(0, 1 << 63, 2, dtype=np.uint64)])
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common) or not common:
            continue
        of = lambda z: np.where((z >> np.uint64(20)) % np.uint64(1000) < np.uint64(int(frequent * 1000)), 5 + z % np.uint64(3), 1).astype(np.uint8)  # noqa: B023, E731
        assert len(np.intersect1d(jaccard_join.signatures(x, of(x), 80), jaccard_join.signatures(y, of(y), 80)))


def test_entries_follow_the_set():
    """A long text of frequent shingles has entries in proportion to its shingles, as one of rare ones has."""
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    often, rare = (jaccard_join.signatures(x, np.full(len(x), c, np.uint8), 80) for c in (9, 1))
    assert len(rare) <= len(x) and len(often) <= 6 * len(x)


def test_words_that_share_a_polynomial_hash(spark):
    """A Thue-Morse word and its complement are equal under any polynomial modulo 2**64, but are not the same word."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(2048))
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.classes(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_long_boilerplate(spark):
    """Very long texts of frequent shingles, with edits: links as in all pairs."""
    r = Random(4)
    base = [f"w{r.randrange(4000)}" for _ in range(20_000)]
    rows = []
    for d in range(24):
        w = list(base)
        for _ in range(r.choice([0, 50, 300, 900])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(d, " ".join(base[:40])) for d in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x) for x in jaccard_join.classes(df).collect()) == brute(rows)


def test_empty(spark):
    assert jaccard_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.classes(df).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]
