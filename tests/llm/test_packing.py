from collections import Counter
from random import Random

from scanloom.llm import packing


def plain(pieces, capacity, per_source):
    residual, held, out = [], [], []
    for n, s, c in pieces:
        fits = [(residual[b], b) for b in range(len(residual)) if residual[b] >= n and (s is None or sum(x[0] == s for x in held[b]) < per_source) and (c is None or all(x[1] != c for x in held[b]))]
        b = min(fits)[1] if fits else len(residual)
        if not fits:
            residual.append(capacity)
            held.append([])
        residual[b] -= n
        held[b].append((s, c))
        out.append(b)
    return out


def test_best_fit_is_the_tightest_compatible():
    for seed in range(30):
        r = Random(seed)
        pieces = [(r.choice([r.randint(1, 100), 100]), r.choice([None, "a", "a", "a", "b", r.randint(0, 9)]), r.choice([None, 7, 7, r.randint(0, 50)])) for _ in range(r.choice([1, 50, 400]))]
        pieces.sort(key=lambda x: -x[0])
        for per in (1, 2):
            assert packing.best_fit(pieces, 100, per) == plain(pieces, 100, per)


def test_pack(spark):
    r = Random(1)
    rows = [(None, "a b c", "s", 1), (1, None, "s", 1), (2, "", None, 1), (3, "w " * 700, "s0", 1), (3, "w " * 700, "s0", 1), (4, "x " * 100, None, 1)]
    rows += [(d, "y " * r.randint(1, 90) + str(r.randint(0, 3)), r.choice(["s0", "s0", "s1", "s2"]), 1) for d in range(10, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int").repartition(4)
    out = packing.pack(df, 100, 2).collect()
    want = Counter((d, max(1, -(-len((t or "").split()) // 100))) for d, t, _, _ in rows)
    assert sum(k * n for (_, k), n in want.items()) == len(out)
    text = {}
    for d, t, s, _ in rows:
        text.setdefault(d, (t, s))
    bins = {}
    for x in out:
        if x.bin is None:
            assert x.n_words == 0
        else:
            bins.setdefault(x.bin, []).append(x)
    for members in bins.values():
        assert sum(x.n_words for x in members) == members[0].bin_words <= 100
        assert max(Counter(text[x.doc_id][1] for x in members if text[x.doc_id][1]).values(), default=0) <= 2
        assert max(Counter(text[x.doc_id][0] for x in members).values()) == 1
    assert packing.pack(df.where("false")).count() == 0
