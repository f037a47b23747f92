import math

import numpy as np
import pytest

from scanloom.llm import nearest


def brute(rows, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in nearest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    exact = {q: dict(v) for q, v in want.items()}
    recall = np.mean([len({x for x, _ in got[q]} & exact[q].keys()) / len(exact[q]) for q in want])
    print("recall", recall)
    assert recall >= 0.9
    assert all(abs(s - exact[q][x]) < 1e-12 for q, v in got.items() for x, s in v if x in exact[q])


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [0.0, 1.0]), (2, None), (200, [0.0, 0.0]), (300, [math.nan, 1.0]), (400, [math.inf, 1.0]), (500, [None, 1.0]), (None, [1.0, 1.0]), (600, [1.0, 2.0, 3.0]), (-100, [1.0, 0.0])]
    rows += [(k, [1.0, -0.0]) for k in range(1001, 1030)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = {}
    for r in nearest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert set(got) == {0, 100, -100}
    assert got[0] == [(x, 0.0) for x in (-100, 1, *range(1001, 1009))]
    assert got[-100] == [(x, 0.0) for x in (0, 1, *range(1001, 1009))]
    assert got[100] == [(x, round(math.sqrt(2), 9)) for x in (-100, 0, 1, *range(1001, 1008))]
    assert nearest.search(df.where("false")).count() == 0


def test_recall_without_clusters(spark):
    """Directions spread evenly are the hardest case: neighbours are in many lists."""
    x = np.random.default_rng(6).normal(size=(6000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([(k, v) for k, v in enumerate(x)])
    got = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {x for x, _ in v}) / 10 for q, v in want.items()]) >= 0.9


@pytest.mark.parametrize("factor", [1e20, 1e200, 1e-30, 1e-200])
def test_magnitudes(spark, factor):
    """Very large and very small finite vectors have their neighbours, with scores in proportion."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    of = lambda f: {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.search(spark.createDataFrame([(k, (v * f).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    got, plain = of(factor), of(1.0)
    assert len(got) == 30
    for k, (name, score) in plain.items():
        assert got[k][0] == name and abs(got[k][1] / factor / score - 1) < 1e-9
