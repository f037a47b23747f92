import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scanloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 4 <> 0"), F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert len(got) == docs.count()
    test = labels.where("doc_id % 4 = 0").collect()
    right = np.mean([(got[r.doc_id].score >= 0.5) == bool(r.quality) for r in test])
    caught = np.mean([got[r.doc_id].toxic_score >= 0.5 for r in test if r.toxic])
    false = np.mean([got[r.doc_id].toxic_score >= 0.5 for r in test if not r.toxic])
    print("quality", right, "toxic recall", caught, "false", false)
    assert right > 0.98 and caught > 0.78 and false < 0.02


def test_posteriors_shrink(spark):
    """Sparse sites stay near their parents, large ones near their own rate; brute force in Python agrees."""
    rows = [("big", f"big/{k % 2}", 2.0 if k % 10 else -2.0) for k in range(600)] + [("bad", "bad/0", -3.0)] * 300 + [("tiny", "tiny/0", -3.0)] + [(None, None, 1.0)] * 5
    got = {(r.host, r.path): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    p = lambda e: 1 / (1 + np.exp(-e))
    hosts = {}
    for h, _, e in rows:
        hosts.setdefault(h, []).append(p(e))
    rate = np.mean([x for v in hosts.values() for x in v])
    n = np.array([len(v) for v in hosts.values()])
    r = np.array([np.mean(v) for v in hosts.values()])
    between = max((n * (r - rate) ** 2).sum() / n.sum() - len(n) * rate * (1 - rate) / n.sum(), 1e-6)
    k = min(max(rate * (1 - rate) / between - 1, 1), 1e6)
    for h, v in hosts.items():
        assert abs(next(x.host_rate for (a, _), x in got.items() if a == h) - (sum(v) + k * rate) / (len(v) + k)) < 1e-9
    tiny, bad = got[("tiny", "tiny/0")], got[("bad", "bad/0")]
    assert bad.path_rate < 0.1 and abs(tiny.path_rate - tiny.host_rate) < abs(tiny.path_rate - p(-3.0))


def test_whole_query_against_plain_python(spark):
    """Evidence from the heads, sites by plain sums, scores by the formula: each document without its own part in them."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    got = {r.doc_id: r for r in quality.classify(docs, labels, host, path).collect()}
    good, bad = quality.train(docs, labels)
    rows = docs.select("doc_id", "text", host.alias("h"), path.alias("p")).collect()
    sig = lambda z: 1 / (1 + np.exp(-z))
    p, toxic = {}, {}
    for r in rows:
        raw, off = quality.tk.utf8(pa.array([r.text], pa.string()))
        f = quality.features(raw, off)
        p[r.doc_id], toxic[r.doc_id] = (sig(np.clip(h.logits(*f)[0], -12, 12)) for h in (good, bad))
    groups = lambda key: {k: [r.doc_id for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = groups(lambda r: r.h), groups(lambda r: (r.h, r.p))
    rate = np.mean(list(p.values()))

    def strength(sites, centre):
        n = {k: len(v) for k, v in sites.items()}
        total = sum(n.values())
        spread = sum(n[k] * (np.mean([p[d] for d in v]) - centre(k)) ** 2 for k, v in sites.items()) / total
        noise = sum(centre(k) * (1 - centre(k)) for k in sites) / total
        mean = sum(n[k] * centre(k) * (1 - centre(k)) for k in sites) / total
        return min(max(mean / max(spread - noise, 1e-6) - 1, 1.0), 1e6)

    k_host = strength(hosts, lambda k: rate)
    of_host = {k: (sum(p[d] for d in v) + k_host * rate) / (len(v) + k_host) for k, v in hosts.items()}
    k_path = strength(paths, lambda k: of_host[k[0]])
    for r in rows:
        own, mine = p[r.doc_id], paths[(r.h, r.p)]
        others = (sum(p[d] for d in mine) - own + k_path * of_host[r.h]) / (len(mine) - 1 + k_path)
        score = sig(np.log(own / (1 - own)) + np.log(others / (1 - others)) - np.log(rate / (1 - rate)))
        x = got[r.doc_id]
        assert abs(x.score - score) < 1e-6 and abs(x.host_rate - of_host[r.h]) < 1e-9 and abs(x.toxic_score - toxic[r.doc_id]) < 1e-9
        assert x.keep == (x.score >= 0.5 and x.toxic_score < 0.5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (2, "", "h", 1), (None, "good words here", "h", 1), (3, "x" * 100_000, "h", 1)], "doc_id long, text string, source string, score int")
    none = spark.createDataFrame([(1, None, None), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none, F.col("source"), F.col("source")).collect()
    assert len(got) == 5 and all(abs(r.score - 0.5) < 0.51 and r.toxic_score < 0.5 for r in got)
    assert quality.classify(docs.where("false"), none, F.col("source"), F.col("source")).count() == 0
