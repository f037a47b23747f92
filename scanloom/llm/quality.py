"""Quality classification by hierarchical empirical Bayes.

A document classifier (logistic regression on hashed words and on the make-up of the text) gives evidence for each
document. Sites are estimated from it: expected good documents are summed by path, paths by host, hosts over all. The
spread of hosts, and of paths inside their hosts, beyond what sampling explains gives the strength of each level's
prior by the method of moments; a host's posterior is shrunk towards the global rate and a path's towards its host's, the
more the fewer documents they have. A document's score is its evidence, in log-odds, moved by its path's posterior
against the global rate; of that posterior the document itself is no part, so its evidence counts once. A second head with the same features finds toxic documents; those are not kept.

Aggregation is by (host, path), with partial sums before the shuffle; the posteriors are joined back to rows of a
document's id and evidence, a join that adaptive execution can split, so a host may hold any share of the documents.

Defined results: a null host or path is a site of its own; a null or empty text has the evidence of its features;
labels that are null, or of documents that are not there, teach nothing; without labels of both kinds the evidence is even
(0.5) and nothing is toxic; repeated rows count each in the sites and teach once; different labels of a document teach each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging
from scanloom.llm import textkernel as tk

#: At most so many labelled documents are fitted on, whole: those whose ids have the smallest hashes.
SAMPLE = 8000
WORDS = 1 << 16
SHAPE = 12
#: Words that fewer labelled documents have teach nothing; of few labelled documents a hundredth is enough.
LEAST = 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (bucket, document, value) and SHAPE dense numbers of each document of a block."""
    n = len(off) - 1
    starts, ends, first = tk.word_bounds(raw, off, "alnum")
    h = tk.span_hashes(raw, starts, ends, lower=True)
    doc = np.repeat(np.arange(n), np.diff(first))
    code = doc.astype(np.int64) * WORDS + (h >> np.uint64(48)).astype(np.int64)
    code = np.unique(code)
    d, b = code // WORDS, code % WORDS
    value = np.ones(len(b))  # one bad word counts the same in a long text
    size, words = np.maximum(np.diff(off), 1), np.diff(first)
    by_doc = np.repeat(np.arange(n), np.diff(off))
    share = lambda table: np.bincount(by_doc, table[raw], n) / size
    distinct = np.bincount(d, minlength=n)
    length = np.bincount(doc, ends - starts, n) / np.maximum(words, 1)
    line = raw == 10
    lines = np.bincount(by_doc, line, n) + 1
    again = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:], same, n) / np.maximum(words, 1)
    shape = np.stack([np.ones(n), np.log1p(words) / 5, length / 5, share(_UPPER) * 5, share(_DIGIT) * 20, share(_PUNCT) * 5, distinct / np.maximum(words, 1), np.log1p(lines) / 3, again * 5, (words < 20).astype(float), words / size * 5, share(raw_high) * 5], 1)
    return b, d, value, shape


raw_high = np.arange(256) >= 128


class Head:
    def __init__(self, w: np.ndarray, v: np.ndarray) -> None:
        self.w, self.v = w, v

    def logits(self, b: np.ndarray, d: np.ndarray, value: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return np.bincount(d, self.w[b] * value, len(shape)) + shape @ self.v


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, passes: int = 12, l1: float = 1e-3, even: float = 0.7) -> Head | None:
    """Logistic regression by AdaGrad, the rarer kind weighing more (even: 0 as often as it is, 1 as much as
    the other), with an L1 penalty on words; None if a kind is missing."""
    if not len(y) or y.min() == y.max():
        return None
    often = np.bincount(np.concatenate([r[0] for r in rows]), minlength=WORDS) >= min(LEAST, 1 + len(y) // 100)
    rows = [(b[often[b]], v[often[b]], s) for b, v, s in rows]
    w, v = np.zeros(WORDS), np.zeros(SHAPE)
    gw, gv = np.full(WORDS, 1e-6), np.full(SHAPE, 1e-6)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** even
    rng = np.random.default_rng(3)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 64):
            ks = order[a : a + 64]
            b = np.concatenate([rows[k][0] for k in ks])
            value = np.concatenate([rows[k][1] for k in ks])
            d = np.repeat(np.arange(len(ks)), [len(rows[k][0]) for k in ks])
            shape = np.stack([rows[k][2] for k in ks])
            z = np.bincount(d, w[b] * value, len(ks)) + shape @ v
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ks]) * weight[ks]
            at, where = np.unique(b, return_inverse=True)
            g = np.bincount(where, value * e[d], len(at)) / len(ks)
            h = shape.T @ e / len(ks)
            gw[at] += g * g
            gv += h * h
            rate = 0.3 / np.sqrt(gw[at])
            moved = w[at] - rate * g
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
            v -= 0.3 * h / np.sqrt(gv)
    return Head(w, v)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Head | None, Head | None]:
    """Heads for quality and toxicity."""
    marks = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    few = marks.orderBy(F.xxhash64("label_id"), "label_id", "quality", "toxic").limit(SAMPLE)
    # bounded by SAMPLE rows of three numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    # repeated documents teach once; should ids stand for more texts than the sample has room for, the order of all decides
    chosen = chosen.distinct().orderBy(F.xxhash64("label_id"), "label_id", "text", "quality", "toxic").limit(SAMPLE).repartition(16).select("text", "quality", "toxic")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            raw, off = tk.utf8(x.column("text"))
            for i, j in tk.blocks(off):
                b, d, value, shape = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = np.searchsorted(d, np.arange(j - i + 1))
                yield pa.record_batch({"b": pa.array([b[p:q].astype(np.int32).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "v": pa.array([value[p:q].astype(np.float32).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "s": pa.array([s.tobytes() for s in shape], pa.binary()), "quality": x.column("quality").slice(i, j - i), "toxic": x.column("toxic").slice(i, j - i)})

    got = chosen.mapInArrow(vectors, "b binary, v binary, s binary, quality int, toxic int").collect()
    got.sort(key=lambda r: (r.b, r.s, r.quality or 0, r.toxic or 0))  # the same model whatever order rows come in
    rows = [(np.frombuffer(r.b, np.int32), np.frombuffer(r.v, np.float32).astype(float), np.frombuffer(r.s, float)) for r in got]
    heads = []
    for name in ("quality", "toxic"):
        at = [k for k, r in enumerate(got) if r[name] is not None]
        heads.append(fit([rows[k] for k in at], np.array([float(got[k][name] > 0) for k in at])))
    return heads[0], heads[1]


def evidence(docs: DataFrame, heads: tuple[Head | None, Head | None]) -> DataFrame:
    """(doc_id, host, path, evidence, toxic): log-odds of each document alone."""
    cast = docs.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = cast.value
        for x in batches:
            raw, off = tk.utf8(x.column("text"))
            e, t = [], []
            for i, j in tk.blocks(off, 1 << 20):
                f = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                e.append(np.clip(good.logits(*f), -12, 12) if good else np.zeros(j - i))
                t.append(np.clip(bad.logits(*f), -12, 12) if bad else np.full(j - i, -12.0))
            yield pa.record_batch({"doc_id": x.column("doc_id"), "host": x.column("host"), "path": x.column("path"), "evidence": pa.array(np.concatenate(e)), "toxic": pa.array(np.concatenate(t))})

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, evidence double, toxic double")


def _strength(good: Column, n: Column, centre: Column) -> Column:
    """Concentration of a beta prior over groups with expected good documents `good` of n around a centre."""
    rate = good / n
    spread = F.sum(n * (rate - centre) * (rate - centre)) / F.sum(n)
    noise = F.sum(centre * (1 - centre)) / F.sum(n)  # what sampling alone explains
    between = F.greatest(spread - noise, F.lit(1e-6))
    mean = F.sum(n * centre * (1 - centre)) / F.sum(n)
    return F.least(F.greatest(mean / between - 1, F.lit(1.0)), F.lit(1e6))


def posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, good, n, strength, host_rate, path_rate, global_rate) from rows with host, path and evidence."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = rows.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    whole = hosts.agg(F.sum("host_good").alias("g"), F.sum("host_n").alias("c")).first()
    rate = min(max((whole.g / whole.c) if whole.c else 0.5, 1e-4), 1 - 1e-4)
    k_host = hosts.agg(_strength(F.col("host_good"), F.col("host_n"), F.lit(rate))).first()[0] or 1.0
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host))
    both = paths.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).select("host", "path", "good", "n", "host_rate")
    k_path = both.agg(_strength(F.col("good"), F.col("n"), F.col("host_rate"))).first()[0] or 1.0
    return both.select("host", "path", "good", "n", F.lit(float(k_path)).alias("strength"), "host_rate", ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"), F.lit(rate).alias("global_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, toxic_score and keep of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    # ids and evidence, written once: sites, their strengths and the scores all read it
    rows = staging.staged(evidence(docs, train(docs, labels)), "evidence")
    sites = posteriors(rows).toDF("h", "p", "good", "n", "strength", "host_rate", "path_rate", "global_rate")
    both = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    odds = lambda c: F.log(c / (1 - c))
    own = 1 / (1 + F.exp(-F.col("evidence")))
    others = (F.col("good") - own + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    safe = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    score = 1 / (1 + F.exp(-(F.col("evidence") + odds(safe) - odds(F.col("global_rate")))))
    toxic = 1 / (1 + F.exp(-F.col("toxic")))
    out = both.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), toxic.alias("toxic_score"))
    return out.withColumn("keep", (F.col("score") >= 0.5) & (F.col("toxic_score") < 0.5))
