"""Approximate nearest neighbours with balanced posting lists.

Equal vectors are one point that knows its smallest ids, more than any answer can show. Centroids are fitted on a
bounded sample by k-means with a penalty on size, so that lists come out balanced. A point near a boundary is replicated
to several lists: those not much farther than its nearest, unless a list already chosen has nearly the same centroid.
Centroids are found by best-first search in an in-memory neighbour graph of bounded size, for points and queries alike; a
query visits the lists whose centroid is not farther than RATIO times its nearest. Every point is
indexed. Lists longer than PART points are split, so that a task holds at most PART points while queries stream past.

Scores are Euclidean distances of the original vectors in double precision; where squares would overflow or vanish, the
differences are first divided by the largest. Lists are found with single precision; if the largest component is very
large or small, with all vectors divided by a power of two near it and in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the most common one (of equally common ones the smaller), nor null ids; rows that repeat an id with the
same vector count once; ties go to the smaller id; fewer than k other vectors give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging

#: The sample that centroids are fitted on, points a list should have, most centroids, and most numbers in all centroids.
SAMPLE, LIST, CENTROIDS, NUMBERS = 20_000, 192, 8192, 4 << 20
#: Most lists of a point, how much farther than the nearest they may be; most lists of a query, and its ratio.
REPLICAS, CLOSURE, PROBES, RATIO = 6, 1.4, 72, 1.5
#: A list is as good as one already chosen if their centroids are nearer than this share of the point's distance.
ALIKE = 0.2
#: Points of a list that one task holds, and groups that a vector's ids first meet in.
PART, SALTS = 2048, 512


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, weight: float = 0.5) -> np.ndarray:
    """k-means in which a list that is over its share costs more."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        size = np.zeros(k)
        own = np.empty(len(x), np.int64)
        scale = None
        for a in range(0, len(x), 512):
            d = _distances(x[a : a + 512], c)
            scale = scale or float(d.min(axis=1).mean()) + 1e-300
            own[a : a + 512] = (d + weight * scale * np.maximum(size / (len(x) / k) - 1, 0)).argmin(axis=1)
            size += np.bincount(own[a : a + 512], minlength=k)
        total = np.zeros_like(c, np.float64)
        np.add.at(total, own, x)
        full = size > 0
        c[full] = (total[full] / size[full, None]).astype(c.dtype)
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class Graph:
    """A neighbour graph of the centroids and best-first search in it, for many points at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 32, entries: int = 48) -> None:
        self.c = centroids
        k = len(centroids)
        rng = np.random.default_rng(7)
        links: list[list[int]] = [[] for _ in range(k)]
        for a in range(0, k, 1024):
            d = _distances(centroids[a : a + 1024], centroids)
            for n, row in enumerate(d):
                links[a + n] = self._pruned(a + n, row, rng, degree)
        for n in range(k):  # links both ways keep every centroid within reach
            for o in list(links[n]):
                if n not in links[o] and len(links[o]) < 2 * degree:
                    links[o].append(n)
        width = max(map(len, links), default=1) or 1
        self.near = np.array([(x + [n] * width)[:width] for n, x in enumerate(links)], np.int64)  # oneself fills up
        self.entries = np.unique(np.linspace(0, k - 1, min(k, entries)).astype(np.int64))

    def _pruned(self, n: int, row: np.ndarray, rng: np.random.Generator, degree: int) -> list[int]:
        """Near centroids in different directions, and some far ones: one is left out if a nearer one already chosen is
        clearly nearer to it than n is."""
        k = len(row)
        some = np.argsort(row)[: min(k, 256)] if k <= 512 else np.unique(np.r_[np.argpartition(row, 256)[:256], rng.integers(0, k, 128)])
        some = some[np.argsort(row[some], kind="stable")]
        some = some[some != n]
        out: list[int] = []
        left = np.ones(len(some), bool)
        while left.any() and len(out) < degree:
            o = some[np.argmax(left)]
            out.append(int(o))
            left &= 1.44 * _distances(self.c[[o]], self.c[some])[0] > row[some]
            left[some == o] = False
        for o in some:  # fill up with the nearest
            if len(out) >= degree // 2:
                break
            if int(o) not in out:
                out.append(int(o))
        return out

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the `width` nearest centroids found, nearest first; -1 where there are fewer."""
        n, width = len(x), min(width, len(self.c))
        d = _distances(x, self.c[self.entries])
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, dist = self.entries[order], np.take_along_axis(d, order, 1)
        if ids.shape[1] < width:
            pad = width - ids.shape[1]
            ids, dist = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        done = ids < 0
        for _ in range(4 * width + 8):
            pick = np.where(done, np.inf, dist).argmin(axis=1)
            rows = np.arange(n)
            if done[rows, pick].all():
                break
            new = self.near[np.maximum(ids[rows, pick], 0)]
            done[rows, pick] = True
            dn = np.maximum(((x[:, None, :] - self.c[new]) ** 2).sum(2), 0)
            seen = (new[:, :, None] == ids[:, None, :]).any(2)
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros_like(seen)
            ranked = np.take_along_axis(new, order, 1)
            np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            seen |= twice
            dn[seen] = np.inf
            every, dists, flags = np.concatenate([ids, new], 1), np.concatenate([dist, dn], 1), np.concatenate([done, seen], 1)
            order = np.argsort(dists, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(z, order, 1) for z in (every, dists, flags))
            done |= ~np.isfinite(dist)
        return np.where(np.isfinite(dist), ids, -1), dist

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each point goes to."""
        ids, d = self.search(x, 24)
        out = []
        for row, dist in zip(ids, d, strict=True):
            chosen: list[int] = []
            for k, c in enumerate(row.tolist()):
                if c < 0 or dist[k] > dist[0] * CLOSURE**2 or len(chosen) >= REPLICAS:
                    break
                if all(((self.c[c] - self.c[o]) ** 2).sum() >= ALIKE**2 * dist[k] for o in chosen):
                    chosen.append(c)
            out.append(np.array(chosen or [int(row[0])]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def points_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(points: key, vector, ids, the k + 1 smallest; queries: query_id, key) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    v = v.where(F.size("v") == (common.d if common else 0))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v")) + 0.0  # -0.0 is 0.0
            yield pa.record_batch({"vec_id": b.column("vec_id"), "key": pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in m], pa.binary()), "v": b.column("v")})

    rows = v.mapInArrow(keyed, "vec_id long, key binary, v array<double>")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each vector of a batch, its smallest ids: copies do not travel."""
        for b in batches:
            ids: dict[bytes, list[int]] = {}
            first: dict[bytes, int] = {}
            for n, (i, key) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("key").to_pylist(), strict=True)):
                first.setdefault(key, n)
                ids.setdefault(key, []).append(i)
            yield pa.record_batch({"key": pa.array(list(ids), pa.binary()), "ids": pa.array([sorted(set(x))[: k + 1] for x in ids.values()], pa.list_(pa.int64())), "v": b.column("v").take(pa.array(list(first.values())))})

    def least(d: DataFrame, *by) -> DataFrame:
        return d.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("v").alias("v"))

    # two steps: what batches have of a vector that a large share of the rows has does not meet in one task
    merged = least(least(rows.mapInArrow(combined, "key binary, ids array<long>, v array<double>"), "key", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt")), "key")
    return staging.staged(merged, "points"), rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "key").distinct()


def lengths(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, whatever their size."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((d * d).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
    if len(odd):
        top = np.abs(d[odd]).max(axis=1, initial=0)
        safe = np.where(top > 0, top, 1)
        out[odd] = np.sqrt(((d[odd] / safe[:, None]) ** 2).sum(axis=1)) * top
    return out


@dataclass(frozen=True)
class Scale:
    """How vectors are written for the search of lists."""

    exponent: int
    kind: type

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return (np.ldexp(v, -self.exponent) if self.exponent else v).astype(self.kind)


def scale_of(top: float) -> Scale:
    return Scale(0, np.float32) if 1e-12 < top < 1e15 else Scale(math.frexp(top)[1], np.float64)


def fitted(points: DataFrame) -> tuple[Graph, Scale] | None:
    """The graph of the centroids, from points of the smallest hashes; all of it is bounded by SAMPLE and NUMBERS."""
    whole = points.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if not whole.n:
        return None
    n, scale = whole.n, scale_of(whole.top)
    rank = F.xxhash64("key")
    rows = points.select(rank.alias("h"), "key", "v").orderBy("h", "key").limit(SAMPLE).collect()
    x = scale(np.array([r.v for r in rows]))
    k = max(1, min(math.ceil(n / LIST), CENTROIDS, NUMBERS // x.shape[1], max(1, len(x) // 8)))
    return Graph(balanced_centroids(x, k)), scale


def search(vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: of each vector whose id is divisible by 100, the k nearest others found."""
    spark = vectors.sparkSession
    points, queries = points_of(vectors, k)
    fit = fitted(points)
    if fit is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph, scale = fit
    cast = spark.sparkContext.broadcast(graph)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, 512) for x in batches for a in range(0, x.num_rows, 512)):
            lists = cast.value.lists(scale(_matrix(b.column("v"))))
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in lists]))
            yield pa.record_batch({"list": pa.array(np.concatenate(lists).astype(np.int32)), "key": b.column("key").take(at), "ids": b.column("ids").take(at), "v": b.column("v").take(at)})

    postings = staging.staged(points.select("key", "ids", "v").mapInArrow(post, "list int, key binary, ids array<long>, v array<double>"), "postings")
    sizes = {r.list: r.n for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row for each centroid
    parts = np.ones(len(graph.c), np.int32)
    for c, size in sizes.items():
        parts[c] = math.ceil(size / PART)
    split = spark.sparkContext.broadcast(parts)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, 256) for x in batches for a in range(0, x.num_rows, 256)):
            ids, d = cast.value.search(scale(_matrix(b.column("v"))), PROBES)
            wanted = (ids >= 0) & (d <= d[:, :1] * RATIO**2)
            wanted[:, : min(8, ids.shape[1])] |= ids[:, :8] >= 0
            row, col = np.nonzero(wanted)
            lists = ids[row, col]
            n = split.value[lists]
            again = np.repeat(np.arange(len(lists)), n)
            sub = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row[again])
            yield pa.record_batch({"list": pa.array(lists[again].astype(np.int32)), "sub": pa.array(sub.astype(np.int32)), "key": b.column("key").take(at), "v": b.column("v").take(at)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("list").to_numpy()
            lead = np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint64)[::2]
            sub = (lead % split.value[lists].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sub)], names=[*b.schema.names, "sub"])

    asked = queries.select("key").distinct().join(points, "key").select("key", "v").mapInArrow(visit, "list int, sub int, key binary, v array<double>")
    stored = postings.mapInArrow(place, "list int, key binary, ids array<long>, v array<double>, sub int")
    columns = ["list", "sub", "kind", "key", "ids", "v"]
    both = stored.withColumn("kind", F.lit(0)).select(columns).unionByName(asked.withColumn("kind", F.lit(1)).withColumn("ids", F.lit(None).cast("array<long>")).select(columns))
    dealt = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "sub").sortWithinPartitions("list", "sub", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ids = None, [], []
        x = None
        for b in (y.slice(a, 1024) for y in batches for a in range(0, y.num_rows, 1024)):
            name = b.column("list").to_numpy().astype(np.int64) << 32 | b.column("sub").to_numpy()
            kind = b.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if name[a] != here:
                    here, held, ids, x = name[a], [], [], None
                part = b.slice(a, z - a)
                if kind[a] == 0:
                    held.append(_matrix(part.column("v")))
                    ids += part.column("ids").to_pylist()
                    continue
                if not ids:
                    continue
                x = np.concatenate(held) if x is None else x
                count = np.array([len(i) for i in ids])
                flat = np.concatenate([np.array(i, np.int64) for i in ids])
                for key, q in zip(part.column("key").to_pylist(), _matrix(part.column("v")), strict=True):
                    d = np.repeat(lengths(x - q), count)
                    best = np.lexsort((flat, d))[: k + 1] if len(d) <= 4 * k else (lambda c: c[np.lexsort((flat[c], d[c]))[: k + 1]])(np.flatnonzero(d <= np.partition(d, k)[k]))
                    yield pa.record_batch({"key": pa.array([key] * len(best), pa.binary()), "vec_id": pa.array(flat[best]), "score": pa.array(d[best])})

    from pyspark.sql import Window

    found = dealt.mapInArrow(scan, "key binary, vec_id long, score double").groupBy("key", "vec_id").agg(F.min("score").alias("score"))
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    out = queries.join(near, "key").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
