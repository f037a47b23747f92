"""Normals and neighbourhood features from k-nearest or radius neighbourhoods.

Neighbourhoods meet as moments: a group's sums are nine numbers whatever its size, and the 3x3 eigenproblems of a batch
are solved together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import columns, spatial

COVARIANCES = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def moments(pairs: DataFrame, *by: str) -> DataFrame:
    """Population covariance of the model points of each probe."""
    some = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return pairs.groupBy("pid", *by).agg(F.count("*").alias("n"), *[F.first(f"p{c}").alias(f"p{c}") for c in "xyz"], *[F.avg(f"m{c}").alias(f"avg_{c}") for c in "xyz"], *[F.covar_pop(f"m{a}", f"m{b}").alias(f"c{a}{b}") for a, b in some])


def eigen(grouped: DataFrame) -> DataFrame:
    """Adds e1 <= e2 <= e3 and the unit eigenvector (nx, ny, nz) of e1."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = pdf[list(COVARIANCES)].to_numpy(float)
            m = np.stack([c[:, [0, 1, 2]], c[:, [1, 3, 4]], c[:, [2, 4, 5]]], axis=1) if len(c) else np.zeros((0, 3, 3))
            w, v = np.linalg.eigh(m)
            yield pdf.assign(e1=np.maximum(w[:, 0], 0), e2=np.maximum(w[:, 1], 0), e3=np.maximum(w[:, 2], 0), nx=v[:, 0, 0], ny=v[:, 1, 0], nz=v[:, 2, 0])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema.fields)
    return grouped.mapInPandas(solve, f"{fields}, e1 double, e2 double, e3 double, nx double, ny double, nz double")


def away_from(normals: DataFrame, position: tuple[float, float, float]) -> DataFrame:
    """Turns normals away from the scanner."""
    sign = F.when(g.dot(("nx", "ny", "nz"), g.sub(("px", "py", "pz"), position)) < 0, -1.0).otherwise(1.0)
    return normals.withColumns({n: F.col(n) * sign for n in ("nx", "ny", "nz")})


def upward(normals: DataFrame) -> DataFrame:
    return normals.withColumns({n: F.col(n) * F.when(F.col("ny") < 0, -1.0).otherwise(1.0) for n in ("nx", "ny", "nz")})


def normals(points: DataFrame, k: int, radius: float, position: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """A normal for each point from its k nearest in its scan below the radius, itself among them."""
    near = spatial.k_nearest_within(spatial.as_probe(points, "scan_id"), spatial.as_model(points, "scan_id"), k, radius, by=("scan_id",))
    return away_from(eigen(moments(near, "scan_id")), position)


def nearest_moments(points: DataFrame, k: int, radius: float, then: Callable[[DataFrame], DataFrame] = lambda m: m) -> DataFrame:
    """moments() of the k nearest of each point in its scan at any distance, itself among them; a scan with fewer points
    gives all it has. The radius is where the search begins and changes no result. then: what is made of the moments row by
    row; it is done once for the copies at a place.

    The search goes over places with their number of points. Where a place has k of them, they are the k nearest."""
    by = ("scan_id",)
    model = spatial.as_model(points, *by)
    if dense := columns.told_apart(spatial.as_probe(points, *by), model, k, by):
        found, told, others = dense
        near = columns.nearest_moments(told, k, found, *by)
        return then(near if others is None else near.unionByName(moments(spatial.k_nearest(others, model, k, radius, by), *by)))
    places = model.groupBy(*spatial.M, *by).agg(F.count("*").alias("copies")).withColumn("pid", F.monotonically_increasing_id()).checkpoint()
    asked = places.withColumns({f"p{c}": F.col(f"m{c}") for c in "xyz"}).drop(*spatial.M)

    def search(probe: DataFrame) -> DataFrame:
        return moments(spatial.k_nearest_places(probe.drop("copies"), places.drop("pid"), model, k, radius, by), *by)

    def answer(probe: DataFrame) -> DataFrame:
        if "copies" not in probe.columns:
            return then(search(probe))
        full = probe.where(F.col("copies") >= k)
        none = {f"c{a}{b}": F.lit(0.0) for i, a in enumerate("xyz") for b in "xyz"[i:]}
        same = full.select("pid", *by, F.lit(k).cast("long").alias("n"), *spatial.P, *[F.col(f"p{c}").alias(f"avg_{c}") for c in "xyz"], *[v.alias(c) for c, v in none.items()])
        others = probe.where(F.col("copies") < k)
        return then(same if others.isEmpty() else same.unionByName(search(others)))

    return spatial.by_place(spatial.as_probe(points, *by), answer, by, places=asked)


def panorama_normals(located: DataFrame, height: int, width: int, position: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """A normal for each pixel (scan_id, row, col) of a panorama with all its points (x, y, z, range): from the points of
    the pixel and of the four beside it, where they are at least three. (px, py, pz) is the pixel's farthest point.

    A pixel's points meet as counts, means and covariances, and those of five pixels are put together around their common
    mean: plain sums of squares lose digits with the number of points."""
    key = ["scan_id", "row", "col"]
    some = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    cells = located.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("range", "point_id", "x", "y", "z")).alias("own"), *[F.avg(c).alias(f"u{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in some])
    beside = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    parts = ["n", *[f"u{c}" for c in "xyz"], *COVARIANCES]
    spread = cells.withColumn("o", F.explode(beside)).select("scan_id", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), *parts)
    total = spread.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy(*key).agg(F.sum("n").alias("n"), F.collect_list(F.struct(*parts)).alias("parts"))
    over = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, q: s + q["n"] * f(q)) / F.col("n")
    total = total.withColumns({f"u{c}": over(lambda q, c=c: q[f"u{c}"]) for c in "xyz"})
    total = total.withColumns({f"c{a}{b}": over(lambda q, a=a, b=b: q[f"c{a}{b}"] + (q[f"u{a}"] - F.col(f"u{a}")) * (q[f"u{b}"] - F.col(f"u{b}"))) for a, b in some})
    both = total.join(cells.select(*key, F.col("own.point_id").alias("pid"), *[F.col(f"own.{c}").alias(f"p{c}") for c in "xyz"]), key).where("n >= 3")
    return away_from(eigen(both.select(*key, "pid", "n", "px", "py", "pz", *COVARIANCES)), position)


def adaptive_normals(points: DataFrame, k_min: int, k_max: int, radius: float) -> DataFrame:
    """The first k for which the smallest eigenvalue exceeds a quarter of the next and the other two are within a
    quarter of one another, else k_max; neighbours are k and the point itself."""
    near = spatial.k_nearest_within(spatial.as_probe(points, "scan_id"), spatial.as_model(points, "scan_id"), k_max + 1, radius, by=("scan_id",))
    tried = near.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(k_min), F.col("rank") - 1), F.lit(k_max))))
    each = eigen(moments(tried, "scan_id", "k"))
    passes = (F.col("e1") > 0.25 * F.col("e2")) & (F.abs(1 - F.col("e2") / F.nullif("e3", F.lit(0.0))) < 0.25)
    order = F.when(F.coalesce(passes, F.lit(False)), F.col("k")).when(F.col("k") == k_max, k_max + 1)
    best = each.withColumn("o", order).where("o is not null").groupBy("scan_id", "pid").agg(F.min(F.struct("o", "k", "n", "e1", "e2", "e3", "nx", "ny", "nz")).alias("b"))
    return best.select("scan_id", "pid", "b.k", "b.n", "b.e1", "b.e2", "b.e3", "b.nx", "b.ny", "b.nz")


def optimal_k(points: DataFrame, k_min: int, k_max: int, step: int, radius: float) -> DataFrame:
    """The neighbourhood size of least eigenentropy for each point."""
    near = spatial.k_nearest_within(spatial.as_probe(points, "scan_id"), spatial.as_model(points, "scan_id"), k_max, radius, by=("scan_id",))
    sizes = F.array(*[F.lit(k) for k in range(k_min, k_max + 1, step)])
    tried = near.withColumn("k", F.explode(F.filter(sizes, lambda k: k >= F.col("rank"))))
    e = shape_features(eigen(moments(tried, "scan_id", "k")))
    return e.groupBy("scan_id", "pid").agg(F.min_by("k", F.struct("eigenentropy", "k")).alias("k"))


def shape_features(e: DataFrame) -> DataFrame:
    """Closed forms over eigenvalues: linear, planar and scattered shares and their relatives, and verticality."""
    total = F.nullif(F.col("e1") + F.col("e2") + F.col("e3"), F.lit(0.0))
    share = [F.col(c) / total + 2.220446049250313e-16 for c in ("e3", "e2", "e1")]
    top = F.nullif("e3", F.lit(0.0))
    return e.withColumns({
        "linearity": (F.col("e3") - F.col("e2")) / top, "planarity": (F.col("e2") - F.col("e1")) / top, "scattering": F.col("e1") / top,
        "omnivariance": F.cbrt(F.col("e1") * F.col("e2") * F.col("e3")), "anisotropy": (F.col("e3") - F.col("e1")) / top,
        "eigenentropy": -(share[0] * F.log(share[0]) + share[1] * F.log(share[1]) + share[2] * F.log(share[2])),
        "eigen_sum": F.col("e1") + F.col("e2") + F.col("e3"), "curvature": F.col("e1") / total, "verticality": 1 - F.abs("ny"),
    })


def density_parts(pairs: DataFrame, copies: str | None = None) -> DataFrame:
    """Per probe what density_features() takes from its neighbours, of which a row stands for so many at one place as the
    column `copies` says: numbers that can be put together over several places of a probe."""
    flat2 = F.pow(F.col("mx") - F.col("px"), 2) + F.pow(F.col("mz") - F.col("pz"), 2)
    up = F.col("my") - F.col("py")
    each = F.col(copies) if copies else F.lit(1)
    sums = [F.sum(each).alias("n"), F.sum(each * up).alias("up"), F.sum(each * up * up).alias("up2")]
    return pairs.groupBy("pid").agg(*sums, F.max("d2").alias("d2"), F.max(flat2).alias("flat2"), F.min("my").alias("low"), F.max("my").alias("high"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """density_parts() of ids from those of their places, which count `times` times."""
    sums = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n", "up", "up2")]
    return parts.groupBy("pid").agg(*sums, *[F.max(c).alias(c) for c in ("d2", "flat2", "high")], F.min("low").alias("low"))


def densities(parts: DataFrame) -> DataFrame:
    """Count, radius, density, height range and variance, and their plane twins."""
    variance = F.greatest(F.col("up2") / F.col("n") - F.pow(F.col("up") / F.col("n"), 2), F.lit(0.0))
    out = parts.select("pid", "n", F.sqrt("d2").alias("radius"), (F.col("high") - F.col("low")).alias("height_range"), variance.alias("height_variance"), F.sqrt("flat2").alias("radius_2d"))
    return out.withColumns({"density": F.col("n") / F.nullif(4 / 3 * F.pi() * F.pow("radius", 3), F.lit(0.0)), "density_2d": F.col("n") / F.nullif(F.pi() * F.pow("radius_2d", 2), F.lit(0.0))})


def density_features(pairs: DataFrame, copies: str | None = None) -> DataFrame:
    """Per probe, from its neighbours: count, radius, density, height range and variance, and their plane twins. A row
    stands for so many neighbours at one place as the column `copies` says."""
    return densities(density_parts(pairs, copies))


def column_features(points: DataFrame, radius: float) -> DataFrame:
    """Per point, over all points nearer than the radius to the vertical line through it: count, height range and
    variance, and its height above the lowest. A grid join in the plane: the vertical is put aside."""
    flat = lambda p: p.withColumn("h", F.col("y")).withColumn("y", F.lit(0.0))
    p = spatial.as_probe(flat(points), "scan_id", F.col("h").alias("ph"))
    m = spatial.as_model(flat(points), "scan_id", F.col("h").alias("mh"))
    near = spatial.pairs(p, m, radius, by=("scan_id",))
    return near.groupBy("scan_id", "pid").agg(F.count("*").alias("n"), (F.max("mh") - F.min("mh")).alias("height_range"), F.var_pop("mh").alias("height_variance"), (F.first("ph") - F.min("mh")).alias("height_above"))
