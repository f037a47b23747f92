"""Aggregates over clouds and matched pairs; each is one partial and one final aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g

AXES = ("x", "y", "z")


def boxes(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in AXES for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def covariances(points: DataFrame, *by: str) -> DataFrame:
    """Population covariances, six of them, with counts and means."""
    some = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in AXES], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in some])


def weighted(copies: str | None) -> Callable[[Column | str], Column]:
    """The sum of a column; a row counts as often as the column `copies` says, if one is named."""
    return (lambda c: F.sum((F.col(c) if isinstance(c, str) else c) * F.col(copies))) if copies else F.sum


def pair_moments(pairs: DataFrame, *by: str, copies: str | None = None) -> DataFrame:
    """What every closed-form minimiser needs from pairs (m the fixed, p the moved point): count, sums, products. A row
    stands for so many pairs as the column `copies` says."""
    total = weighted(copies)
    sums = [total(f"{s}{c}").alias(f"s{s}{c}") for s in "mp" for c in AXES]
    products = [total(F.col(f"p{a}") * F.col(f"m{b}")).alias(f"p{a}m{b}") for a in AXES for b in AXES]
    products += [total(F.col(f"{s}{a}") * F.col(f"{s}{b}")).alias(f"{s}{a}{s}{b}") for s in "pm" for i, a in enumerate(AXES) for b in AXES[i:]]
    squares = [total(g.square([f"{s}{c}" for c in AXES])).alias(f"q{s}") for s in "mp"]
    d2 = g.square(g.sub([f"p{c}" for c in AXES], [f"m{c}" for c in AXES]))
    n = F.sum(copies) if copies else F.count("*")
    return pairs.groupBy(*by).agg(n.alias("n"), *sums, *products, *squares, total(d2).alias("d2"))


def gaussian_error(pairs: DataFrame, sigma: float, reach: float, *by: str) -> DataFrame:
    """Mean over pairs of a Gaussian of their squared distance, negative so that less is better."""
    import math

    return pairs.groupBy(*by).agg((F.sum(-0.39894228 * F.exp(F.col("d2") * (math.log(sigma) / reach**2))) / F.count("*")).alias("error"))


def height_features(points: DataFrame, edge: float) -> DataFrame:
    """Of vertical columns of a grid: count, height range and variance, and per point the height above the lowest."""
    return points.groupBy("scan_id", g.cell("x", edge).alias("cx"), g.cell("z", edge).alias("cz")).agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("height_range"), F.var_pop("y").alias("height_variance"), (F.avg("y") - F.min("y")).alias("height_above"))


def polar_cells(points: DataFrame, rings: float, sectors: int) -> DataFrame:
    """points with ring and sector of polar ground cells around the scanner."""
    sector = F.pmod(F.floor((F.atan2("z", "x") + F.pi()) / (2 * F.pi()) * sectors), F.lit(sectors))
    return points.withColumns({"ring": F.floor(F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")) / rings), "sector": sector})


def cell_features(points: DataFrame, rings: float, sectors: int, ground: float) -> DataFrame:
    """Of each polar cell: count, extremes and means, the sum of distances from the mean height, and whether its heights
    differ by more than `ground`, which makes it something that stands and no ground."""
    cell = ["scan_id", "ring", "sector"]
    located = polar_cells(points, rings, sectors)
    some = boxes(located, *cell)
    off = located.join(some.select(*cell, "avg_y"), cell).groupBy(*cell).agg(F.sum(F.abs(F.col("y") - F.col("avg_y"))).alias("delta_y"))
    return some.join(off, cell).withColumn("stands", F.col("max_y") - F.col("min_y") > ground)


def cluster_features(cells: DataFrame, *by: str) -> DataFrame:
    """Of clusters of cells with features: cells, points, extremes, the mean weighted by points, and the box's extents."""
    mean = [(F.sum(F.col(f"avg_{c}") * F.col("n")) / F.sum("n")).alias(f"avg_{c}") for c in AXES]
    out = cells.groupBy(*by).agg(F.count("*").alias("cells"), F.sum("n").alias("points"), *[f(f"{k}_{c}").alias(f"{k}_{c}") for c in AXES for k, f in (("min", F.min), ("max", F.max))], *mean)
    return out.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES})


def shares(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total)


def voxel_scans(points: DataFrame, edge: float) -> DataFrame:
    """Voxels with the scans that have a point there."""
    return points.groupBy(*[g.cell(c, edge).alias(f"v{c}") for c in AXES]).agg(F.array_sort(F.collect_set("scan_id")).alias("scans"), F.count("*").alias("n"))


def shared_voxels(points: DataFrame, edge: float) -> DataFrame:
    """(a, b, voxels): for scans a < b the number of voxels that both occupy. A voxel knows each scan once, so its
    pairs are bounded by the number of scans, not of points."""
    here = voxel_scans(points, edge).select(F.explode("scans").alias("a"), "scans")
    return here.select("a", F.explode(F.filter("scans", lambda s: s > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("voxels"))
