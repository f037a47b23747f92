"""Reduction of clouds by octree cells, directions and pixels.

The octree of a scan is never built: its leaf cell is a closed form of the scan's bounding box, one projection and one
group-by. With half-size S (largest half-extent plus one) and the depth d at which S / 2^d is at most the voxel size,
cells are cubes of edge 2 S / 2^d around the box's centre. A point on a split plane belongs to the upper cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g

XYZ = ("x", "y", "z")
CELL = ("scan_id", "ix", "iy", "iz")


def bounds(points: DataFrame) -> DataFrame:
    """One row for each scan: centre, half-size."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    half = F.greatest(*[(F.max(c) - F.min(c)) / 2 for c in XYZ]) + 1
    return points.groupBy("scan_id").agg(*[mid(c).alias(f"c{c}") for c in XYZ], half.alias("s"))


def depth(size: Column, voxel: float) -> Column:
    """By repeated halving, which has no rounding step at exact powers."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.struct(k.alias("k"), (size / F.pow(F.lit(2.0), k) <= voxel).alias("ok")))
    return F.element_at(F.filter(steps, lambda x: x["ok"]), 1)["k"]


def cells(points: DataFrame, voxel: float) -> DataFrame:
    """points with ix, iy, iz and the cell's edge and lower corner (x0, y0, z0). Bounds are a row a scan."""
    if voxel <= 0:
        raise ValueError("cells have a voxel size above 0")
    box = bounds(points).withColumn("d", depth(F.col("s"), voxel)).withColumn("edge", 2 * F.col("s") / F.pow(F.lit(2.0), F.col("d")))
    out = points.join(box, "scan_id")
    top = (F.pow(F.lit(2.0), F.col("d")) - 1).cast("long")
    low = {c: F.col(f"c{c}") - F.col("s") for c in XYZ}
    index = {f"i{c}": F.greatest(F.lit(0).cast("long"), F.least(top, F.floor((F.col(c) - low[c]) / F.col("edge")))) for c in XYZ}
    return out.withColumns({**index, **{f"{c}0": low[c] for c in XYZ}}).drop("cx", "cy", "cz", "s", "d")


def reduced(points: DataFrame, voxel: float, mode: str = "center", n: int = 1, seed: int = 0) -> DataFrame:
    """Points (scan_id, x, y, z) of a reduction: "center", "average" or "random" with n points a cell. A voxel size of 0
    or less reduces nothing."""
    if voxel <= 0:
        return points
    if mode == "center":
        return centers(points, voxel).select("scan_id", *XYZ)
    if mode == "average":
        return averages(points, voxel).select("scan_id", *XYZ)
    if mode != "random":
        raise ValueError(f"no such reduction: {mode}")
    return (random_one(points, voxel, seed) if n == 1 else random_n(points, voxel, n, seed)).select(*points.columns)


def centers(points: DataFrame, voxel: float) -> DataFrame:
    """One point in the middle of each occupied cell; attributes have no meaning there and are left out."""
    grouped = cells(points, voxel).groupBy(*CELL).agg(*[F.first(x).alias(x) for x in ("edge", "x0", "y0", "z0")])
    return grouped.select(*CELL, *[(F.col(f"{c}0") + (F.col(f"i{c}") + 0.5) * F.col("edge")).alias(c) for c in XYZ])


def averages(points: DataFrame, voxel: float, attributes: tuple[str, ...] = ()) -> DataFrame:
    return cells(points, voxel).groupBy(*CELL).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*XYZ, *attributes)])


def lottery(seed: int = 0) -> Column:
    """A repeatable rank for drawing points: an arithmetic hash of the id."""
    return F.pmod(F.pmod(F.col("point_id") + seed, F.lit(1000003)) * 48271, F.lit(2147483647))


def random_n(points: DataFrame, voxel: float, n: int, seed: int = 0) -> DataFrame:
    """n points of each cell, or all that it has."""
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(lottery(seed), "point_id"))
    return cells(points, voxel).withColumn("rank", rank).where(F.col("rank") <= n).drop("rank", "edge", "x0", "y0", "z0")


def random_one(points: DataFrame, voxel: float, seed: int = 0) -> DataFrame:
    """One point of each cell, with partial minima instead of a sort."""
    keep = [c for c in points.columns if c != "scan_id"]
    drawn = cells(points, voxel).withColumn("o", lottery(seed)).groupBy(*CELL).agg(F.min(F.struct("o", "point_id", *[c for c in keep if c != "point_id"])).alias("p"))
    return drawn.select(*CELL, *[F.col(f"p.{c}").alias(c) for c in keep])


def remove_scatter(points: DataFrame, voxel: float, n: int) -> DataFrame:
    """All points of cells with more than n."""
    located = cells(points, voxel)
    dense = located.groupBy(*CELL).agg(F.count("*").alias("k")).where(F.col("k") > n).select(*CELL)
    return located.join(dense, list(CELL), "left_semi").drop("edge", "x0", "y0", "z0")


def by_direction(points: DataFrame, step_degrees: float, n: int, seed: int = 0) -> DataFrame:
    """About n points for each direction cell as seen from the scanner."""
    phi, theta, _ = g.polar(XYZ)
    cell = [F.floor(F.degrees(phi) / step_degrees).alias("ip"), F.floor(F.degrees(theta) / step_degrees).alias("it")]
    rank = F.row_number().over(Window.partitionBy("scan_id", "ip", "it").orderBy(lottery(seed), "point_id"))
    return points.select("*", *cell).withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def bernoulli_by_direction(points: DataFrame, step_degrees: float, n: float, seed: int = 0) -> DataFrame:
    """About n points for each direction cell of full size: every point stays with the chance n / points of its cell,
    times the cell's share of a full cell's area on the sphere. The chance is held against the point's lottery number."""
    phi, theta, _ = g.polar(XYZ)
    located = points.withColumns({"ip": F.floor(F.degrees(phi) / step_degrees), "it": F.floor(F.degrees(theta) / step_degrees)})
    size = located.groupBy("scan_id", "ip", "it").agg(F.count("*").alias("size"))
    band = F.cos(F.radians(F.col("ip") * step_degrees)) - F.cos(F.radians((F.col("ip") + 1) * step_degrees))
    chance = n * band / (2 * math.sin(math.radians(step_degrees) / 2)) / F.col("size")
    return located.join(size, ["scan_id", "ip", "it"]).where(lottery(seed) < chance * 2147483647).select(*points.columns)


def _uniform(k: int, copy: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a point's id and the number of its copy."""
    mixed = F.pmod(F.pmod(F.col("point_id") + (copy * 6 + (k + seed * 7919)) * 15485863, F.lit(1000003)) * 48271, F.lit(2147483647))
    again = F.pmod(F.pmod(mixed, F.lit(44488)) * 48271 + F.floor(mixed / 44488) * 40692, F.lit(2147483399))
    return (again + 0.5) / 2147483399.0


def upsample(points: DataFrame, voxel: float, factor: int, seed: int = 0) -> DataFrame:
    """Originals, and for each point (factor - 1) Gaussian samples of its cell's mean and sample covariance. Cells with
    at most three points use a diagonal of a tenth of the edge. Samples have point_id -1.

    The draw is arithmetic on the point's id (Box-Muller), so it is repeatable and needs no task to hold a cell."""
    located = cells(points.select("scan_id", "point_id", *XYZ), voxel)
    some = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    stats = located.groupBy(*CELL).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"u{c}") for c in XYZ], *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in some])
    small = F.col("n") <= 3
    c = {f"{a}{b}": F.when(small, F.pow(F.col("edge") / 10, 2) if a == b else F.lit(0.0)).otherwise(F.col(f"c{a}{b}")) for a, b in some}
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    over = lambda a, b: F.when(b > 1e-12, a / b).otherwise(0.0)
    made = located.join(stats, list(CELL)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor - 1)))) if factor > 1 else None
    if made is None:
        return points.select("scan_id", "point_id", *XYZ)
    # the lower triangle of the covariance's root
    made = made.withColumn("l11", root(c["xx"]))
    made = made.withColumns({"l21": over(c["xy"], F.col("l11")), "l31": over(c["xz"], F.col("l11"))})
    made = made.withColumn("l22", root(c["yy"] - F.col("l21") * F.col("l21")))
    made = made.withColumn("l32", over(c["yz"] - F.col("l31") * F.col("l21"), F.col("l22")))
    made = made.withColumn("l33", root(c["zz"] - F.col("l31") * F.col("l31") - F.col("l32") * F.col("l32")))
    u = [_uniform(k, F.col("copy"), seed) for k in range(4)]
    far = [F.sqrt(-2 * F.log(u[0])), F.sqrt(-2 * F.log(u[2]))]
    made = made.withColumns({"g1": far[0] * F.cos(2 * math.pi * u[1]), "g2": far[0] * F.sin(2 * math.pi * u[1]), "g3": far[1] * F.cos(2 * math.pi * u[3])})
    new = {"x": F.col("ux") + F.col("l11") * F.col("g1"), "y": F.col("uy") + F.col("l21") * F.col("g1") + F.col("l22") * F.col("g2"), "z": F.col("uz") + F.col("l31") * F.col("g1") + F.col("l32") * F.col("g2") + F.col("l33") * F.col("g3")}
    return points.select("scan_id", "point_id", *XYZ).unionByName(made.select("scan_id", F.lit(-1).cast("long").alias("point_id"), *[v.alias(k) for k, v in new.items()]))


def octree(points: DataFrame, voxel: float) -> DataFrame:
    """The octree as a table that can be stored: a row for each occupied cell with its edge, lower corner and points. A
    cell's points are its row, so a dense cloud wants a small voxel."""
    rest = [c for c in points.columns if c != "scan_id"]
    return cells(points, voxel).groupBy(*CELL).agg(*[F.first(x).alias(x) for x in ("edge", "x0", "y0", "z0")], F.collect_list(F.struct(*rest)).alias("points"))


def octree_points(table: DataFrame) -> DataFrame:
    """The points of a stored octree."""
    return table.select("scan_id", F.inline("points"))


def visited(points: DataFrame, voxel: float, visitor: Callable, schema: str) -> DataFrame:
    """visitor(pandas frame of a cell's points) -> pandas frame, for every occupied cell."""
    return cells(points, voxel).groupBy(*CELL).applyInPandas(visitor, schema)
