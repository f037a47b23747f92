"""Removal of what moved: a voxel that another scan's rays pass through is free, and points in it are dynamic.

Occupancy is a set of scans for each voxel. A ray is walked by a column expression: the faces that it crosses, in order
of where, cut it into pieces, and each piece lies in the voxel of its middle. A ray meets occupancy in one join and stops
at its first voxel that its own scan, or one within `window`, has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import segment

V = ("vx", "vy", "vz")


def occupancy(points: DataFrame, edge: float) -> DataFrame:
    return points.groupBy(*[g.cell(c, edge).alias(v) for c, v in zip("xyz", V, strict=True)]).agg(F.collect_set("scan_id").alias("scans"))


def crossings(origin: Column, target: Column, edge: float) -> Column:
    """array<double>: where between 0 and 1 a ray crosses the faces of one axis."""
    lo, hi = F.least(origin, target), F.greatest(origin, target)
    first, last = F.floor(lo / edge) + 1, F.ceil(hi / edge) - 1
    faces = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(faces, lambda k: (k * edge - origin) / (target - origin))


def walked(origin: Sequence[Column], target: Sequence[Column], edge: float, cell: Callable[[Column, float], Column], names: Sequence[str]) -> Column:
    """array<struct<names>>: the cells of a ray from its origin to its target, in order. Faces that are crossed at one
    place are crossed together."""
    cuts = F.concat(F.array(F.lit(0.0)), *[crossings(a, b, edge) for a, b in zip(origin, target, strict=True)], F.array(F.lit(1.0)))
    cuts = F.array_sort(F.array_distinct(F.filter(cuts, lambda t: (t >= 0) & (t <= 1))))
    middle = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: (a + b) / 2)
    at = lambda t: F.struct(*[cell(a + (b - a) * t, edge).alias(n) for a, b, n in zip(origin, target, names, strict=True)])
    return F.transform(middle, at)


def limited(points: DataFrame, origins: DataFrame, limits: DataFrame) -> DataFrame:
    """points (with ox, oy, oz) whose rays end where limits (scan_id, point_id, limit) say, if that is nearer."""
    both = points.join(origins, "scan_id").join(limits.select("scan_id", "point_id", "limit"), ["scan_id", "point_id"], "left")
    far = g.length(g.sub(("x", "y", "z"), ("ox", "oy", "oz")))
    share = F.when(F.col("limit") < far, F.greatest(F.col("limit"), F.lit(0.0)) / F.nullif(far, F.lit(0.0))).otherwise(1.0)
    return both.withColumn("share", F.coalesce(share, F.lit(1.0))).withColumns({c: F.col(f"o{c}") + F.col("share") * (F.col(c) - F.col(f"o{c}")) for c in "xyz"}).drop("share", "limit", "ox", "oy", "oz")


def rays(points: DataFrame, origins: DataFrame, edge: float) -> DataFrame:
    """(scan_id, point_id, k, vx, vy, vz): the voxels of each ray, numbered from its origin (ox, oy, oz of its scan)."""
    both = points.select("scan_id", "point_id", "x", "y", "z").join(origins, "scan_id")
    cells = walked([F.col(f"o{c}") for c in "xyz"], [F.col(c) for c in "xyz"], edge, g.cell, V)
    return both.select("scan_id", "point_id", F.posexplode(cells).alias("k", "v")).select("scan_id", "point_id", F.col("k").cast("long").alias("k"), "v.*")


def free_voxels(points: DataFrame, origins: DataFrame, edge: float, window: int = 0, limits: DataFrame | None = None) -> DataFrame:
    """Occupied voxels that a ray passes through before it stops, or ends by its limit."""
    targets = points if limits is None else limited(points, origins, limits)
    steps = rays(targets, origins, edge).join(occupancy(points, edge), list(V))
    own = F.exists("scans", lambda s: F.abs(s - F.col("scan_id")) <= window)
    w = Window.partitionBy("scan_id", "point_id")
    stop = F.min(F.when(own, F.col("k"))).over(w)
    return steps.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("k") < F.col("stop"))).select(*V).distinct()


def without_small(free: DataFrame, least: int) -> DataFrame:
    """Free voxels in clusters (26 neighbours) of at least so many."""
    named = free.withColumn("node", F.xxhash64(*V))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)])
    moved = named.withColumn("o", F.explode(around)).select(F.col("node").alias("a"), (F.col("vx") + F.col("o.a")).alias("vx"), (F.col("vy") + F.col("o.b")).alias("vy"), (F.col("vz") + F.col("o.c")).alias("vz"))
    links = moved.join(named.withColumnRenamed("node", "b"), list(V)).select("a", "b")
    labels = segment.components(links)
    full = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    big = full.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return full.join(big, "component", "left_semi").select(*V)


def half_free(free: DataFrame, occupied: DataFrame, radius: int = 2) -> DataFrame:
    """(voxel, scan_id): occupied voxels near a free one that are not free inherit the free one's scans."""
    r = range(-radius, radius + 1)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in r for b in r for c in r if (a, b, c) != (0, 0, 0)])
    near = free.join(occupied, list(V)).withColumn("o", F.explode(around)).select((F.col("vx") + F.col("o.a")).alias("vx"), (F.col("vy") + F.col("o.b")).alias("vy"), (F.col("vz") + F.col("o.c")).alias("vz"), F.explode("scans").alias("scan_id")).distinct()
    return near.join(occupied.select(*V), list(V), "left_semi").join(free, list(V), "left_anti")


def mask(points: DataFrame, origins: DataFrame, edge: float, window: int = 0, least: int = 1, limits: DataFrame | None = None) -> DataFrame:
    """points with dynamic: true in a free voxel, or in a half-free one of the point's scan. limits: see max_ranges()."""
    occupied = occupancy(points, edge)
    free = free_voxels(points, origins, edge, window, limits)
    free = (without_small(free, least) if least > 1 else free).checkpoint()
    half = half_free(free, occupied)
    located = points.withColumns({v: g.cell(c, edge) for c, v in zip("xyz", V, strict=True)})
    a = free.withColumn("f", F.lit(True))
    b = half.withColumn("h", F.lit(True))
    out = located.join(a, list(V), "left").join(b, [*V, "scan_id"], "left")
    return out.withColumn("dynamic", F.col("f").isNotNull() | F.col("h").isNotNull()).drop("f", "h", *V)


def max_ranges(points: DataFrame, origins: DataFrame, normals: DataFrame, edge: float, fuzz: float = 0.01) -> DataFrame:
    """(scan_id, point_id, limit) by shadow_ranges() of each scan, for mask(). normals: scan_id, pid, nx, ny, nz.

    The order inside a scan decides, so a scan is one task's work, as it is one sweep of the scanner."""
    diagonal = edge * 3**0.5
    n = normals.select("scan_id", F.col("pid").alias("point_id"), "nx", "ny", "nz")
    far = points.join(origins, "scan_id").withColumns({f"d{c}": F.col(c) - F.col(f"o{c}") for c in "xyz"}).withColumn("range", g.length(("dx", "dy", "dz"))).where(F.col("range") > 0)
    rows = far.join(n, ["scan_id", "point_id"]).select("scan_id", "point_id", *[(F.col(f"d{c}") / F.col("range")).alias(f"d{c}") for c in "xyz"], "range", "nx", "ny", "nz")

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["range", "point_id"], kind="stable")
        return pd.DataFrame({"scan_id": pdf["scan_id"], "point_id": pdf["point_id"], "limit": shadow_ranges(pdf, diagonal, fuzz)})

    return rows.groupBy("scan_id").applyInPandas(of, "scan_id int, point_id long, limit double").where(F.col("limit") < float("inf"))


def shadow_ranges(directions: pd.DataFrame, diagonal: float, fuzz: float = 0.01) -> np.ndarray:
    """Largest range of each ray of one scan (unit dx, dy, dz, range and normal nx, ny, nz): nearest first, the surface
    around a point limits all rays in its angular shadow. Order decides, so it is one scan's sequential step."""
    d, n, r = directions[["dx", "dy", "dz"]].to_numpy(float), directions[["nx", "ny", "nz"]].to_numpy(float), directions["range"].to_numpy(float)
    limit, covered = np.full(len(r), np.inf), np.zeros(len(r), bool)
    for k in np.argsort(r, kind="stable"):
        if covered[k] or r[k] <= 2 * diagonal:
            continue
        angle = 2 * np.arcsin(min(1.0, diagonal / (r[k] - diagonal)))
        inside = d @ d[k] > np.cos(angle)
        base = d[k] * r[k] + n[k] * (diagonal + fuzz) * (np.sign(-(n[k] @ d[k])) or 1.0)
        slope = d[inside] @ n[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(np.abs(slope) > 1e-9, (base @ n[k]) / slope, np.inf)
        limit[inside] = np.minimum(limit[inside], np.maximum(reach, 0))
        covered |= inside
    return limit
