"""Paths, frames, time alignment and graphs of poses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import linalg


def deltas(path: DataFrame, by: str, order: list[str], axes: list[str]) -> DataFrame:
    """Steps from the row before: d<axis> and step, the length; null on the first row of a path."""
    w = Window.partitionBy(by).orderBy(*order)
    out = path.withColumns({f"d{a}": F.col(a) - F.lag(a).over(w) for a in axes})
    return out.withColumn("step", g.length([f"d{a}" for a in axes]))


def lengths(path: DataFrame, by: str, order: list[str], axes: list[str]) -> DataFrame:
    return deltas(path, by, order, axes).groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def last_frames(frames: DataFrame, by: str = "scan_id", order: str = "seq", nth: int = 1) -> DataFrame:
    """The nth frame from the end of each scan."""
    if nth == 1:
        rest = [c for c in frames.columns if c not in (by, order)]
        return frames.groupBy(by).agg(F.max(F.struct(order, *rest)).alias("f")).select(by, "f.*")
    return frames.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("rn") == nth).drop("rn")


def previous(path: DataFrame, by: str, order: list[str], n: int, value: str) -> DataFrame:
    """Count and mean over the n rows before each: the sliding metascan."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-n, -1)
    return path.withColumns({"before_n": F.count(value).over(w), "before_mean": F.avg(value).over(w)})


def convergence(frames: DataFrame) -> DataFrame:
    """Translation between the frames of a scan: from the frame before, and from the last."""
    w = Window.partitionBy("scan_id").orderBy("seq")
    every = Window.partitionBy("scan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = lambda c: [F.element_at(c, k) for k in (13, 14, 15)]
    out = frames.withColumns({"prev": F.lag("m").over(w), "final": F.last("m").over(every)})
    return out.select("scan_id", "seq", g.length(g.sub(t("m"), t("prev"))).alias("local"), g.length(g.sub(t("m"), t("final"))).alias("total"))


def mean_pose(poses: DataFrame) -> np.ndarray:
    """The mean of matrices (column m of sixteen numbers), its rotation made orthonormal."""
    row = poses.agg(*[F.avg(F.element_at("m", k + 1)).alias(f"m{k}") for k in range(16)]).first()
    out = np.array([row[f"m{k}"] for k in range(16)]).reshape(4, 4).T
    out[:3, :3] = linalg.nearest_rotation(out[:3, :3])
    return out


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, strict: bool = False) -> DataFrame:
    """left with the value of the latest row of right that is not later (strict: earlier), by one sort of both."""
    tie = 0 if strict else 1  # where rows of equal time: left before right, or after
    l = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__o": F.lit(tie)})  # noqa: E741
    r = right.select(*by, time, F.col(value).alias("__v"), F.lit(1 - tie).alias("__o"))
    w = Window.partitionBy(*by).orderBy(time, "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where(F.col("__o") == tie).drop("__v", "__o")


def interpolated(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """left with the value of right at its time, on the line between its neighbours; the nearest one beyond the ends."""
    l = left.withColumns({"__t": F.lit(None).cast("double"), "__v": F.lit(None).cast("double"), "__o": F.lit(1)})  # noqa: E741
    r = right.select(*by, time, F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__o"))
    w = Window.partitionBy(*by).orderBy(time, "__o")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = l.unionByName(r, allowMissingColumns=True).withColumns({"__t0": F.last("__t", True).over(back), "__v0": F.last("__v", True).over(back), "__t1": F.first("__t", True).over(ahead), "__v1": F.first("__v", True).over(ahead)})
    gap = F.nullif(F.col("__t1") - F.col("__t0"), F.lit(0.0))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col(time).cast("double") - F.col("__t0")) / gap
    return both.where(F.col("__o") == 1).withColumn(value, F.coalesce(line, "__v0", "__v1")).drop("__t", "__v", "__o", "__t0", "__v0", "__t1", "__v1")


def clock_offset(rows: DataFrame, sensor: str, host: str, *by: str) -> DataFrame:
    """The largest sensor minus host time: messages are only ever late."""
    return rows.groupBy(*by).agg(F.max(F.col(sensor) - F.col(host)).alias("offset"))


def drifting_offset(rows: DataFrame, sensor: str, host: str, order: list[str], by: str, slow: float, fast: float) -> DataFrame:
    """Olsen's bound with drift: an offset may fall by slow/(1-slow) and rise by fast/(1+fast) per unit of sensor time, so
    the best offset at a time is the largest over earlier rows less their drift, and over later rows less theirs.

    Less drift is linear in time, so each pass is a running maximum, not a recursion."""
    w = Window.partitionBy(by).orderBy(*order)
    a, b = slow / (1 - slow), fast / (1 + fast)
    t, off = F.col(sensor), F.col(sensor) - F.col(host)
    back = F.max(off + a * t).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - a * t
    ahead = F.max(off - b * t).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)) + b * t
    return rows.withColumn("offset", F.greatest(back, ahead))


def sub_maps(scans: DataFrame, size: int, key: str = "scan_id") -> DataFrame:
    """scans with group_id: runs of `size` consecutive numbers."""
    return scans.withColumn("group_id", F.floor(F.col(key) / size).cast("long"))


def rebased(pose: list[Column], first: list[Column]) -> list[Column]:
    """A pose in the frame of another."""
    return g.multiply(g.rigid_inverse(first), pose)


def extrapolated(poses: dict[int, np.ndarray], estimates: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Estimates corrected by how far the pose before was moved; a fold over few scans."""
    out, delta = {}, np.eye(4)
    for s in sorted(estimates):
        out[s] = poses[s] if s in poses else delta @ estimates[s]
        delta = out[s] @ np.linalg.inv(estimates[s])
    return out
