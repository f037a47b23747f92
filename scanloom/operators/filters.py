"""Point filters as boolean columns, and the chain that applies them in its fixed order.

The order is that of the filters' names: custom, bottom, top, maximum and minimum range test stored coordinates; range
mutation and scale then change them. All bounds are strict; a range bound of zero or less is off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g

XYZ = ("x", "y", "z")


def range_max(limit: float) -> Column:
    return F.lit(True) if limit <= 0 else g.square(XYZ) < limit * limit


def range_min(limit: float) -> Column:
    return F.lit(True) if limit <= 0 else g.square(XYZ) > limit * limit


def height_top(top: float) -> Column:
    return F.col("y") < top


def height_bottom(bottom: float) -> Column:
    return F.col("y") > bottom


def _outside(r: tuple[float, ...]) -> Column:
    return (F.abs("x") > r[0]) | (F.abs("y") > r[1]) | (F.abs("z") > r[2])


def _in_box(p: tuple[float, ...]) -> Column:
    """p: x, y and z from and to, in pairs."""
    return F.col("x").between(p[0], p[1]) & F.col("y").between(p[2], p[3]) & F.col("z").between(p[4], p[5])


def _sphere(p: tuple[float, ...]) -> Column:
    return g.square(g.sub(XYZ, p[:3]))


#: Custom modes: 0 to 2 take a box out (2 with a range limit for the rest), 10 and 11 keep one, 20 keeps what is between
#: two, 21 and 22 take out and keep a sphere. In mode 2 a point inside the box is removed.
CUSTOM: dict[int, Callable[[tuple[float, ...]], Column]] = {
    0: _outside,
    1: lambda p: ~_in_box(p),
    2: lambda p: ~_in_box(p) & (g.square(XYZ) < p[6] * p[6]),
    10: lambda p: ~_outside(p),
    11: _in_box,
    20: lambda p: _in_box(p[:6]) & ~_in_box(p[6:12]),
    21: lambda p: _sphere(p) > p[3] * p[3],
    22: lambda p: _sphere(p) < p[3] * p[3],
}


def custom(text: str) -> Column:
    """`mode;n;p1;...;pn`, several joined by `/`, all of which must hold; other modes keep every point."""
    keep = F.lit(True)
    for part in filter(None, text.split("/")):
        mode, n, *p = part.split(";")
        if len(p) != int(n):
            raise ValueError(f"{part}: {n} parameters announced, {len(p)} given")
        if int(mode) in CUSTOM:
            keep = keep & CUSTOM[int(mode)](tuple(map(float, p)))
    return keep


def mutate_range(points: DataFrame, radius: float) -> DataFrame:
    """Projects points onto a sphere around the scanner; the origin has no direction and becomes null."""
    n = F.nullif(g.length(XYZ), F.lit(0.0))
    return points.withColumns({c: F.col(c) * radius / n for c in XYZ})


def scale(points: DataFrame, factor: float) -> DataFrame:
    return points.withColumns({c: F.col(c) * factor for c in XYZ})


def exclude_types(classes: list[int]) -> Column:
    return ~F.coalesce(F.col("type").isin(classes), F.lit(False))


def inside_planes(planes: list[tuple[float, float, float, float]]) -> Column:
    """A frustum: on the inner side of every plane (a, b, c, d)."""
    keep = F.lit(True)
    for *n, d in planes:
        keep = keep & (g.dot(n, XYZ) + d >= 0)
    return keep


def one_in(n: int, seed: int = 0) -> Column:
    """A repeatable one-in-n sample by an arithmetic hash of the point's id."""
    return F.pmod(F.pmod(F.col("point_id"), F.lit(1000003)) * 7919 + F.col("scan_id") * 104729 + seed, F.lit(1000033)) % n == 0


PREDICATES: dict[str, Callable[..., Column]] = {"customFilter": custom, "heightbottom": height_bottom, "heighttop": height_top, "rangemax": range_max, "rangemin": range_min}
CHANGES: dict[str, Callable[..., DataFrame]] = {"rangemutation": mutate_range, "scale": scale}


def register(name: str, predicate: Callable[..., Column]) -> None:
    """Adds a filter of one's own; it takes its place by its name."""
    PREDICATES[name] = predicate


def chain(points: DataFrame, settings: dict[str, object]) -> DataFrame:
    unknown = set(settings) - set(PREDICATES) - set(CHANGES)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for name in sorted(settings):
        points = points.where(PREDICATES[name](settings[name])) if name in PREDICATES else CHANGES[name](points, settings[name])
    return points
