"""Planes: Hough accumulators, sampled hypotheses, extraction, plane distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import spatial, statistics

XYZ = ("x", "y", "z")


def directions(kind: str, phi_n: int, theta_n: int) -> list[tuple[int, int, float, float, float]]:
    """(i, j, nx, ny, nz): the bin centres of an accumulator. "array" has as many azimuths at every inclination, "ball" as
    many as its circle is long, so bins are alike in size, and "cube" has phi_n x theta_n bins on each face of a cube."""
    out = []
    if kind == "cube":
        for face in range(6):
            for k in range(phi_n * theta_n):
                u, v = 2 * (k // theta_n + 0.5) / phi_n - 1, 2 * (k % theta_n + 0.5) / theta_n - 1
                n = [0.0, 0.0, 0.0]
                n[face % 3], n[(face + 1) % 3], n[(face + 2) % 3] = (1.0 if face < 3 else -1.0), u, v
                size = math.sqrt(1 + u * u + v * v)
                out.append((face, k, *(x / size for x in n)))
        return out
    if kind not in ("array", "ball"):
        raise ValueError(f"no such accumulator: {kind}")
    for i in range(phi_n):
        phi = (i + 0.5) * math.pi / phi_n
        around = theta_n if kind == "array" else max(1, round(theta_n * math.sin(phi)))
        for j in range(around):
            theta = (j + 0.5) * 2 * math.pi / around
            out.append((i, j, math.cos(theta) * math.sin(phi), math.sin(theta) * math.sin(phi), math.cos(phi)))
    return out


def _bins(kind: str, phi_n: int, theta_n: int) -> Column:
    """Unit normals of the bin centres, as an array of structs (i, j, nx, ny, nz)."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.lit(v).alias(f"n{c}") for c, v in zip(XYZ, n, strict=True)]) for i, j, *n in directions(kind, phi_n, theta_n)])


def accumulator(points: DataFrame, phi_n: int, theta_n: int, rho_n: int, rho_max: float, reach: float, kind: str = "array") -> DataFrame:
    """(i, j, k, votes): each point votes for every plane of the bins' centres that is nearer than `reach`.

    Votes are generated in place and counted map-side; what is shuffled is bounded by bins, not points. Over a sample of
    the points (filters.one_in) this is the probabilistic transform.
    """
    voted = points.select(*XYZ, F.explode(_bins(kind, phi_n, theta_n)).alias("b"))
    width = rho_max / rho_n
    d = g.dot(XYZ, [F.col(f"b.n{c}") for c in XYZ])
    lo, hi = F.greatest(F.floor((d - reach) / width - 0.5), F.lit(0)).cast("int"), F.least(F.ceil((d + reach) / width), F.lit(rho_n - 1)).cast("int")
    near = voted.select(F.col("b.i").alias("i"), F.col("b.j").alias("j"), d.alias("d"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    each = near.select("i", "j", "d", F.explode(F.sequence("lo", "hi")).alias("k")).where(F.abs(F.col("d") - (F.col("k") + 0.5) * width) < reach)
    return each.groupBy("i", "j", "k").agg(F.count("*").alias("votes"))


def plane_votes(planes: DataFrame, phi_n: int, theta_n: int, rho_n: int, rho_max: float) -> DataFrame:
    """(i, j, k, votes): the randomised transform: planes through sampled triples (see hypotheses()) vote for the one bin
    of inclination, azimuth and distance that each is in; planes beyond rho_max are in the last."""
    phi, theta = F.acos(F.least(F.greatest("nz", F.lit(-1.0)), F.lit(1.0))), F.atan2("ny", "nx")
    turn = F.when(theta < 0, theta + 2 * math.pi).otherwise(theta)
    bin_ = lambda x, n: F.least(F.floor(x * n), F.lit(n - 1)).cast("int")
    return planes.groupBy(bin_(phi / math.pi, phi_n).alias("i"), bin_(turn / (2 * math.pi), theta_n).alias("j"), bin_(F.col("rho") / rho_max, rho_n).alias("k")).agg(F.count("*").alias("votes"))


def plane_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[float, float, float, float] | None:
    """(nx, ny, nz, rho) with rho >= 0; None for points in a line."""
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n)
    if size < 1e-12:
        return None
    n = n / size
    rho = float(n @ a)
    return (*(n if rho >= 0 else -n).tolist(), abs(rho))


def inliers(points: DataFrame, planes: DataFrame, reach: float) -> DataFrame:
    """(plane, n): points nearer than `reach` to each plane (plane, nx, ny, nz, rho) that has any.

    Planes are hypotheses, whose number is a parameter of whoever made them; a batch of points is held against all of
    them at once and only counts are shuffled."""
    rows = planes.select("plane", "nx", "ny", "nz", "rho").orderBy("plane").collect()
    normals, rho = np.array([[r.nx, r.ny, r.nz] for r in rows]).reshape(-1, 3), np.array([r.rho for r in rows])
    names = np.array([r.plane for r in rows], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(rho), np.int64)
        for b in batches:
            p = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in XYZ], 1)
            for k in range(0, len(rho), 512):
                for a in range(0, len(p), 2048):
                    n[k : k + 512] += (np.abs(p[a : a + 2048] @ normals[k : k + 512].T - rho[k : k + 512]) < reach).sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.record_batch({"plane": pa.array(names[some]), "n": pa.array(n[some])})

    each = points.select(*[F.col(c).cast("double").alias(c) for c in XYZ]).where("x is not null and y is not null and z is not null").mapInArrow(count, "plane long, n long")
    return each.groupBy(F.col("plane").cast(planes.schema["plane"].dataType).alias("plane")).agg(F.sum("n").alias("n"))


def hypotheses(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n planes through point triples, drawn by an arithmetic hash of the ids."""
    order = F.pmod(F.pmod(F.col("point_id") + seed, F.lit(1000003)) * 48271, F.lit(2147483647))
    rows = points.select(*XYZ, order.alias("o"), "point_id").orderBy("o", "point_id").limit(3 * n).collect()
    p = np.array([[r[c] for c in XYZ] for r in rows]).reshape(-1, 3)
    found = [plane_of(*p[k : k + 3]) for k in range(0, len(p) - 2, 3)]
    return points.sparkSession.createDataFrame([(k, *map(float, f)) for k, f in enumerate(found) if f], "plane int, nx double, ny double, nz double, rho double")


def ransac(points: DataFrame, n: int, reach: float, seed: int = 0) -> tuple[np.ndarray, float, int] | None:
    """The best of n sampled planes (most points, then the first), refined once over its points: normal, rho, points."""
    planes = hypotheses(points, n, seed)
    best = inliers(points, planes, reach).orderBy(F.desc("n"), "plane").first()
    if best is None:
        return None
    h = planes.where(F.col("plane") == best.plane).first()
    fit = refit(points.where(F.abs(g.dot([h.nx, h.ny, h.nz], XYZ) - h.rho) < reach))
    if fit is None:
        return np.array([h.nx, h.ny, h.nz]), h.rho, best.n
    return fit[0], fit[1], points.where(F.abs(g.dot(fit[0].tolist(), XYZ) - fit[1]) < reach).count()


def refit(points: DataFrame) -> tuple[np.ndarray, float, float] | None:
    """Least-squares plane (normal, rho, smallest eigenvalue) from one aggregate."""
    r = statistics.covariances(points).first()
    if r is None or r["n"] < 3:
        return None
    m = np.array([[r["cxx"], r["cxy"], r["cxz"]], [r["cxy"], r["cyy"], r["cyz"]], [r["cxz"], r["cyz"], r["czz"]]])
    w, v = np.linalg.eigh(m)
    n = v[:, 0]
    rho = float(n @ np.array([r[f"avg_{c}"] for c in XYZ]))
    return (n, rho, float(w[0])) if rho >= 0 else (-n, -rho, float(w[0]))


def extract(points: DataFrame, planes: int, reach: float, phi_n: int = 18, theta_n: int = 36, rho_n: int = 50, least: int = 50) -> list[tuple[np.ndarray, float, int]]:
    """Planes one after another: the fullest bin, its points, a refit, the points of the refit; those leave the pool."""
    top = points.agg(F.max(g.length(XYZ))).first()[0] or 1.0
    out, left = [], points
    for _ in range(planes):
        peak = accumulator(left, phi_n, theta_n, rho_n, top, reach).orderBy(F.desc("votes"), "i", "j", "k").first()
        if peak is None or peak.votes < least:
            break
        phi, theta = (peak.i + 0.5) * math.pi / phi_n, (peak.j + 0.5) * 2 * math.pi / theta_n
        n, rho = np.array([math.cos(theta) * math.sin(phi), math.sin(theta) * math.sin(phi), math.cos(phi)]), (peak.k + 0.5) * top / rho_n
        fit = refit(left.where(F.abs(g.dot(n.tolist(), XYZ) - rho) < reach))
        if fit is None:
            break
        n, rho, _ = fit
        on = F.abs(g.dot(n.tolist(), XYZ) - rho) < reach
        size = left.where(on).count()
        out.append((n, rho, size))
        left = left.where(~on).checkpoint()
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points in a plane, counter-clockwise from the smallest."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def is_horizontal(n: np.ndarray, degrees: float = 10.0) -> bool:
    return abs(n[1]) > math.cos(math.radians(degrees))


def is_wall(n: np.ndarray, degrees: float = 10.0) -> bool:
    return abs(n[1]) < math.sin(math.radians(degrees))


def circle(points: np.ndarray) -> tuple[float, float, float]:
    """Least-squares circle (x, y, radius)."""
    a = np.c_[2 * points, np.ones(len(points))]
    x, y, c = np.linalg.lstsq(a, (points**2).sum(axis=1), rcond=None)[0]
    return x, y, math.sqrt(max(0.0, c + x * x + y * y))


def cylinder_axis(normals: np.ndarray) -> np.ndarray:
    """The direction that normals of a cylinder's surface avoid."""
    return np.linalg.eigh(normals.T @ normals)[1][:, 0]


def match_planes(a: DataFrame, b: DataFrame, angle: float, distance: float) -> DataFrame:
    """For each plane of a (plane, nx, ny, nz, rho) the plane of b with the least difference, within both thresholds.

    Unit normals are points of a sphere: planes meet in the grid join of normals that are nearer than the angle's chord."""
    chord = 2 * math.sin(min(angle, math.pi) / 2)
    probe = a.select(F.col("plane").alias("pid"), *[F.col(f"n{c}").alias(f"p{c}") for c in XYZ], "rho")
    model = b.select(F.col("plane").alias("mid"), *[F.col(f"n{c}").alias(f"m{c}") for c in XYZ], F.col("rho").alias("sigma"))
    turn = 2 * F.asin(F.least(F.sqrt("d2") / 2, F.lit(1.0)))
    both = spatial.pairs(probe, model, chord * (1 + 1e-12) + 1e-12).withColumns({"turn": turn, "gap": F.abs(F.col("rho") - F.col("sigma"))}).where((F.col("turn") < angle) & (F.col("gap") < distance))
    return both.groupBy(F.col("pid").alias("plane")).agg(F.min(F.struct((F.col("turn") / angle + F.col("gap") / distance).alias("cost"), F.col("mid").alias("other"))).alias("b")).select("plane", F.col("b.other").alias("other"), F.col("b.cost").alias("cost"))


def plane_pose(pairs: list[tuple[np.ndarray, float, np.ndarray, float]]) -> np.ndarray:
    """The pose that carries planes (n, rho) onto their matches (m, sigma): rotation from normals, translation from
    what is left of the distances."""
    h = sum((np.outer(n, m) for n, _, m, _ in pairs), np.zeros((3, 3)))
    u, _, v = np.linalg.svd(h)
    r = v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T
    t = np.linalg.lstsq(np.array([m for *_, m, _ in pairs]), np.array([s - rho for _, rho, _, s in pairs]), rcond=None)[0]
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, t
    return out


