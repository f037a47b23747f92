"""Scan directories behind an address, and converters between pose notations.

Only names are listed on the driver; points, poses and frames are read by Spark, so any file system it knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.sources import addressing, formats

XYZ = ("x", "y", "z")


def _existing(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath().toString()) for x in found or [])


def scan_paths(spark: SparkSession, address: str, fmt: str) -> list[tuple[tuple[int, ...], list[str]]]:
    """(numbers, files) of each scan of an address; a run that is missing some numbers has the others."""
    f, a = formats.FORMATS[fmt], addressing.parse(address)
    base = f"{a.directory.rstrip('/')}/{f.prefix}"
    if a.clusters is None:
        files = [x for x in _existing(spark, f"{base}[0-9]*") if x.endswith(f.suffix)]
        numbers = [int("".join(c for c in x.rsplit("/", 1)[-1][len(f.prefix) :] if c.isdigit())[:3]) for x in files]
        return [(tuple(numbers), files)] if a.merged else [((n,), [x]) for n, x in zip(numbers, files, strict=True)]
    out = []
    for cluster in a.clusters:
        found = [(n, x) for n in cluster for x in _existing(spark, f"{base}{n:03d}{f.suffix}")]
        if found:
            out.append((tuple(n for n, _ in found), [x for _, x in found]))
    return out


def open_directory(spark: SparkSession, address: str, fmt: str) -> DataFrame:
    """The points of an address with group_id, the first number of their cluster. Members of a merged scan are brought
    into the frame of the first by their pose files."""
    groups = scan_paths(spark, address, fmt)
    if not groups:
        raise FileNotFoundError(f"no scans at {address}")
    files = [x for _, xs in groups for x in xs]
    points = formats.read_text(spark, files, fmt)
    members = spark.createDataFrame([(n, numbers[0]) for numbers, _ in groups for n in numbers], "scan_id int, group_id int")
    points = points.join(F.broadcast(members), "scan_id")  # a row for each scan
    if all(len(numbers) == 1 for numbers, _ in groups):
        return points
    directory = addressing.parse(address).directory.rstrip("/")
    poses = formats.read_poses(spark, f"{directory}/scan*.pose")
    m = poses.select("scan_id", F.array(*pose_matrix()).alias("m"))
    own = points.join(F.broadcast(m), "scan_id").join(F.broadcast(m.toDF("group_id", "first")), "group_id")
    base = trajectory_rebase()
    x, y, z = g.transform(base, XYZ)
    return own.withColumns({"x": x, "y": y, "z": z}).drop("m", "first")


def pose_matrix() -> list[Column]:
    """Matrix of columns tx, ty, tz, rx, ry, rz (radians)."""
    return g.euler_matrix(("tx", "ty", "tz"), ("rx", "ry", "rz"))


def trajectory_rebase() -> list[Column]:
    """Columns m in the frame of first."""
    at = lambda c: [F.element_at(c, k + 1) for k in range(16)]
    return g.multiply(g.rigid_inverse(at("first")), at("m"))


def poses_to_frames(poses: DataFrame, algo: int = 1) -> DataFrame:
    return poses.select("scan_id", F.lit(0).alias("seq"), F.array(*pose_matrix()).alias("m"), F.lit(algo).alias("algo"))


def frames_to_poses(frames: DataFrame) -> DataFrame:
    """Position and angles of each frame."""
    m = [F.element_at("m", k + 1) for k in range(16)]
    angles = g.matrix_euler(m)
    return frames.select("scan_id", "seq", *[m[12 + k].alias(f"t{c}") for k, c in enumerate("xyz")], *[a.alias(f"r{c}") for a, c in zip(angles, "xyz", strict=True)])


def _right_handed(m: list[Column]) -> list[list[Column]]:
    """Rows of the 3x4 pose in metres with axes (z, -x, y)."""
    order, sign = (2, 0, 1), (1, -1, 1)
    rows = []
    for i in range(3):
        row = [m[4 * order[j] + order[i]] * (sign[i] * sign[j]) for j in range(3)]
        rows.append([*row, m[12 + order[i]] * sign[i] / 100])
    return rows


def frames_to_kitti(frames: DataFrame) -> DataFrame:
    """(scan_id, seq, value): twelve numbers, row by row, right-handed metres."""
    rows = _right_handed([F.element_at("m", k + 1) for k in range(16)])
    return frames.select("scan_id", "seq", F.concat_ws(" ", *[c.cast("string") for row in rows for c in row]).alias("value"))


def frames_to_tum(frames: DataFrame, time: Column) -> DataFrame:
    """(scan_id, seq, value): time, position and quaternion (x, y, z, w), right-handed metres."""
    rows = _right_handed([F.element_at("m", k + 1) for k in range(16)])
    zero, one = F.lit(0.0), F.lit(1.0)
    flat = [c for j in range(3) for c in (rows[0][j], rows[1][j], rows[2][j], zero)] + [rows[0][3], rows[1][3], rows[2][3], one]
    w, x, y, z = g.matrix_quaternion(flat)
    return frames.select("scan_id", "seq", F.concat_ws(" ", *[c.cast("string") for c in (time, *[r[3] for r in rows], x, y, z, w)]).alias("value"))


def multiplied(frames: DataFrame, left: list[float]) -> DataFrame:
    """Frames after a further transform from the left."""
    return frames.withColumn("m", F.array(*g.multiply(left, [F.element_at("m", k + 1) for k in range(16)])))


def condensed(points: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """Runs of `size` scans as one, in the frame of the first of each: condense; group_id with frames atomizes again."""
    from scanloom.operators import trajectory

    last = trajectory.last_frames(frames).select("scan_id", "m")
    grouped = trajectory.sub_maps(points, size).join(last, "scan_id").join(last.select((F.col("scan_id") / size).alias("q"), F.col("m").alias("first")).where("q = floor(q)").select(F.col("q").cast("long").alias("group_id"), "first"), "group_id")
    x, y, z = g.transform(trajectory_rebase(), XYZ)
    return grouped.withColumns({"x": x, "y": y, "z": z}).drop("m", "first")
