import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.sources import addressing, formats


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lenient_text(spark, tmp_path):
    text = "7.25 0 -1\r\n# a comment\n\n8.5 3 6.5e-9 # inline\n0x1.8p1 -0x10 .5\n"
    rows = formats.read(spark, write(tmp_path / "scan004.3d", text), "uos").orderBy("point_id").collect()
    assert [(r.scan_id, r.x, r.y, r.z) for r in rows] == [(4, 7.25, 0, -1), (4, 8.5, 3, 6.5e-9), (4, 3.0, -16.0, 0.5)]
    ten = "garbage\n" * 10 + "1 2 3\n"
    assert formats.read(spark, write(tmp_path / "scan005.3d", ten), "uos").count() == 1
    with pytest.raises(Exception, match="not a line of points"):
        formats.read(spark, write(tmp_path / "scan006.3d", "garbage\n" * 11 + "1 2 3\n"), "uos").collect()


def test_axes(spark, tmp_path):
    def first(name, fmt, text):
        r = formats.read(spark, write(tmp_path / name, text), fmt).first()
        return r.x, r.y, r.z

    assert first("scan000.xyz", "xyz", "1 2 3") == (-200, 300, 100)
    assert first("scan000.pts", "pts", "1 2 3") == (1, 2, -3)
    assert first("scan3d_0_000.dat", "rts", "10 20 30 0 1 1") == (2, -3, 1)
    assert formats.read(spark, str(tmp_path / "scan3d_0_000.dat"), "rts").count() == 1
    assert first("Stephan000 - Scan001.txt", "ks", "70001 20002 3") == (100, 300, 200)
    r = formats.read(spark, write(tmp_path / "scan001.3d", "1 2 3 255 0 7 0.5"), "uos_rgbr").first()
    assert (r.r, r.g, r.b, r.reflectance) == (255, 0, 7, 0.5)
    assert formats.read(spark, write(tmp_path / "scan3d_0_001.dat", "1 2 3 16 0 0"), "rts").count() == 0


@pytest.mark.parametrize("fmt", ["uos", "uosr", "xyzr", "pts_rgb", "uos_normal", "ks"])
@pytest.mark.parametrize("hexadecimal", [False, True])
def test_round_trip(spark, tmp_path, fmt, hexadecimal):
    rng = np.random.default_rng(1)
    rows = [(0, k, *map(float, rng.normal(size=3) * 100), 1, 2, 3, 0.5, None, 0.25, 7, None, 0.0, 1.0, 0.0) for k in range(50)]
    from scanloom import schema

    df = spark.createDataFrame(rows, schema.POINTS)
    formats.write(df.coalesce(1), str(tmp_path / "out"), fmt, hexadecimal)
    back = formats.read_text(spark, str(tmp_path / "out" / "scan_id=0"), fmt, scan_id=0).orderBy("point_id").collect()
    assert np.allclose([(r.x, r.y, r.z) for r in back], [r[2:5] for r in rows], rtol=1e-9)


def test_zip_and_binary(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "scans.zip", "w") as z:
        z.writestr("data/scan000.3d", "1 2 3\n4 5 6\n")
        z.writestr("data/scan001.3d", "7 8 9\n")
    got = formats.read_zip(spark, str(tmp_path / "scans.zip"), "uos").groupBy("scan_id").count().collect()
    assert sorted((r.scan_id, r["count"]) for r in got) == [(0, 2), (1, 1)]
    ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n" + struct.pack("<3f3B3f3B", 1, 2, 3, 9, 8, 7, 4, 5, 6, 1, 2, 3)
    (tmp_path / "scan002.ply").write_bytes(ply)
    r = formats.read(spark, str(tmp_path / "scan002.ply"), "ply").orderBy("point_id").collect()
    assert (r[0].x, r[0].r, r[1].z, r[0].scan_id) == (1, 9, 6, 2)
    (tmp_path / "000003.bin").write_bytes(np.array([[1, 2, 3, 0.5]], "<f4").tobytes())
    r = formats.read(spark, str(tmp_path / "000003.bin"), "kitti").first()
    assert (r.x, r.y, r.z, r.reflectance) == (-200, 300, 100, 0.5)
    formats.write_ply(formats.read(spark, str(tmp_path / "scan002.ply"), "ply"), str(tmp_path / "out"))
    part = lambda name: "".join(f.read_text() for f in sorted((tmp_path / "out" / name).glob("part-*")))
    back = formats.decode_ply((part("header") + part("vertices")).encode())
    assert sorted(back.x) == [1, 4] and sorted(back.r) == [1, 9]


def test_las():
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 1)
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.01)
    struct.pack_into("<3d", head, 155, 1, 2, 3)
    out = formats.decode_las(bytes(head) + struct.pack("<3iH6x", 100, 200, 300, 42))
    assert np.allclose(out[["x", "y", "z"]].to_numpy(), [[-400, 600, 200]]) and out.reflectance[0] == 42


def test_poses_and_frames(spark, tmp_path):
    write(tmp_path / "scan001.pose", "-12.5 4.75 310.125\n2.5 -0.625 -1.75\n")
    p = formats.read_poses(spark, str(tmp_path / "scan001.pose")).first()
    assert p.scan_id == 1 and p.tz == 310.125 and abs(p.rx - np.radians(2.5)) < 1e-12
    m = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1]
    write(tmp_path / "scan001.frames", " ".join(map(str, m)) + " 1\n" + " ".join(map(str, [*m[:12], 8, 9, 10, 1])) + " 2\n")
    frames = formats.read_frames(spark, str(tmp_path / "scan001.frames"))
    assert frames.count() == 2
    points = formats.read(spark, write(tmp_path / "scan001.3d", "1 1 1"), "uos")
    assert [tuple(r)[2:5] for r in formats.with_frame(points, frames).collect()] == [(9, 10, 11)]
    assert [tuple(r)[2:5] for r in formats.with_frame(points, frames, nth=2).collect()] == [(6, 7, 8)]
    formats.write_frames(frames, str(tmp_path / "frames"))
    formats.write_frames(frames, str(tmp_path / "frames"))
    assert spark.read.text(str(tmp_path / "frames")).count() == 4


def test_writers(spark, tmp_path):
    read = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    df = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (1, 1, 4.0, 5.0, 6.0)], "scan_id int, point_id long, x double, y double, z double")
    frames = spark.createDataFrame([(s, q, [*np.eye(4).reshape(-1)[:12].tolist(), 10.0 * q, 0.0, 0.0, 1.0], 1) for s in (0, 1) for q in (0, 1)], "scan_id int, seq int, m array<double>, algo int")
    formats.export_points(df, None, str(tmp_path / "all"))
    formats.export_points(df, frames, str(tmp_path / "moved"))
    formats.export_points(df, frames, str(tmp_path / "first"), nth=2)
    assert read("all") == read("first") == ["1.0 2.0 3.0", "4.0 5.0 6.0"] and read("moved") == ["11.0 2.0 3.0", "14.0 5.0 6.0"]
    poses = spark.createDataFrame([(1, 100.0, 200.0, 300.0), (0, 0.0, 0.0, 0.0)], "scan_id int, tx double, ty double, tz double")
    formats.write_trajectory(poses, str(tmp_path / "path"))
    formats.write_trajectory(poses, str(tmp_path / "metres"), metres=True)
    assert "100.0 200.0 300.0" in read("path") and "3.0 -1.0 2.0" in read("metres")
    formats.write_features(df.select("x", "y"), str(tmp_path / "csv"))
    formats.write_features(df.select("x", "y"), str(tmp_path / "arff"), "cells")
    assert read("csv").count("x,y") >= 1 and read("arff/data") == ["1.0,2.0", "4.0,5.0"] and "@RELATION cells" in "\n".join(read("arff/header"))
    seen = formats.modified(spark, str(tmp_path / "csv")).collect()
    assert seen and all(r.length > 0 and r.modificationTime for r in seen)


def test_addresses():
    assert addressing.parse("dir").clusters is None
    assert addressing.parse("dir[merged]").merged and addressing.parse("dir[]").merged
    assert addressing.ranges("0:5") == ((0,), (1,), (2,), (3,), (4,), (5,))
    assert addressing.ranges("0:5cluster2+9") == ((0, 1), (2, 3), (4, 5), (9,))
    assert addressing.ranges("0:6:step3+[1:2+5]") == ((0,), (3,), (6,), (1, 2, 5))
    assert addressing.identifier((0, 1, 5)) == "000:005" and addressing.identifier((3,)) == "003"
    with pytest.raises(ValueError):
        addressing.parse("dir[1:x]")


def test_registered_format(spark, tmp_path):
    formats.register("swapped", formats.Format(("z", "y", "x")))
    r = formats.read(spark, write(tmp_path / "scan009.3d", "3 2 1"), "swapped").select(F.col("x"), F.col("z")).first()
    assert (r.x, r.z) == (1, 3)


def test_batches_of_lines_are_read_as_files_are(spark):
    plain = ["1.5 2 -3", "0.001 1e7 2.5E-9"]
    odd = ["head", "7.25\t0  -1", "# a comment", "", " 8.5 +3 6.5e-9 # inline", "0x1.8p1 -0x10 .5", "inf 1 nan", "4 5 6"]
    for lines in (plain, odd, []):
        read, kept = formats.read_lines(formats.pa.array(lines, formats.pa.string()), np.arange(len(lines)), "xyz", "memory")
        rows = spark.createDataFrame([(0, k, "memory", line) for k, line in enumerate(lines)], "scan_id int, point_id long, file string, line string")
        want = sorted(map(tuple, formats.parsed(rows, "xyz").select("point_id", "x", "y", "z").collect()))
        assert repr(want) == repr([tuple(r) for r in zip(kept.tolist(), *[read[c].tolist() for c in "xyz"], strict=True)])
    for late in ("1 2", "1 2 Infinity", "1 2 3 4", "1 2 3\n4 5 6"):
        with pytest.raises(ValueError, match="not a line of points"):
            formats.read_lines(formats.pa.array(["1 2 3", late]), np.array([10, 11]), "xyz", "memory")


def test_batches_of_lines_are_those_of_files(spark):
    points = spark.createDataFrame([(0, 1.5 * k, 0.25 - k, 7.1 * k, 5, 0.5) for k in range(1, 40)], "scan_id int, x double, y double, z double, type int, reflectance double")
    names = ["uosr", "xyzr", "ptsr", "uosc", "rts", "ks"]
    for name, lines in formats.line_batches(points.toArrow().combine_chunks(), names):
        want = [r.value for r in formats.lines(points, name).collect()]
        assert [[float(v) for v in line.split(" ")] for line in lines.to_pylist()] == [[float(v) for v in line.split(" ")] for line in want]


def test_all_formats_read_the_points_once(spark):
    from scanloom.plans import more_queries

    plan = more_queries.text_formats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "ExistingRDD" not in plan
