import numpy as np
from pyspark.sql import functions as F

from scanloom.operators import linalg
from scanloom.sources import directory, formats

A, B = linalg.matrix([10.0, 0, 5.0], [0.0, 0.2, 0.0]), linalg.matrix([0.0, 3.0, 0.0], [0.1, 0.0, -0.1])


def scans(tmp_path):
    for k, m in enumerate((A, B)):
        (tmp_path / f"scan{k:03d}.3d").write_text("1 2 3\n4 5 6\n")
        angles = np.degrees(linalg.angles(m[:3, :3]))
        (tmp_path / f"scan{k:03d}.pose").write_text(" ".join(map(repr, map(float, m[:3, 3]))) + "\n" + " ".join(map(repr, map(float, angles))) + "\n")
    return str(tmp_path)


def test_addresses_and_merging(spark, tmp_path):
    d = scans(tmp_path)
    assert directory.open_directory(spark, d, "uos").count() == 4
    assert directory.open_directory(spark, f"{d}[1]", "uos").select("scan_id").distinct().first()[0] == 1
    merged = directory.open_directory(spark, f"{d}[merged]", "uos")
    assert {r.group_id for r in merged.collect()} == {0}
    got = {(r.scan_id, r.point_id): (r.x, r.y, r.z) for r in merged.collect()}
    want = np.linalg.inv(A) @ B @ np.array([4, 5, 6, 1.0])
    assert np.allclose(got[(0, 0)], (1, 2, 3)) and np.allclose(got[(1, 1)], want[:3], atol=1e-9)


def test_converters(spark, tmp_path):
    poses = formats.read_poses(spark, f"{scans(tmp_path)}/scan*.pose")
    frames = directory.poses_to_frames(poses)
    back = {r.scan_id: r for r in directory.frames_to_poses(frames).collect()}
    for r in poses.collect():
        assert np.allclose([r[c] for c in ("tx", "ty", "tz", "rx", "ry", "rz")], [back[r.scan_id][c] for c in ("tx", "ty", "tz", "rx", "ry", "rz")], atol=1e-9)
    k = np.array(directory.frames_to_kitti(frames).orderBy("scan_id").first().value.split(), float).reshape(3, 4)
    s = np.array([[0, 0, 1], [-1, 0, 0], [0, 1, 0]], float)
    assert np.allclose(k[:, :3], s @ A[:3, :3] @ s.T) and np.allclose(k[:, 3], s @ A[:3, 3] / 100)
    t = np.array(directory.frames_to_tum(frames, F.lit(0.5)).orderBy("scan_id").first().value.split(), float)
    assert t[0] == 0.5 and np.allclose(linalg.quaternion_rotation([t[7], *t[4:7]]), k[:, :3], atol=1e-9)
    m = directory.multiplied(frames, linalg.flat(B)).orderBy("scan_id").first().m
    assert np.allclose(m, linalg.flat(B @ A))
    points = formats.read(spark, f"{tmp_path}/scan*.3d", "uos")
    one = {(r.scan_id, r.point_id): (r.x, r.y, r.z) for r in directory.condensed(points, frames, 2).collect()}
    assert np.allclose(one[(1, 1)], (np.linalg.inv(A) @ B @ np.array([4, 5, 6, 1.0]))[:3], atol=1e-9)
