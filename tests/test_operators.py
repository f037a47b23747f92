"""Boundary facts, brute force on small clouds, and known truths."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import dynamic, features, filters, linalg, raster, reduce, segment, shapes, spatial, statistics, trajectory
from scanloom.plans import registration
from scanloom.streaming import tracker


def cloud(spark, xyz, scan=0):
    return spark.createDataFrame([(scan, k, *map(float, p)) for k, p in enumerate(xyz)], "scan_id int, point_id long, x double, y double, z double")


def test_distance_is_strict(spark):
    model = spatial.as_model(cloud(spark, [(1, 0, 0)]))
    probe = spatial.as_probe(cloud(spark, [(0, 0, 0)]))
    assert spatial.nearest(probe, model, 1.0).count() == 0 and spatial.nearest(probe, model, 1.0001).count() == 1


def test_searches_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-10, 10, (60, 3)), rng.uniform(-10, 10, (200, 3))
    probe, model = spatial.as_probe(cloud(spark, a)), spatial.as_model(cloud(spark, b))
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    got = {(r.pid, r.mid) for r in spatial.pairs(probe, model, 4.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(200) if d2[i, j] < 16}
    near = {r.pid: r.mid for r in spatial.nearest(probe, model, 4.0).collect()}
    assert near == {i: int(d2[i].argmin()) for i in range(60) if d2[i].min() < 16}
    ring = {}
    for r in spatial.k_nearest(probe, model, 5, 0.7).collect():
        ring.setdefault(r.pid, {})[r["rank"]] = r.mid
    assert ring == {i: {k + 1: int(j) for k, j in enumerate(np.argsort(d2[i])[:5])} for i in range(60)}
    assert {r.pid for r in spatial.difference(probe, model, 3.0).collect()} == {i for i in range(60) if d2[i].min() >= 9}


def test_lines_and_segments(spark):
    df = cloud(spark, [(-5, 0.5, 0), (5, 0.5, 0), (15, 0.5, 0), (5, 2, 0)])
    ids = lambda x: {r.point_id for r in x.collect()}
    assert ids(spatial.line_within(df, (0, 0, 0), (1, 0, 0), 1.0)) == {0, 1, 2}
    assert ids(spatial.segment_within(df, (0, 0, 0), (10, 0, 0), 1.0)) == {1}
    assert ids(spatial.cylinder(df, (0, 0, 0), (1, 0, 0), 1.0, 3.0, 8.0)) == {3}
    assert ids(spatial.box(df, (-5, 0.5, 0), (5, 2, 0))) == {0, 1, 3}
    with pytest.raises(ValueError):
        spatial.box(df, (1, 0, 0), (0, 1, 1))


def test_grid_join_has_no_nested_loop(spark):
    df = cloud(spark, [(0, 0, 0)])
    plan = spatial.nearest(spatial.as_probe(df), spatial.as_model(df), 1.0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_geometry_twins(spark):
    """Columns and NumPy agree, through Euler angles, matrices and quaternions, at half turns and poles too."""
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, x)) for x in rng.uniform(-1.5, 1.5, (40, 3))] + [(0.0, math.pi / 2, 0.3), (3.0, 0.0, 0.0), (0.0, 0.0, 3.1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a double, b double, c double")
    m = g.euler_matrix((1, 2, 3), ("a", "b", "c"))
    q = g.matrix_quaternion(m)
    out = df.select("k", F.array(*m).alias("m"), F.array(*g.quaternion_matrix(q, (1, 2, 3))).alias("q"), F.array(*g.multiply(m, g.rigid_inverse(m))).alias("i"), F.array(*g.matrix_euler(m)).alias("e")).collect()
    for r in out:
        want = linalg.matrix([1, 2, 3], rows[r.k])
        assert np.allclose(r.m, linalg.flat(want)) and np.allclose(r.q, linalg.flat(want), atol=1e-7)
        assert np.allclose(r.i, linalg.flat(np.eye(4)), atol=1e-12)
        assert np.allclose(linalg.rotation(r.e), want[:3, :3], atol=1e-7)
        assert np.allclose(linalg.rotation(linalg.angles(want[:3, :3])), want[:3, :3], atol=1e-7)


def test_slerp_and_earth(spark):
    one = spark.range(1)
    q = [math.cos(0.4), math.sin(0.4), 0.0, 0.0]
    mid = one.select(F.array(*g.slerp([1, 0, 0, 0], q, 0.5)).alias("s")).first().s
    assert np.allclose(mid, [math.cos(0.2), math.sin(0.2), 0, 0])
    r = one.select(F.array(*g.lla_utm(48.0, 9.0)).alias("u"), F.array(*g.ecef_enu(g.lla_ecef(48.001, 9.0, 0), 48.0, 9.0, g.lla_ecef(48.0, 9.0, 0))).alias("e")).first()
    assert r.u[0] == 32 and abs(r.u[1] - 500000) < 1e-3 and abs(r.u[2] - 5316300) < 1500
    assert abs(r.e[0]) < 1 and 11000 < r.e[1] < 11200


def test_octree_closed_form(spark):
    """The closed form's cells are those of a tree that halves a cube until its half-edge is small enough."""
    rng = np.random.default_rng(4)
    p = rng.uniform(-7, 13, (300, 3))
    got = {r.point_id: (r.ix, r.iy, r.iz) for r in reduce.cells(cloud(spark, p), 0.9).collect()}
    c, s = (p.min(0) + p.max(0)) / 2, ((p.max(0) - p.min(0)) / 2).max() + 1

    def tree(ids, centre, half, index):
        if half <= 0.9 and half < s:
            return {i: index for i in ids}
        out = {}
        for k in range(8):
            side = np.array([k & 1, k >> 1 & 1, k >> 2 & 1])
            own = [i for i in ids if all((p[i] >= centre) == side.astype(bool))]
            if own:
                out |= tree(own, centre + (side - 0.5) * half, half / 2, tuple(2 * a + int(b) for a, b in zip(index, side, strict=True)))
        return out

    assert got == tree(range(300), c, s, (0, 0, 0))


def test_custom_filters(spark):
    df = cloud(spark, [(0, 0, 0), (2, 0, 0), (5, 5, 5)])
    ids = lambda text: {r.point_id for r in df.where(filters.custom(text)).collect()}
    assert ids("0;3;1;1;1") == {1, 2} and ids("10;3;1;1;1") == {0} and ids("1;6;-1;1;-1;1;-1;1") == {1, 2}
    assert ids("2;7;-1;1;-1;1;-1;1;3") == {1} and ids("21;4;0;0;0;3") == {2} and ids("22;4;0;0;0;3") == {0, 1}
    assert ids("20;12;-3;3;-3;3;-3;3;-1;1;-1;1;-1;1") == {1} and ids("99;0") == {0, 1, 2}
    with pytest.raises(ValueError):
        filters.custom("0;3;1;1")
    assert filters.mutate_range(df, 10.0).where("x is null").count() == 1


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(5)
    p = np.c_[rng.uniform(0, 5, 200), np.full(200, 3.0), rng.uniform(0, 5, 200)]
    out = features.normals(cloud(spark, p), 10, 2.0).collect()
    assert len(out) == 200 and all(abs(r.ny - 1) < 1e-9 and r.e1 < 1e-12 for r in out)
    line = features.adaptive_normals(cloud(spark, rng.normal(size=(60, 3))), 5, 9, 10.0).collect()
    assert len(line) == 60 and all(5 <= r.k <= 9 for r in line)
    best = features.optimal_k(cloud(spark, p[:40]), 4, 10, 3, 10.0).collect()
    assert len(best) == 40 and {r.k for r in best} <= {4, 7, 10}
    col = {r.pid: r.n for r in features.column_features(cloud(spark, p), 1.0).collect()}
    assert col[0] == int((((p - p[0])[:, [0, 2]] ** 2).sum(1) < 1).sum())


POSE = linalg.matrix([0.4, -0.3, 0.2], [0.03, -0.02, 0.04])


@pytest.mark.parametrize("name", sorted(registration.MINIMISERS))
def test_minimisers_recover_a_pose(spark, name):
    rng = np.random.default_rng(6)
    p = rng.uniform(-5, 5, (50, 3))
    pose = POSE if name not in ("small_angle", "helix") else linalg.matrix([0.4, -0.3, 0.2], [3e-4, -2e-4, 4e-4])
    m = p @ pose[:3, :3].T + pose[:3, 3]
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, m, strict=True)], "px double, py double, pz double, mx double, my double, mz double")
    found = registration.MINIMISERS[name](linalg.Moments(statistics.pair_moments(pairs).first().asDict()))
    assert np.allclose(found, pose, atol=1e-6 if name not in ("small_angle", "helix") else 2e-4)


def test_icp_and_plane_icp(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(-5, 5, (300, 3))
    model = cloud(spark, p)
    data = registration.moved(model, np.linalg.inv(linalg.matrix([0.05, -0.04, 0.03], [0.004, -0.003, 0.005]))).checkpoint()
    pose, errors = registration.icp(model, data, 2.0, 20)
    assert np.allclose(pose, linalg.matrix([0.05, -0.04, 0.03], [0.004, -0.003, 0.005]), atol=1e-4) and errors[-1] < 1e-4
    n = rng.normal(size=(300, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    small = linalg.matrix([0.01, 0.02, -0.01], [1e-4, -2e-4, 1e-4])
    q = (p - small[:3, 3]) @ small[:3, :3]
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b), *map(float, c)) for a, b, c in zip(q, p, n, strict=True)], "px double, py double, pz double, mx double, my double, mz double, nx double, ny double, nz double")
    assert np.allclose(registration.point_to_plane(pairs), small, atol=1e-5)


def test_relaxation_and_loops(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(-5, 5, (80, 3))
    every = cloud(spark, p, 0).unionByName(cloud(spark, p, 1)).unionByName(cloud(spark, p, 2)).checkpoint()
    start = {0: np.eye(4), 1: linalg.matrix([0.2, 0.1, -0.1], [0, 0.01, 0]), 2: linalg.matrix([-0.1, 0.2, 0.1], [0.01, 0, -0.01])}
    out, moves = registration.relax(every, start, [(0, 1), (1, 2), (0, 2)], 3.0, 5)
    assert all(np.allclose(m, np.eye(4), atol=1e-3) for m in out.values()) and moves[-1] < moves[0]
    poses = {k: linalg.matrix([float(k), 0, 0], [0, 0, 0]) for k in range(5)}
    closed = registration.close_loop(poses, [(k, k + 1, 1.0) for k in range(4)], linalg.matrix([0.4, 0, 0], [0, 0.2, 0]))
    assert np.allclose(closed[0], poses[0]) and abs(closed[2][0, 3] - (2 * math.cos(0.1) + 0.2)) < 1e-9
    assert np.allclose(linalg.balance(4, [(0, 1, 1.0), (1, 2, 3.0), (1, 3, 1.0)], 0, 2), [0, 0.25, 1, 0.25])


def test_rays_and_mask(spark):
    ends = [(0.5, 0.5, 0.5, 3.5, 1.5, 0.5), (0.5, 0.5, 0.5, -2.5, 0.5, 0.5), (0.5, 0.5, 0.5, 0.6, 0.5, 0.5), (0.5, 0.5, 0.5, 2.5, 2.5, 2.5), (1.0, 0.5, 0.5, 3.0, 0.5, 0.5), (1.0, 0.5, 0.5, -1.0, 0.5, 0.5)]
    targets = spark.createDataFrame([(k, k, *e[3:]) for k, e in enumerate(ends)], "scan_id int, point_id long, x double, y double, z double")
    starts = spark.createDataFrame([(k, *e[:3]) for k, e in enumerate(ends)], "scan_id int, ox double, oy double, oz double")
    walks = {}
    for x in dynamic.rays(targets, starts, 1.0).orderBy("scan_id", "k").collect():
        walks.setdefault(x.scan_id, []).append((x.vx, x.vy, x.vz))
    assert walks[0][0] == (0, 0, 0) and walks[0][-1] == (3, 1, 0) and (np.abs(np.diff(walks[0], axis=0)).max(axis=1) == 1).all()
    assert [v[0] for v in walks[1]] == [0, -1, -2, -3] and walks[2] == [(0, 0, 0)]
    assert walks[3] == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]  # through the corners
    assert [v[0] for v in walks[4]] == [1, 2] and [v[0] for v in walks[5]] == [0, -1]
    # scan 0 sees a thing at x = 5; scan 1 looks through that place at a wall
    rows = [(0, 0, 5.5, 0.5, 0.5), (0, 1, 9.5, 3.5, 0.5), (1, 2, 9.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "scan_id int, point_id long, x double, y double, z double")
    origins = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 0.5, 0.5, 0.5)], "scan_id int, ox double, oy double, oz double")
    got = {r.point_id: r.dynamic for r in dynamic.mask(df, origins, 1.0).collect()}
    assert got == {0: True, 1: False, 2: False}
    short = spark.createDataFrame([(1, 2, 3.0)], "scan_id int, point_id long, limit double")
    assert not any(r.dynamic for r in dynamic.mask(df, origins, 1.0, limits=short).collect())
    normals = df.select("scan_id", F.col("point_id").alias("pid"), F.lit(-1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    bounds = {r.point_id: r.limit for r in dynamic.max_ranges(df, origins, normals, 1.0).collect()}
    assert set(bounds) <= {0, 1, 2} and all(v > 0 for v in bounds.values())
    free = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (9, 9, 9)], "vx long, vy long, vz long")
    assert dynamic.without_small(free, 2).count() == 2
    limit = dynamic.shadow_ranges(pd.DataFrame({"dx": [1.0, 1.0], "dy": [0.0, 0.0], "dz": [0.0, 0.0], "range": [10.0, 50.0], "nx": [-1.0, 1.0], "ny": 0.0, "nz": 0.0}), 1.0)
    assert limit[1] < 50


def test_no_products_of_sides(spark):
    """Bodies and poses, planes and points, planes and planes meet without a nested loop or a product."""
    rng = np.random.default_rng(3)
    e = spatial.as_probe(cloud(spark, rng.uniform(0, 9, (60, 3))))
    body = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 2.0, 2.0, 2.0)], "mid long, mx double, my double, mz double")
    path = spark.createDataFrame([(s, 0.5 * s, 0.0, 0.0) for s in range(5)], "step int, ox double, oy double, oz double")
    planes = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 4.0), (1, 1.0, 0.0, 0.0, 2.0)], "plane int, nx double, ny double, nz double, rho double")
    frames = [spatial.collisions(e, body, path, 1.0), spatial.swept_collisions(e, body, path, 1.0), shapes.inliers(cloud(spark, rng.uniform(0, 9, (60, 3))), planes, 0.5), shapes.match_planes(planes, planes, 0.2, 1.0)]
    for df in frames:
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        df.collect()


def test_links_and_sequences_agree(spark):
    """All links at once, one after another, and against all before give the motions that were put in."""
    xyz = np.random.default_rng(6).uniform(0, 20, (120, 3))
    rows = [(s, 1000 * s + k, float(x + 0.2 * s), float(y - 0.1 * s), float(z)) for s in range(3) for k, (x, y, z) in enumerate(xyz)]
    points = spark.createDataFrame(rows, "scan_id int, point_id long, x double, y double, z double")
    for model in ("previous", "first", "metascan"):
        poses = registration.register_sequence(points, [0, 1, 2], 2.0, model=model, iterations=12)
        assert all(np.allclose(poses[s][:3, 3], (-0.2 * s, 0.1 * s, 0), atol=0.02) for s in range(3)), model


def test_segmentation(spark):
    edges = pd.DataFrame([(0, 1, 1.0), (1, 2, 1.5), (0, 2, 2.0)], columns=["a", "b", "w"])
    assert set(segment.felzenszwalb(edges, 2.0).values()) == {0}
    s = segment.DisjointSet(4)
    for a, b in ((0, 1), (2, 3), (1, 3)):
        s.join(a, b)
    assert len({s.find(k) for k in range(4)}) == 1 and s.size[s.find(2)] == 4
    rng = np.random.default_rng(9)
    links = [tuple(map(int, x)) for x in rng.integers(0, 200, (150, 2))]
    got = {r.node: r.component for r in segment.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {k: k for k in range(200)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {k: find(k) for a, b in links if a != b for k in (a, b)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.component for r in segment.components(chain).collect()} == {0}


def test_shapes(spark):
    rng = np.random.default_rng(10)
    p = np.r_[np.c_[rng.uniform(-5, 5, (150, 1)), np.full((150, 1), 4.0), rng.uniform(-5, 5, (150, 1))], rng.uniform(-5, 5, (30, 3))]
    n, rho, size = shapes.extract(cloud(spark, p), 1, 0.5, 12, 24, 20, 30)[0]
    assert abs(abs(n[1]) - 1) < 0.01 and abs(rho - 4) < 0.2 and size >= 150 and shapes.is_horizontal(n)
    assert len(shapes.hull(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]))) == 4
    t = np.linspace(0, 5, 30)
    assert np.allclose(shapes.circle(np.c_[3 + 2 * np.cos(t), 1 + 2 * np.sin(t)]), (3, 1, 2))
    planes = [(np.eye(3)[k], 1.0 + k) for k in range(3)]
    moved = [(POSE[:3, :3] @ n, rho + (POSE[:3, :3] @ n) @ POSE[:3, 3]) for n, rho in planes]
    assert np.allclose(shapes.plane_pose([(n, r, m, s) for (n, r), (m, s) in zip(planes, moved, strict=True)]), POSE)
    df = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 4.0)], "plane int, nx double, ny double, nz double, rho double")
    assert shapes.match_planes(df, df, 0.1, 0.1).first().other == 0


def test_rasters(spark):
    rng = np.random.default_rng(11)
    df = cloud(spark, rng.uniform(-900, 900, (400, 3)))
    for name in ("equirectangular", "cylindrical", "mercator", "miller", "equal_area", "rectilinear", "stereographic", "azimuthal", "pannini", "zaxis", "conic"):
        out = raster.pixels(df, 40, 20, name, *([(10.0, 60.0)] if name == "conic" else []))
        assert all(0 <= r.row < 20 and 0 <= r.col < 40 for r in out.select("row", "col").collect())
    back = raster.recovered(raster.farthest(raster.pixels(df, 3600, 1800).withColumnsRenamed({c: f"o{c}" for c in "xyz"})), 3600, 1800).collect()
    assert len(back) > 100 and all(abs(r.x - r.ox) + abs(r.y - r.oy) + abs(r.z - r.oz) < 12 for r in back)
    seen = spark.createDataFrame([(0, 0, 0, s, 0.5 if s < 40 else -0.5) for s in range(60)], "vx long, vy long, vz long, scan_id int, sd double")
    t, w = 0.0, 0
    for s in range(60):
        w = min(w + 1, 32)
        t = (t * (w - 1) + min((0.5 if s < 40 else -0.5) / 1.0, 1)) / w
    r = raster.tsdf(seen, 1.0).first()
    assert r.weight == 32 and abs(r.tsd - t) < 1e-12
    grid = raster.merged(raster.occupancy(df, 100.0, (-900, 900)).drop("scan_id"), raster.sight_lines(df, 100.0, (-900, 900)).drop("scan_id"))
    assert all(0 <= r.share <= 1 for r in grid.collect())


def test_time(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 9.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, 20.0), ("a", 3.0, 30.0), ("a", 1.0, 10.0)], "k string, t double, v double")
    asof = {(r.k, r.t): r.v for r in trajectory.as_of(left, right, ["k"], "t", "v").collect()}
    assert asof == {("a", 1.0): 10.0, ("a", 2.5): 20.0, ("a", 9.0): 30.0, ("b", 1.0): None}
    strict = {(r.k, r.t): r.v for r in trajectory.as_of(left, right, ["k"], "t", "v", strict=True).collect()}
    assert strict[("a", 1.0)] is None
    line = {(r.k, r.t): r.v for r in trajectory.interpolated(left, right, ["k"], "t", "v").collect()}
    assert line == {("a", 1.0): 10.0, ("a", 2.5): 25.0, ("a", 9.0): 30.0, ("b", 1.0): None}


def seen_clusters():
    rows = []
    for f in range(12):
        rows.append((1, f, 0, 1.0 * f, 0.5 * f, 1.0))
        if f not in (5, 6):
            rows.append((1, f, 1, 20.0 - f, 10.0, 2.0))
    return rows


def test_tracker(spark):
    df = spark.createDataFrame(seen_clusters(), "sequence long, frame long, cluster long, x double, z double, size double")
    out = tracker.track(df).collect()
    assert {r.track for r in out} == {0, 1}
    last = {r.track: r for r in out if r.frame == 11}
    assert abs(last[0].vx - 1) < 0.1 and abs(last[1].vx + 1) < 0.2 and max(r.missed for r in out) == 2


def test_tracker_stream(spark, tmp_path):
    schema = "sequence long, frame long, cluster long, x double, z double, size double"
    source = str(tmp_path / "in")
    for part in (range(6), range(6, 12)):
        spark.createDataFrame([r for r in seen_clusters() if r[1] in part], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = tracker.track_stream(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = tracker.track(spark.createDataFrame(seen_clusters(), schema))
    key = lambda r: (r.frame, r.track, round(r.x, 6), r.missed)
    assert sorted(map(key, spark.table("tracks").collect())) == sorted(map(key, batch.collect()))


def test_upsampling_is_repeatable(spark):
    df = cloud(spark, np.random.default_rng(12).uniform(0, 4, (40, 3)))
    a, b = (sorted(tuple(r) for r in reduce.upsample(df, 2.0, 3).collect()) for _ in range(2))
    assert a == b and len(a) == 120
