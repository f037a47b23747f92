"""Registration: iterative closest points over grid joins, loop detection, loop closing and graph relaxation.

An iteration is one distributed aggregate that yields one row; the solve is a few numbers on the driver. The model's
cells are joined anew with the moved data, whose pose is a literal: nothing but the pose changes between iterations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import columns, linalg, spatial, statistics

MINIMISERS: dict[str, Callable[[linalg.Moments], np.ndarray]] = {"quaternion": linalg.horn, "svd": linalg.svd, "orthonormal": linalg.orthonormal, "dual": linalg.dual_quaternion, "helix": linalg.helix, "small_angle": linalg.small_angle, "quaternion_scaled": linalg.horn_scaled, "uncertainty_euler": linalg.uncertainty_euler, "uncertainty_quaternion": linalg.uncertainty_quaternion}


def moved(points: DataFrame, pose: np.ndarray) -> DataFrame:
    x, y, z = g.transform(linalg.flat(pose), ("x", "y", "z"))
    return points.withColumns({"x": x, "y": y, "z": z})


def point_to_plane(pairs: DataFrame) -> np.ndarray | None:
    """Small-angle fit of p to the planes of m with normals (nx, ny, nz): the right-hand side is weighted by distance."""
    centre = pairs.agg(F.count("*").alias("n"), *[F.avg(f"p{c}").alias(c) for c in "xyz"]).first()
    if centre.n <= 6:
        return None
    n = ("nx", "ny", "nz")
    p = [F.col(f"p{c}") - float(centre[c]) for c in "xyz"]
    row = [*g.cross(p, n), *map(F.col, n)]
    d = g.dot(g.sub(("mx", "my", "mz"), ("px", "py", "pz")), n)
    sums = pairs.agg(*[F.sum(row[i] * row[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)], *[F.sum(row[i] * d).alias(f"b{i}") for i in range(6)]).first()
    a = np.array([[sums[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    x = np.linalg.lstsq(a, np.array([sums[f"b{i}"] for i in range(6)]), rcond=None)[0]
    c = np.array([centre[k] for k in "xyz"])
    out = np.eye(4)
    out[:3, :3] = linalg.rotation(np.arcsin(np.clip(x[:3], -1, 1)))
    out[:3, 3] = x[3:] + c - out[:3, :3] @ c
    return out


def icp(model: DataFrame, data: DataFrame, radius: float, iterations: int = 50, epsilon: float = 1e-5, minimiser: str = "quaternion", planar: bool = False) -> tuple[np.ndarray, list[float]]:
    """The pose that carries data onto model, and the error of each iteration. Stops when the error settles twice, or
    when there are not more than three pairs, with the pose it has."""
    pose, errors = np.eye(4), []
    fixed = spatial.as_model(model).persist()
    try:
        for _ in range(iterations):
            pairs = spatial.nearest(spatial.as_probe(moved(data, pose)), fixed, radius)
            row = statistics.pair_moments(pairs).first()
            if row is None or row["n"] <= 3:
                break
            k = linalg.Moments(row.asDict())
            pose = _step(k, minimiser, planar) @ pose
            errors.append(k.rms)
            if _settled(errors, epsilon):
                break
    finally:
        fixed.unpersist()
    return pose, errors


def _step(k: linalg.Moments, minimiser: str, planar: bool) -> np.ndarray:
    step = MINIMISERS[minimiser](k)
    if planar:
        angle = linalg.angles(step[:3, :3])
        step = linalg.matrix([step[0, 3], 0, step[2, 3]], [0, angle[1], 0])
    return step


def _settled(errors: list[float], epsilon: float) -> bool:
    return len(errors) > 2 and abs(errors[-1] - errors[-2]) < epsilon and abs(errors[-1] - errors[-3]) < epsilon


def icp_links(points: DataFrame, links: list[tuple[int, int]], radius: float, iterations: int = 50, epsilon: float = 1e-5, minimiser: str = "quaternion", planar: bool = False) -> tuple[dict[int, np.ndarray], dict[int, list[float]]]:
    """icp() of many links (model scan, data scan) at once: poses and errors by data scan. An iteration is one aggregate
    with a row of sums for each link that has not settled; their poses are a small table that the data is joined to."""
    spark = points.sparkSession
    poses = {b: np.eye(4) for _, b in links}
    errors: dict[int, list[float]] = {b: [] for _, b in links}
    live = set(poses)
    pairs = spark.createDataFrame(links, "scan_id int, link int")
    fixed = spatial.as_model(points.join(pairs, "scan_id"), "link").persist()
    try:
        for _ in range(iterations):
            table = spark.createDataFrame([(s, *linalg.flat(poses[s])) for s in sorted(live)], "link int, " + ", ".join(f"w{k} double" for k in range(16)))
            data = points.withColumn("link", F.col("scan_id")).join(table, "link")
            world = data.select("link", "point_id", *[x.alias(c) for c, x in zip("xyz", g.transform([f"w{k}" for k in range(16)], ("x", "y", "z")), strict=True)])
            near = spatial.nearest(spatial.as_probe(world, "link"), fixed, radius, by=("link",))
            rows = {r["link"]: r for r in statistics.pair_moments(near, "link").where("n > 3").collect()}
            for s in sorted(live):
                if s not in rows:
                    live.discard(s)
                    continue
                k = linalg.Moments(rows[s].asDict())
                poses[s] = _step(k, minimiser, planar) @ poses[s]
                errors[s].append(k.rms)
                if _settled(errors[s], epsilon):
                    live.discard(s)
            if not live:
                break
    finally:
        fixed.unpersist()
    return poses, errors


def from_pairs(pairs: DataFrame, minimiser: str = "quaternion", *by: str) -> dict[tuple, np.ndarray]:
    """The pose that carries p onto m for given pairs, for each group of them: three pairs that are no line are enough, as
    for georeferencing; groups of fewer have none."""
    rows = statistics.pair_moments(pairs, *by).where("n >= 3").collect()  # a row for each group
    return {tuple(r[c] for c in by): MINIMISERS[minimiser](linalg.Moments(r.asDict())) for r in rows}


def register_sequence(points: DataFrame, scans: list[int], radius: float, metascan: bool = False, errors: dict[int, list[float]] | None = None, model: str | None = None, **options) -> dict[int, np.ndarray]:
    """Each scan against its "previous" one, against all before it ("metascan"), or always against the "first"; poses in
    the frame of the first. errors receives those of each scan's iterations. What a metascan gathers is written to the
    checkpoint folder scan by scan, so plans do not grow."""
    model = model or ("metascan" if metascan else "previous")
    if model not in ("previous", "first", "metascan"):
        raise ValueError(f"no such model: {model}")
    poses = {scans[0]: np.eye(4)}
    if model != "metascan":  # links do not wait for one another: a link's pose is in the frame of its model
        links = [(scans[0] if model == "first" else a, b) for a, b in zip(scans[:-1], scans[1:], strict=True)]
        found, left = icp_links(points, links, radius, **options) if links else ({}, {})
        for a, b in links:
            poses[b] = poses[a] @ found[b]
        if errors is not None:
            errors.update(left)
        return poses
    done = points.where(F.col("scan_id") == scans[0])
    before = scans[0]
    for s in scans[1:]:
        data = points.where(F.col("scan_id") == s)
        found, left = icp(done, moved(data, poses[before]), radius, **options)
        if errors is not None:
            errors[s] = left
        poses[s] = found @ poses[before]
        before = s
        done = done.unionByName(moved(data, poses[s])).checkpoint()
    return poses


def loops(poses: dict[int, np.ndarray], gap: int, distance: float) -> list[tuple[int, int]]:
    """(first, last) of each loop: while a scan has candidates more than `gap` scans back and nearer than the distance,
    the closest pair so far is kept; the first scan after them that has none, or the end, closes the loop."""
    names = sorted(poses)
    place = {s: poses[s][:3, 3] for s in names}
    out, best = [], None
    for n, s in enumerate(names):
        near = [(float(((place[s] - place[t]) ** 2).sum()), t) for t in names[: max(0, n - gap)]]
        near = [x for x in near if x[0] < distance * distance]
        if near:
            d, t = min(near)
            best = min(best, (d, t, s)) if best else (d, t, s)
        elif best:
            out.append(best[1:])
            best = None
    return [*out, best[1:]] if best else out


def distance_links(poses: dict[int, np.ndarray], distance: float) -> list[tuple[int, int]]:
    """Neighbours in order, and all pairs nearer than the distance."""
    names = sorted(poses)
    far = lambda a, b: float(((poses[a][:3, 3] - poses[b][:3, 3]) ** 2).sum())
    return [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if b == names[n + 1] or far(a, b) < distance * distance]


def match(points: DataFrame, scans: list[int], radius: float, gap: int = 20, loop_distance: float = 500.0, slam_radius: float | None = None, slam_iterations: int = 10, closing: str = "slerp", method: str = "euler", **options) -> dict[int, np.ndarray]:
    """The whole of a registration: scans one after another, loops found and closed, and all links relaxed."""
    poses = register_sequence(points, scans, radius, **options)
    for first, last in loops(poses, gap, loop_distance):
        chain = [s for s in scans if first <= s <= last]
        here = moved(points.where(F.col("scan_id") == last), poses[last])
        error, _ = icp(moved(points.where(F.col("scan_id") == first), poses[first]), here, loop_distance, **options)
        edges = [(a, b, float(np.linalg.norm(poses[a][:3, 3] - poses[b][:3, 3])) + 1e-9) for a, b in zip(chain[:-1], chain[1:], strict=True)]
        closed = close_loop({s: poses[s] for s in chain}, edges, error, closing)
        rest = closed[last] @ np.linalg.inv(poses[last])
        poses |= closed | {s: rest @ poses[s] for s in scans if s > last}
    if slam_radius:
        poses, _ = relax(points, poses, distance_links(poses, loop_distance), slam_radius, slam_iterations, method=method)
    return poses


def loop_candidates(poses: DataFrame, gap: int, distance: float) -> DataFrame:
    """(a, b, d2): positions nearer than the distance whose numbers differ by more than the gap; a grid join."""
    p = poses.select(F.col("scan_id").alias("pid"), *[F.col(f"t{c}").alias(f"p{c}") for c in "xyz"])
    m = poses.select(F.col("scan_id").alias("mid"), *[F.col(f"t{c}").alias(f"m{c}") for c in "xyz"])
    return spatial.pairs(p, m, distance).where(F.col("mid") - F.col("pid") > gap).select(F.col("pid").alias("a"), F.col("mid").alias("b"), "d2")


def overlap_links(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(a, b, pairs): directed links of scans with more than `least` points that have a neighbour in the other."""
    p, at = spatial.as_probe(points, F.col("scan_id").alias("a")), [*spatial.P, "a"]
    found = columns.kind(spatial.as_model(points, "scan_id"), ("scan_id",))
    if found is not None and found.dense * 2 * radius >= 16:
        told = spatial.told_apart(p, ("a",))
        every, shared = columns.scans_near(told, radius, found), spatial.rest(told)
        if shared is not None:
            near = spatial.pairs(shared, spatial.as_model(points, F.col("scan_id").alias("b")), radius).where("a <> b")
            every = every.unionByName(near.select("pid", "a", "b").distinct().select("a", "b", F.lit(1).cast("long").alias("copies")))
        return every.groupBy(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).agg(F.sum("copies").alias("pairs")).where(F.col("pairs") > least)
    held = p.groupBy(*at).agg(F.count("*").alias("copies")).checkpoint()
    places = held.groupBy(*[F.col(c).alias(m) for c, m in zip(spatial.P, spatial.M, strict=True)]).agg(F.collect_set("a").alias("scans")).checkpoint()
    # a place asks once for all scans there; its points are told by their number alone
    spots = places.select(*[F.col(m).alias(c) for c, m in zip(spatial.P, spatial.M, strict=True)])
    seen = spatial.pairs(spots, places, radius).groupBy(*spatial.P).agg(F.array_distinct(F.flatten(F.collect_set("scans"))).alias("near")).checkpoint()
    linked = lambda d: d.join(seen, [*spatial.P]).withColumn("b", F.explode("near")).where("a <> b")
    # points that share an id in a scan are one point at several places, and count once
    several = p.groupBy("pid", "a").agg(F.count("*").alias("n")).where("n > 1").select("pid", "a").checkpoint()
    n = several.count()
    if n:
        there = p.join(spatial.few(several, n), ["pid", "a"], "left_semi").checkpoint()
        held = held.join(there.groupBy(*at).agg(F.count("*").alias("less")), at, "left").withColumn("copies", F.col("copies") - F.coalesce("less", F.lit(0)))
    every = linked(held).select("a", "b", "copies")
    if n:
        every = every.unionByName(linked(there).select("pid", "a", "b").distinct().select("a", "b", F.lit(1).cast("long").alias("copies")))
    return every.groupBy("a", "b").agg(F.sum("copies").alias("pairs")).where(F.col("pairs") > least)


def relaxation_sums(pairs: DataFrame, scaled: bool = False, copies: str | None = None) -> DataFrame:
    """For each link (a, b) the sums that its system is made of; rotations are about x, z and y in that order, and a scale
    comes last if it is asked for. A row stands for so many pairs as the column `copies` says."""
    total = statistics.weighted(copies)
    u = [(F.col(f"m{c}") + F.col(f"p{c}")) / 2 for c in "xyz"]
    d = [F.col(f"m{c}") - F.col(f"p{c}") for c in "xyz"]
    (x, y, z), (dx, dy, dz) = u, d
    zero, one = F.lit(0.0), F.lit(1.0)
    # the rows of the linearised residual: translation, then rotations about x, z, y
    rows = [[one, zero, zero, zero, -y, z], [zero, one, zero, -z, x, zero], [zero, zero, one, y, zero, -x]]
    if scaled:
        rows = [[*r, c] for r, c in zip(rows, u, strict=True)]
    size = len(rows[0])
    products = [total(sum((rows[r][i] * rows[r][j] for r in range(3)), zero)).alias(f"a{i}{j}") for i in range(size) for j in range(i, size)]
    right = [total(rows[0][i] * dx + rows[1][i] * dy + rows[2][i] * dz).alias(f"b{i}") for i in range(size)]
    n = F.sum(copies) if copies else F.count("*")
    return pairs.groupBy("a", "b").agg(n.alias("n"), *products, *right, total(dx * dx + dy * dy + dz * dz).alias("dd"))


def _steps(pairs: DataFrame, names: list[int], method: str) -> dict[int, np.ndarray]:
    """What each scan but the first is to be moved by, from the pairs of all links."""
    number = {s: k for k, s in enumerate(names)}
    if method in ("helix", "small_angle"):
        rows = statistics.pair_moments(pairs, "a", "b", copies="copies").collect()  # one row for each link
        if not rows:
            return {}
        x = linalg.field_system(len(names), [(number[r["a"]], number[r["b"]], linalg.Moments(r.asDict())) for r in rows])
        if method == "helix":
            return {s: linalg.screw(x[k, 3:], x[k, :3]) for k, s in enumerate(names) if k}
        return {s: linalg.matrix(x[k, :3], np.arcsin(np.clip(x[k, 3:], -1, 1))) for k, s in enumerate(names) if k}
    if method not in ("euler", "quaternion"):
        raise ValueError(f"no such relaxation: {method}")
    size = 7 if method == "quaternion" else 6
    system = []
    for r in relaxation_sums(pairs, method == "quaternion", "copies").collect():  # one row for each link
        mm = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(size)] for i in range(size)])
        mz = np.array([r[f"b{i}"] for i in range(size)])
        d = np.linalg.lstsq(mm, mz, rcond=None)[0]
        # a perfect fit has no variance; the floor keeps its weight finite
        ss = max((r["dd"] - d @ mz) / max(2 * r["n"] - 3, 1), 1e-13)
        system.append((number[r["a"]], number[r["b"]], mm / ss, mz / ss))
    if not system:
        return {}
    x = linalg.link_system(len(names), system)
    # b of a link is to move by minus its share of the difference m - p; a scale is no motion
    return {s: linalg.matrix(-x[k, :3], [-x[k, 3], -x[k, 5], -x[k, 4]]) for k, s in enumerate(names) if k}


def relax(points: DataFrame, poses: dict[int, np.ndarray], links: list[tuple[int, int]], radius: float, iterations: int = 10, epsilon: float = 1e-5, method: str = "euler") -> tuple[dict[int, np.ndarray], list[float]]:
    """Moves all poses but the first so that all links agree best; returns the mean correction of each iteration.

    method: "euler" and "quaternion" weigh links by their uncertainty; "helix" and "small_angle" solve for the velocity
    fields of all scans at once. Copies at one place of a scan move alike: they are one row with their number."""
    spark = points.sparkSession
    points = points.groupBy("scan_id", "x", "y", "z").agg(F.min("point_id").alias("point_id"), F.count("*").alias("copies")).persist()
    try:
        return _relaxed(spark, points, poses, links, radius, iterations, epsilon, method)
    finally:
        points.unpersist()


def _relaxed(spark, points: DataFrame, poses: dict[int, np.ndarray], links: list[tuple[int, int]], radius: float, iterations: int, epsilon: float, method: str) -> tuple[dict[int, np.ndarray], list[float]]:
    names = sorted(poses)
    poses, moves = dict(poses), []
    edges = spark.createDataFrame(links, "a int, b int")
    fixed = spatial.as_model(points.select("scan_id", "point_id", "x", "y", "z"), F.col("scan_id").alias("a"))
    found, edge = columns.kind(fixed, ("a",)), None
    if found is not None and found.dense * 2 * radius >= 2:
        edge = columns.slab_edge(found, columns.span_of(fixed, "my"), len(names), radius)
    if edge and found.points <= columns.HELD:
        fixed = columns.held(fixed, "a")
    for _ in range(iterations):
        if edge:
            near = _pairs_as_scanned(spark, points, fixed, poses, links, radius, edge)
        else:
            near = _pairs_in_world(spark, points, edges, poses, names, radius)
        steps = _steps(near, names, method)
        if not steps:
            break
        total = 0.0
        for s, step in steps.items():
            before = poses[s][:3, 3].copy()
            poses[s] = step @ poses[s]
            poses[s][:3, :3] = linalg.nearest_rotation(poses[s][:3, :3])
            total += float(np.linalg.norm(poses[s][:3, 3] - before))
        moves.append(total / max(1, len(names) - 1))
        if moves[-1] <= epsilon:
            break
    return poses, moves


def _pairs_in_world(spark, points: DataFrame, edges: DataFrame, poses: dict[int, np.ndarray], names: list[int], radius: float) -> DataFrame:
    # a row of twelve numbers for each scan
    table = spark.createDataFrame([(s, *linalg.flat(poses[s])) for s in names], "s int, " + ", ".join(f"w{k} double" for k in range(16)))
    at = points.join(table, F.col("scan_id") == F.col("s"))
    world = at.select("scan_id", "point_id", "copies", *[x.alias(c) for c, x in zip("xyz", g.transform([f"w{k}" for k in range(16)], ("x", "y", "z")), strict=True)])
    m = spatial.as_model(world, F.col("scan_id").alias("a")).join(edges, "a").select("mid", "mx", "my", "mz", "a", "b")
    p = spatial.as_probe(world, F.col("scan_id").alias("b"), "copies").join(edges, "b").select("pid", "px", "py", "pz", "copies", "a", "b")
    return spatial.nearest(p, m, radius, by=("a", "b"))


def _pairs_as_scanned(spark, points: DataFrame, fixed: DataFrame, poses: dict[int, np.ndarray], links: list[tuple[int, int]], radius: float, edge: float) -> DataFrame:
    """The pairs of all links, for scans of few columns: a search in the frame in which scan a was taken, where its columns
    stand upright whatever its pose, as rigid motions change no distance."""
    rows = [(a, b, *linalg.flat(np.linalg.inv(poses[a]) @ poses[b]), *linalg.flat(poses[a])) for a, b in links]
    names = [f"{w}{k}" for w in "vw" for k in range(16)]
    table = F.broadcast(spark.createDataFrame(rows, "a int, b int, " + ", ".join(f"{c} double" for c in names)))
    at = points.join(table, F.col("scan_id") == F.col("b"))
    p = at.select("a", "b", "copies", *[x.alias(f"p{c}") for c, x in zip("xyz", g.transform([f"v{k}" for k in range(16)], ("x", "y", "z")), strict=True)])
    near = columns.nearest(p, fixed, radius, edge, "a").join(table, ["a", "b"])
    world = {f"{s}{c}": x for s in "pm" for c, x in zip("xyz", g.transform([f"w{k}" for k in range(16)], (f"{s}x", f"{s}y", f"{s}z")), strict=True)}
    return near.select("a", "b", "copies", *[x.alias(c) for c, x in world.items()])


def close_loop(poses: dict[int, np.ndarray], edges: list[tuple[int, int, float]], error: np.ndarray, method: str = "slerp") -> dict[int, np.ndarray]:
    """Spreads the loop error of the last pose over all, in shares by path length. method: a share of a rotation is that
    of its angle about its axis ("slerp"), of its Euler angles ("euler"), or of its quaternion ("quaternion")."""
    names = sorted(poses)
    number = {s: k for k, s in enumerate(names)}
    share = linalg.balance(len(names), [(number[a], number[b], w) for a, b, w in edges], 0, len(names) - 1)
    r = error[:3, :3]
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    axis = axis / max(np.linalg.norm(axis), 1e-12)
    kx = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    out = {}
    for s in names:
        w = share[number[s]]
        part = np.eye(4)
        if method == "slerp":
            part[:3, :3] = np.eye(3) + np.sin(w * angle) * kx + (1 - np.cos(w * angle)) * kx @ kx
        elif method == "euler":
            part[:3, :3] = linalg.rotation(w * linalg.angles(r))
        elif method == "quaternion":
            part[:3, :3] = linalg.quaternion_rotation(np.r_[1 - w + w * np.cos(angle / 2), w * np.sin(angle / 2) * axis])
        else:
            raise ValueError(f"no such way to close a loop: {method}")
        part[:3, 3] = w * error[:3, 3]
        out[s] = part @ poses[s]
    return out
