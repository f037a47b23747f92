"""Small dense algebra for the driver: rigid fits from moments, Euler matrices, link systems. Inputs are a few numbers."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np

AXES = "xyz"


def matrix(position, angles) -> np.ndarray:
    """4x4, R = Rx Ry Rz (radians)."""
    out = np.eye(4)
    out[:3, :3] = rotation(angles)
    out[:3, 3] = position
    return out


def rotation(angles) -> np.ndarray:
    a, b, c = angles
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    return rx @ ry @ rz


def angles(r: np.ndarray) -> np.ndarray:
    b = math.asin(min(1.0, max(-1.0, r[0, 2])))
    b = b if r[0, 0] > 0 else math.pi - b
    c = math.cos(b)
    if abs(c) > 0.005:
        return np.array([math.atan2(-r[1, 2] / c, r[2, 2] / c), b, math.atan2(-r[0, 1] / c, r[0, 0] / c)])
    return np.array([0.0, b, math.atan2(r[1, 0], r[1, 1])])


def flat(m: np.ndarray) -> list[float]:
    """Column-major."""
    return m.T.reshape(-1).tolist()


def quaternion_rotation(q) -> np.ndarray:
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def nearest_rotation(a: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(a)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v


class Moments:
    """A row of pair_moments, as arrays about the centroids. m is fixed, p moves."""

    def __init__(self, row: Mapping) -> None:
        self.n = row["n"]
        self.m, self.p = (np.array([row[f"s{s}{c}"] for c in AXES]) / self.n for s in "mp")
        self.cross = np.array([[row[f"p{a}m{b}"] for b in AXES] for a in AXES]) - self.n * np.outer(self.p, self.m)  # rows: p
        self.spread_m = row["qm"] - self.n * self.m @ self.m
        self.spread_p = row["qp"] - self.n * self.p @ self.p
        # products of p with itself, for the linearised fits, if the row has them
        self.second = np.array([[row[f"p{min(a, b)}p{max(a, b)}"] for b in AXES] for a in AXES]) if "pxpx" in row else None
        self.second_m = np.array([[row[f"m{min(a, b)}m{max(a, b)}"] for b in AXES] for a in AXES]) if "mxmx" in row else None
        self.rms = math.sqrt(max(0.0, row["d2"]) / self.n)

    def pose(self, r: np.ndarray, s: float = 1.0) -> np.ndarray:
        out = np.eye(4)
        out[:3, :3] = s * r
        out[:3, 3] = self.m - s * r @ self.p
        return out


def horn(k: Moments) -> np.ndarray:
    s = k.cross / k.n
    q = np.empty((4, 4))
    q[0, 0] = np.trace(s)
    q[0, 1:] = q[1:, 0] = [s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]]
    q[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    return k.pose(quaternion_rotation(np.linalg.eigh(q)[1][:, -1]))


def horn_scaled(k: Moments) -> np.ndarray:
    return k.pose(horn(k)[:3, :3], math.sqrt(k.spread_m / k.spread_p))


def svd(k: Moments) -> np.ndarray:
    u, _, v = np.linalg.svd(k.cross)
    v = v.T
    if np.linalg.det(v @ u.T) < 0:
        v[:, 2] = -v[:, 2]
    return k.pose(v @ u.T)


def orthonormal(k: Moments) -> np.ndarray:
    h = k.cross.T
    w, e = np.linalg.eigh(h.T @ h)
    return k.pose(h @ e @ np.diag(1 / np.sqrt(np.maximum(w, 1e-300))) @ e.T)


def dual_quaternion(k: Moments) -> np.ndarray:
    """The rotation and translation of a unit dual quaternion that fits the pairs (Walker's form)."""
    c1, c3 = np.zeros((4, 4)), 2 * np.array([_left(k.m) - _right(k.p)])[0] * k.n
    full = k.cross + k.n * np.outer(k.p, k.m)
    for a in range(3):
        for b in range(3):
            c1 -= 2 * full[a, b] * _left(np.eye(3)[b]).T @ _right(np.eye(3)[a])
    a = 0.5 * (c3.T @ c3 / (2 * k.n) - c1 - c1.T)
    q = np.linalg.eigh((a + a.T) / 2)[1][:, -1]
    s = -c3 @ q / (2 * k.n)
    w = _right(q[:3], q[3]).T
    out = np.eye(4)
    out[:3, :3] = (w @ _left(q[:3], q[3]))[:3, :3]
    out[:3, 3] = 2 * (w @ s)[:3]
    return out if np.isfinite(out).all() and np.allclose(k.m, out[:3, :3] @ k.p + out[:3, 3], atol=1e-6 * (1 + np.abs(k.m).max())) else horn(k)


def _left(v, w: float = 0.0) -> np.ndarray:
    x, y, z = v
    return np.array([[w, -z, y, x], [z, w, -x, y], [-y, x, w, z], [-x, -y, -z, w]])


def _right(v, w: float = 0.0) -> np.ndarray:
    x, y, z = v
    return np.array([[w, z, -y, x], [-z, w, x, y], [y, -x, w, z], [-x, -y, -z, w]])


def small_angle(k: Moments) -> np.ndarray:
    """Least squares for angles whose sines stand for them; the identity for at most three pairs."""
    if k.n <= 3:
        return np.eye(4)
    second = k.second - k.n * np.outer(k.p, k.p)
    a = np.trace(second) * np.eye(3) - second
    b = np.array([k.cross[1, 2] - k.cross[2, 1], k.cross[2, 0] - k.cross[0, 2], k.cross[0, 1] - k.cross[1, 0]])
    x = np.clip(np.linalg.solve(a, b), -1, 1)
    return k.pose(rotation(np.arcsin(x)))


def helix(k: Moments) -> np.ndarray:
    """The velocity field c x p + t that carries p towards m, turned into a screw motion about its axis."""
    second = k.second
    a = np.zeros((6, 6))
    a[:3, :3] = np.trace(second) * np.eye(3) - second
    skew = _skew(k.n * k.p)
    a[:3, 3:], a[3:, :3], a[3:, 3:] = skew, skew.T, k.n * np.eye(3)
    full = k.cross + k.n * np.outer(k.p, k.m)
    x = np.linalg.solve(a, np.r_[_axial(full), k.n * (k.m - k.p)])
    return screw(x[:3], x[3:])


def _skew(v) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def _axial(products: np.ndarray) -> np.ndarray:
    """The sum of p x m from the sums of p_i m_j."""
    return np.array([products[1, 2] - products[2, 1], products[2, 0] - products[0, 2], products[0, 1] - products[1, 0]])


def screw(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The screw motion of the velocity field c x p + t."""
    out = np.eye(4)
    angle = np.linalg.norm(c)
    if angle < 1e-12:
        out[:3, 3] = t
        return out
    g = c / angle
    pitch = g @ t / angle
    point = np.cross(g, (t - pitch * c) / angle)
    turn = math.atan(angle)
    kx = _skew(g)
    r = np.eye(3) + math.sin(turn) * kx + (1 - math.cos(turn)) * kx @ kx
    out[:3, :3] = r
    out[:3, 3] = point - r @ point + pitch * turn * g
    return out


def _midway(k: Moments, scaled: bool) -> np.ndarray:
    """Least squares of m - p = t + c x u (+ s u) over u, the middle of each pair. With the Gibbs vector c / 2 this is a
    rigid motion and no approximation of one; a scale takes up what is not rigid and is left out."""
    full = k.cross + k.n * np.outer(k.p, k.m)  # sums of p_i m_j
    mid = (k.p + k.m) / 2 * k.n
    second = (k.second + k.second_m + full + full.T) / 4
    a = np.zeros((7, 7))
    a[:3, :3] = k.n * np.eye(3)
    a[:3, 3:6], a[3:6, :3] = -_skew(mid), _skew(mid)
    a[3:6, 3:6] = np.trace(second) * np.eye(3) - second
    a[:3, 6] = a[6, :3] = mid
    a[6, 6] = np.trace(second)
    b = np.r_[k.n * (k.m - k.p), _axial(full), (np.trace(k.second_m) - np.trace(k.second)) / 2]
    size = 7 if scaled else 6
    x = np.linalg.lstsq(a[:size, :size], b[:size], rcond=None)[0]
    half = _skew(x[3:6] / 2)
    out = np.eye(4)
    out[:3, :3] = np.linalg.solve(np.eye(3) - half, np.eye(3) + half)
    out[:3, 3] = np.linalg.solve(np.eye(3) - half, x[:3])
    return out


def uncertainty_euler(k: Moments) -> np.ndarray:
    return _midway(k, False)


def uncertainty_quaternion(k: Moments) -> np.ndarray:
    return _midway(k, True)


def field_blocks(k: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a link, over velocity fields (t, c): the products of the rows of m and m, p and p, m and p, and of both with
    m - p, whose sums over m and over p are the same."""
    full = k.cross + k.n * np.outer(k.p, k.m)

    def block(x: np.ndarray, y: np.ndarray, products: np.ndarray) -> np.ndarray:
        out = np.zeros((6, 6))
        out[:3, :3] = k.n * np.eye(3)
        out[:3, 3:], out[3:, :3] = -_skew(y), _skew(x)
        out[3:, 3:] = np.trace(products) * np.eye(3) - products.T
        return out

    m, p = k.n * k.m, k.n * k.p
    return block(m, m, k.second_m), block(p, p, k.second), block(m, p, full.T), np.r_[m - p, _axial(full)]


def field_system(n: int, links: list[tuple[int, int, Moments]]) -> np.ndarray:
    """The velocity fields (t, c) of all nodes but node 0 that bring the links together best; one row for each node."""
    a, b = np.zeros((6 * n, 6 * n)), np.zeros(6 * n)
    for i, j, k in links:
        mm, pp, mp, r = field_blocks(k)
        at, to = slice(6 * i, 6 * i + 6), slice(6 * j, 6 * j + 6)
        a[at, at] += mm
        a[to, to] += pp
        a[at, to] -= mp
        a[to, at] -= mp.T
        b[at] -= r
        b[to] += r
    x = np.zeros(6 * n)
    x[6:] = np.linalg.lstsq(a[6:, 6:], b[6:], rcond=None)[0]
    return x.reshape(n, 6)


def determinant_inverse(m: np.ndarray, least: float) -> tuple[float, np.ndarray | None]:
    """The determinant and the inverse, or none where the determinant's size is below `least`."""
    d = float(np.linalg.det(m))
    return d, (np.linalg.inv(m) if abs(d) >= least else None)


def link_system(n: int, links: list[tuple[int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Solves a relaxation over links (a, b, C, C D) with node 0 fixed; one row of corrections for each node."""
    k = len(links[0][3])
    g, b = np.zeros((n * k, n * k)), np.zeros(n * k)
    for i, j, c, cd in links:
        at, to = slice(i * k, i * k + k), slice(j * k, j * k + k)
        g[at, at] += c
        g[to, to] += c
        g[at, to] -= c
        g[to, at] -= c
        b[at] += cd
        b[to] -= cd
    x = np.zeros(n * k)
    x[k:] = np.linalg.lstsq(g[k:, k:], b[k:], rcond=None)[0]
    return x.reshape(n, k)


def balance(n: int, edges: list[tuple[int, int, float]], first: int, last: int) -> np.ndarray:
    """Shares of a loop's error for each node: 0 at first, 1 at last, by path length; nodes off the path take their
    nearest path node's share."""
    near: dict[int, list[tuple[int, float]]] = {k: [] for k in range(n)}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))

    def paths(sources: dict[int, float]) -> tuple[dict[int, float], dict[int, int]]:
        import heapq

        dist, prev = dict(sources), {}
        queue = [(d, k) for k, d in sources.items()]
        heapq.heapify(queue)
        while queue:
            d, k = heapq.heappop(queue)
            if d > dist[k]:
                continue
            for to, w in near[k]:
                if d + w < dist.get(to, math.inf):
                    dist[to], prev[to] = d + w, k
                    heapq.heappush(queue, (d + w, to))
        return dist, prev

    dist, prev = paths({first: 0.0})
    share = np.zeros(n)
    path = [last]
    while path[-1] != first:
        path.append(prev[path[-1]])
    for k in path:
        share[k] = dist[k] / dist[last]
    on = dict.fromkeys(path, 0.0)
    _, prev = paths(on)
    for k in range(n):
        at = k
        while at not in on and at in prev:
            at = prev[at]
        share[k] = share[at] if at in on else 0.0
    return share
