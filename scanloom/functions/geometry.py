"""Geometry as column expressions: vectors, rigid transforms, rotations, polar and earth coordinates, cells.

Matrices are sixteen numbers in column-major order (translation at 12, 13, 14). Rotations are R = Rx Ry Rz. Quaternions
are (w, x, y, z). Angles are radians unless a name says degrees.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def dot(a: Sequence[Number], b: Sequence[Number]) -> Column:
    return reduce(lambda s, t: s + t, (col(x) * col(y) for x, y in zip(a, b, strict=True)))


def square(a: Sequence[Number]) -> Column:
    return dot(a, a)


def length(a: Sequence[Number]) -> Column:
    return F.sqrt(square(a))


def sub(a: Sequence[Number], b: Sequence[Number]) -> list[Column]:
    return [col(x) - col(y) for x, y in zip(a, b, strict=True)]


def add(a: Sequence[Number], b: Sequence[Number]) -> list[Column]:
    return [col(x) + col(y) for x, y in zip(a, b, strict=True)]


def scale(a: Sequence[Number], s: Number) -> list[Column]:
    return [col(x) * col(s) for x in a]


def cross(a: Sequence[Number], b: Sequence[Number]) -> list[Column]:
    (x, y, z), (u, v, w) = ([col(t) for t in p] for p in (a, b))
    return [y * w - z * v, z * u - x * w, x * v - y * u]


def normalized(a: Sequence[Number]) -> list[Column]:
    """The direction of a; null for the zero vector."""
    n = F.nullif(length(a), F.lit(0.0))
    return [col(x) / n for x in a]


def transform(m: Sequence[Number], p: Sequence[Number]) -> list[Column]:
    return [dot([m[k], m[4 + k], m[8 + k]], p) + col(m[12 + k]) for k in range(3)]


def transform_normal(m: Sequence[Number], n: Sequence[Number]) -> list[Column]:
    """By the transpose of the rotation, as normals are stored against poses."""
    return [dot(m[4 * k : 4 * k + 3], n) for k in range(3)]


def multiply(a: Sequence[Number], b: Sequence[Number]) -> list[Column]:
    return [dot([a[r], a[4 + r], a[8 + r], a[12 + r]], b[4 * c : 4 * c + 4]) for c in range(4) for r in range(4)]


def rigid_inverse(m: Sequence[Number]) -> list[Column]:
    """Of a rotation and a translation: transpose, and the translation turned back."""
    zero, one = F.lit(0.0), F.lit(1.0)
    t = [-dot(m[4 * k : 4 * k + 3], m[12:15]) for k in range(3)]
    rows = [[col(m[0]), col(m[4]), col(m[8]), zero], [col(m[1]), col(m[5]), col(m[9]), zero], [col(m[2]), col(m[6]), col(m[10]), zero]]
    return [*rows[0], *rows[1], *rows[2], *t, one]


def euler_matrix(position: Sequence[Number], angles: Sequence[Number]) -> list[Column]:
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(col(a)), F.cos(col(a))) for a in angles)
    zero = F.lit(0.0)
    first = [cy * cz, cx * sz + sx * sy * cz, sx * sz - cx * sy * cz, zero]
    second = [-(cy * sz), cx * cz - sx * sy * sz, sx * cz + cx * sy * sz, zero]
    third = [sy, -(sx * cy), cx * cy, zero]
    return [*first, *second, *third, *map(col, position), F.lit(1.0)]


def matrix_euler(m: Sequence[Number]) -> list[Column]:
    """The angles of euler_matrix; the second is in the half that the first element's sign names, and near the pole the
    first angle is zero."""
    m = [col(x) for x in m]
    inner = F.asin(F.least(F.greatest(m[8], F.lit(-1.0)), F.lit(1.0)))
    y = F.when(m[0] > 0, inner).otherwise(F.pi() - inner)
    c = F.cos(y)
    away = F.abs(c) > 0.005
    return [F.when(away, F.atan2(-m[9] / c, m[10] / c)).otherwise(0.0), y, F.when(away, F.atan2(-m[4] / c, m[0] / c)).otherwise(F.atan2(m[1], m[5]))]


def quaternion_matrix(q: Sequence[Number], t: Sequence[Number] = (0, 0, 0)) -> list[Column]:
    w, x, y, z = (col(a) for a in q)
    zero, one = F.lit(0.0), F.lit(1.0)
    return [
        one - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y), zero,
        2 * (x * y - w * z), one - 2 * (x * x + z * z), 2 * (y * z + w * x), zero,
        2 * (x * z + w * y), 2 * (y * z - w * x), one - 2 * (x * x + y * y), zero,
        *map(col, t), one,
    ]


def matrix_quaternion(m: Sequence[Number]) -> list[Column]:
    """Unit quaternion of the rotation, from the largest of the four squares; w is not negative away from half turns."""
    m = [col(x) for x in m]
    one = F.lit(1.0)
    squares = [one + m[0] + m[5] + m[10], one + m[0] - m[5] - m[10], one + m[5] - m[0] - m[10], one + m[10] - m[0] - m[5]]
    antis, syms = (m[6] - m[9], m[8] - m[2], m[1] - m[4]), (m[4] + m[1], m[2] + m[8], m[9] + m[6])
    root = [F.sqrt(F.greatest(s, F.lit(1e-300))) * 2 for s in squares]
    # rows: which component is taken from its own square; columns: w, x, y, z
    by = [
        [root[0] / 4, antis[0] / root[0], antis[1] / root[0], antis[2] / root[0]],
        [antis[0] / root[1], root[1] / 4, syms[0] / root[1], syms[1] / root[1]],
        [antis[1] / root[2], syms[0] / root[2], root[2] / 4, syms[2] / root[2]],
        [antis[2] / root[3], syms[1] / root[3], syms[2] / root[3], root[3] / 4],
    ]
    pick = [squares[0] > 1e-8, (m[0] > m[5]) & (m[0] > m[10]), m[5] > m[10]]
    return [F.when(pick[0], by[0][k]).when(pick[1], by[1][k]).when(pick[2], by[2][k]).otherwise(by[3][k]) for k in range(4)]


def quaternion_product(a: Sequence[Number], b: Sequence[Number]) -> list[Column]:
    (w, x, y, z), (p, q, r, s) = ([col(t) for t in v] for v in (a, b))
    return [w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p]


def slerp(a: Sequence[Number], b: Sequence[Number], t: Number) -> list[Column]:
    """Without a change of sign for the short way; the midpoint where the two are nearly alike or opposite."""
    c = F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(c)
    s = F.sqrt(1 - c * c)
    flat = s < 0.001
    wa = F.when(flat, 0.5).otherwise(F.sin((1 - col(t)) * angle) / s)
    wb = F.when(flat, 0.5).otherwise(F.sin(col(t) * angle) / s)
    return [col(x) * wa + col(y) * wb for x, y in zip(a, b, strict=True)]


def quaternion_distance_degrees(a: Sequence[Number], b: Sequence[Number]) -> Column:
    return F.degrees(2 * F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0))))


def axis_angle(q: Sequence[Number]) -> list[Column]:
    """(x, y, z, angle); the x axis for no rotation."""
    n = length(q[1:])
    still = n < 1e-12
    return [F.when(still, 1.0 if k == 0 else 0.0).otherwise(col(x) / n) for k, x in enumerate(q[1:])] + [2 * F.atan2(n, col(q[0]))]


def polar(p: Sequence[Number]) -> list[Column]:
    """Inclination from z, azimuth in [0, 2 pi), range; azimuth 0 within 0.0001 of the poles, nulls at the origin."""
    x, y, z = (col(t) for t in p)
    r = length(p)
    phi = F.acos(z / F.nullif(r, F.lit(0.0)))
    at_pole = (F.abs(phi) < 1e-4) | (F.abs(F.pi() - phi) < 1e-4)
    theta = F.atan2(y, x)
    return [phi, F.when(at_pole, 0.0).otherwise(F.when(theta < 0, theta + 2 * F.pi()).otherwise(theta)), r]


def cartesian(p: Sequence[Number]) -> list[Column]:
    phi, theta, r = (col(t) for t in p)
    return [r * F.cos(theta) * F.sin(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(phi)]


def polar_distance(a: Sequence[Number], b: Sequence[Number]) -> Column:
    s = F.sin(col(a[0])) * F.sin(col(b[0]))
    return F.acos(F.least(F.greatest(s * F.cos(col(a[1]) - col(b[1])) + F.cos(col(a[0])) * F.cos(col(b[0])), F.lit(-1.0)), F.lit(1.0)))


def cell(x: Number | str, edge: float) -> Column:
    """Floor division: cells of one width everywhere."""
    return F.floor(col(x) / edge).cast("long")


def truncated_cell(x: Number | str, edge: float) -> Column:
    """Division towards zero: the middle cell has double width."""
    return (col(x) / edge).cast("long")


#: The WGS84 ellipsoid and the UTM scale.
WGS84_A, WGS84_B, WGS84_E2, UTM_K0 = 6378137.0, 6356752.31424518, 0.00669437999014, 0.9996


def lla_ecef(lat: Number, lon: Number, alt: Number, left_handed: bool = False) -> list[Column]:
    """Degrees and metres to earth-centred centimetres."""
    lat, lon, alt = F.radians(col(lat)), F.radians(col(lon)), col(alt)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    x, y, z = (n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - WGS84_E2) + alt) * F.sin(lat)
    return [-y * 100, z * 100, x * 100] if left_handed else [x * 100, y * 100, z * 100]


def ecef_lla(p: Sequence[Number]) -> list[Column]:
    """The inverse of lla_ecef, by the closed form with one correction term."""
    x, y, z = (col(t) / 100 for t in p)
    r = F.sqrt(x * x + y * y)
    u = F.atan2(z * WGS84_A, r * WGS84_B)
    second = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    lat = F.atan2(z + second * WGS84_B * F.pow(F.sin(u), 3), r - WGS84_E2 * WGS84_A * F.pow(F.cos(u), 3))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return [F.degrees(lat), F.degrees(F.atan2(y, x)), r / F.cos(lat) - n]


def ecef_enu(p: Sequence[Number], lat: Number, lon: Number, origin: Sequence[Number]) -> list[Column]:
    """East, north and up around an origin, by the textbook rotation."""
    lat, lon = F.radians(col(lat)), F.radians(col(lon))
    d = sub(p, origin)
    return [dot([-F.sin(lon), F.cos(lon), F.lit(0.0)], d), dot([-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)], d), dot([F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)], d)]


def lla_utm(lat: Number, lon: Number) -> list[Column]:
    """Zone, easting and northing in metres (south of the equator with a false northing)."""
    lat, lon = col(lat), col(lon)
    zone = F.floor((lon + 180) / 6) + 1
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e2 = WGS84_E2
    second = e2 / (1 - e2)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c, a = F.pow(F.tan(phi), 2), second * F.pow(F.cos(phi), 2), F.cos(phi) * dl
    m = WGS84_A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = UTM_K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(a, 5) / 120) + 500000
    north = UTM_K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(a, 6) / 720))
    return [zone.cast("int"), east, F.when(lat < 0, north + 10000000).otherwise(north)]


def line_distance2(p: Sequence[Number], a: Sequence[Number], direction: Sequence[Number]) -> Column:
    """Squared distance of p to the infinite line through a along a unit direction."""
    v = sub(p, a)
    along = dot(v, direction)
    return F.greatest(square(v) - along * along, F.lit(0.0))


def segment_distance2(p: Sequence[Number], a: Sequence[Number], b: Sequence[Number]) -> Column:
    d, v = sub(b, a), sub(p, a)
    t = F.least(F.greatest(dot(v, d) / F.nullif(square(d), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return square(sub(v, scale(d, F.coalesce(t, F.lit(0.0)))))


def determinant(m: Sequence[Number]) -> Column:
    """Of the rotation block of sixteen numbers."""
    return dot(m[0:3], cross(m[4:7], m[8:11]))


def same_side(p: Sequence[Number], q: Sequence[Number], a: Sequence[Number], b: Sequence[Number]) -> Column:
    """Whether p and q, points of a plane, are on one side of the line through a and b, the line itself included."""
    d = sub(b, a)
    return dot(cross(d, sub(p, a)), cross(d, sub(q, a))) >= 0


def sphere_in_box(centre: Sequence[Number], radius: Number, low: Sequence[Number], high: Sequence[Number]) -> Column:
    """Whether a sphere reaches a box."""
    gap = [F.greatest(col(a) - col(c), col(c) - col(b), F.lit(0.0)) for c, a, b in zip(centre, low, high, strict=True)]
    return square(gap) <= col(radius) * col(radius)


def plane_in_cube(normal: Sequence[Number], rho: Number, centre: Sequence[Number], half: Number) -> Column:
    """Whether a plane cuts a cube of that half-edge."""
    reach = reduce(lambda s, t: s + t, (F.abs(col(n)) for n in normal)) * col(half)
    return F.abs(dot(normal, centre) - col(rho)) <= reach


def ray_triangle(origin: Sequence[Number], direction: Sequence[Number], a: Sequence[Number], b: Sequence[Number], c: Sequence[Number]) -> Column:
    """Where along the ray it meets the triangle; null if it does not."""
    e, f = sub(b, a), sub(c, a)
    p = cross(direction, f)
    det = F.when(F.abs(dot(e, p)) > 1e-12, dot(e, p))
    off = sub(origin, a)
    u = dot(off, p) / det
    q = cross(off, e)
    v, t = dot(direction, q) / det, dot(f, q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def in_polygon(x: Number | str, y: Number | str, corners: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is inside a convex polygon whose corners go round against the clock, its edges included."""
    inside = F.lit(True)
    for (a, b), (c, d) in zip(corners, [*corners[1:], corners[0]], strict=True):
        inside = inside & ((c - a) * (col(y) - b) - (d - b) * (col(x) - a) >= 0)
    return inside


def bucket(value: Number | str, low: float, high: float, n: int) -> Column:
    """The colour bucket of a value: 0 to n - 1, with what is outside in the first and the last."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((col(value) - low) / (high - low) * n))).cast("int")


def colour(share: Number | str, scheme: str) -> list[Column]:
    """Red, green and blue (0 to 1) of a share between 0 and 1 in a colour map: grey, hsv, jet or hot."""
    s = col(share)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if scheme == "grey":
        return [s, s, s]
    if scheme == "hot":
        return [clip(s * 3), clip(s * 3 - 1), clip(s * 3 - 2)]
    if scheme == "jet":
        return [clip(1.5 - F.abs(s * 4 - 3)), clip(1.5 - F.abs(s * 4 - 2)), clip(1.5 - F.abs(s * 4 - 1))]
    if scheme == "hsv":  # a full turn of hues
        at = lambda k: F.abs(((s * 6 + k) % 6) - 3) - 1
        return [clip(at(0)), clip(at(4)), clip(at(2))]
    raise ValueError(f"no such colour map: {scheme}")
