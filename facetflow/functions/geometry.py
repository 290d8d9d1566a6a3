"""Geometric functions as Column expressions: no joins, no Python on the executors.

A point is a struct with fields x, y, z; :func:`point` makes one. Divisions that may meet zero give null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y, z=None) -> Column:
    """z defaults to 0: a point of the plane."""
    return F.struct(_col(x).alias("x"), _col(y).alias("y"), (F.lit(0.0) if z is None else _col(z)).alias("z"))


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def plus(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def scaled(a: Column, k) -> Column:
    return point(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null components for a zero vector."""
    n = norm(a)
    return point(F.try_divide(a["x"], n), F.try_divide(a["y"], n), F.try_divide(a["z"], n))


def length(a: Column, b: Column) -> Column:
    return norm(minus(b, a))


def face_normal(a: Column, b: Column, c: Column) -> Column:
    """Not normalised: its norm is twice the area."""
    return cross(minus(b, a), minus(c, a))


def face_area(a: Column, b: Column, c: Column) -> Column:
    return norm(face_normal(a, b, c)) * 0.5


def centroid(a: Column, b: Column, c: Column) -> Column:
    return point((a["x"] + b["x"] + c["x"]) / 3, (a["y"] + b["y"] + c["y"]) / 3, (a["z"] + b["z"] + c["z"]) / 3)


def angle(at: Column, b: Column, c: Column) -> Column:
    """The angle at ``at`` between the ways to b and c, the cosine held to [-1, 1]."""
    u, v = minus(b, at), minus(c, at)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(u, v), norm(u) * norm(v)))))


def cotan(at: Column, b: Column, c: Column) -> Column:
    """Cotangent of the angle at ``at``; 0 where the triangle has no area."""
    u, v = minus(b, at), minus(c, at)
    return F.coalesce(F.try_divide(dot(u, v), norm(cross(u, v))), F.lit(0.0))


def cotan_unguarded(at: Column, b: Column, c: Column) -> Column:
    """Cotangent of the angle at ``at``; null, not 0, where the triangle has no area."""
    u, v = minus(b, at), minus(c, at)
    return F.try_divide(dot(u, v), norm(cross(u, v)))


def area_from_lengths(a, b, c) -> Column:
    """Heron's formula; 0 where the lengths make no triangle."""
    a, b, c = map(_col, (a, b, c))
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))


def cotan_from_lengths(opposite, b, c) -> Column:
    """Cotangent of the angle that faces the side ``opposite``."""
    o, b, c = map(_col, (opposite, b, c))
    return F.try_divide(b * b + c * c - o * o, 4 * area_from_lengths(o, b, c))


def angle_from_lengths(opposite, b, c) -> Column:
    o, b, c = map(_col, (opposite, b, c))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(b * b + c * c - o * o, 2 * b * c))))


def barycentric(p: Column, a: Column, b: Column, c: Column) -> list[Column]:
    """The three weights of p in a, b, c; negative outside, null in a face without area."""
    n = face_normal(a, b, c)
    d = dot(n, n)
    return [F.try_divide(dot(face_normal(p, u, v), n), d) for u, v in ((b, c), (c, a), (a, b))]


def planar_barycentric(u, w, a: Column, b: Column, c: Column) -> Column:
    """The three weights of the plane's point (u, w) as an array; nulls in a triangle without area."""
    u, w = _col(u), _col(w)
    side = lambda p, q: (p["x"] - u) * (q["y"] - w) - (p["y"] - w) * (q["x"] - u)
    parts = F.array(side(b, c), side(c, a), side(a, b))
    whole = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    return F.transform(parts, lambda x: F.try_divide(x, whole))


def blend(weights: list[Column], corners: list[Column]) -> Column:
    """The point with these weights in these corners."""
    return point(*(sum((w * c[k] for w, c in zip(weights[1:], corners[1:])), weights[0] * corners[0][k]) for k in ("x", "y", "z")))


def turning_angle(a: Column, b: Column, c: Column) -> Column:
    """How far the way a, b, c turns at b in the plane, in [-pi, pi)."""
    first = F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    second = F.atan2(c["y"] - b["y"], c["x"] - b["x"])
    return F.pmod(second - first + F.pi(), 2 * F.pi()) - F.pi()


def inverse_stereographic(u, v) -> Column:
    u, v = _col(u), _col(v)
    q = u * u + v * v
    return point(2 * u / (1 + q), 2 * v / (1 + q), (1 - q) / (1 + q))


def wrap(u) -> Column:
    """A coordinate of the unit torus brought into [0, 1)."""
    return F.pmod(_col(u), F.lit(1.0))


def surface_point_kind(l0, l1, l2, eps: float = 1e-12) -> Column:
    """Whether a face point is a vertex, lies on an edge, or within the face."""
    ls = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(x))) for x in (l0, l1, l2)]
    return F.when(F.greatest(*ls) >= 1 - eps, "vertex").when(F.least(*ls) <= eps, "edge").otherwise("face")


def surface_point(l0, l1, l2, eps: float = 1e-12) -> Column:
    """A face point as (kind, k, t): vertex of corner k, edge that leaves corner k at share t of the way, or face (nulls).

    Weights that do not add up to 1 are divided by their sum, then held to [0, 1]; edges are tried from corner 0, 2 and 1.
    """
    ls = [_col(x) for x in (l0, l1, l2)]
    total = ls[0] + ls[1] + ls[2]
    off = (F.abs(total - 1) > eps) & (total > eps)
    x, y, z = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(off, F.try_divide(v, total)).otherwise(v))) for v in ls)
    made = lambda kind, k, t: F.struct(F.lit(kind).alias("kind"), F.lit(k).cast("int").alias("k"), t.cast("double").alias("t"))
    none = F.lit(None)
    out = F.when(x >= 1 - eps, made("vertex", 0, none)).when(y >= 1 - eps, made("vertex", 1, none)).when(z >= 1 - eps, made("vertex", 2, none))
    return out.when(z <= eps, made("edge", 0, y)).when(y <= eps, made("edge", 2, x)).when(x <= eps, made("edge", 1, z)).otherwise(made("face", None, none))


def spline_at(knots, t) -> Column:
    """A periodic spline at angle t: knots are an array of (t, p), rising in t; tangents are half the way between neighbours.

    0 without a knot, the value of a single knot everywhere.
    """
    k, t = _col(knots), _col(t)
    n = F.size(k)
    after = F.coalesce(F.nullif(F.array_position(F.transform(k, lambda x: x["t"] > t), True), F.lit(0)) - 1, F.lit(0)).cast("int")
    at = [F.get(k, F.pmod(after + d, n).cast("int")) for d in (-2, -1, 0, 1)]
    p0, p1, p2, p3 = (x["p"] for x in at)
    m1, m2 = 0.5 * (p2 - p0), 0.5 * (p3 - p1)
    turn = lambda a: F.atan2(F.sin(a), F.cos(a))
    s = F.try_divide(turn(t - at[1]["t"]), turn(at[2]["t"] - at[1]["t"]))
    s2, s3 = s * s, s * s * s
    curve = (2 * s3 - 3 * s2 + 1) * p1 + (s3 - 2 * s2 + s) * m1 + (3 * s2 - 2 * s3) * p2 + (s3 - s2) * m2
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.get(k, F.lit(0))["p"]).otherwise(curve)


def with_knot(knots, t, p) -> Column:
    """The knots with one at t of value p, in place of one that is there."""
    k, t = _col(knots), _col(t)
    return F.array_sort(F.concat(F.filter(k, lambda x: x["t"] != t), F.array(F.struct(t.cast("double").alias("t"), _col(p).cast("double").alias("p")))))


def without_knot(knots, t, tolerance: float = 1e-3) -> Column:
    """The knots without the one nearest to t, if it is nearer than ``tolerance`` and no other is as near."""
    k, t = _col(knots), _col(t)
    d = F.transform(k, lambda x: F.abs(x["t"] - t))
    least = F.array_min(d)
    lone = (least < tolerance) & (F.size(F.filter(d, lambda x: x == least)) == 1)
    return F.when(lone, F.filter(k, lambda x: F.abs(x["t"] - t) != least)).otherwise(k)


def reset_knots(knots) -> Column:
    return F.transform(_col(knots), lambda x: F.struct(x["t"].alias("t"), F.lit(0.0).alias("p")))


def catmull_rom(p0, p1, p2, p3, t) -> Column:
    """The point at t in [0, 1] between p1 and p2 of a Catmull-Rom spline."""
    p0, p1, p2, p3, t = map(_col, (p0, p1, p2, p3, t))
    return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)


#: The names of weightings and their numbers.
EMBEDDING_TYPES = {"Uniform": 1, "coTan": 2, "MeanValue": 3, "Authalic": 4}


def embedding_type(name: str) -> int:
    if name not in EMBEDDING_TYPES:
        raise ValueError(f"unknown embedding type {name!r}: one of {', '.join(EMBEDDING_TYPES)}")
    return EMBEDDING_TYPES[name]
