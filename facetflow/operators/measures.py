"""Measures of a mesh: projections over joined corners, and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.functions import geometry as g
from facetflow.operators.topology import Mesh, boundary, edges, halfedges, numbered, paired, with_corners

#: A weight below zero is set to this.
LEAST_WEIGHT = 0.01


def edge_lengths(mesh: Mesh) -> DataFrame:
    """(mesh_id, e, v0, v1, length)."""
    out = edges(halfedges(mesh.faces))
    for c in ("v0", "v1"):
        out = out.join(mesh.vertices.select("mesh_id", F.col("v").alias(c), g.point("x", "y", "z").alias(f"p_{c}")), ["mesh_id", c])
    return out.select("mesh_id", "e", "v0", "v1", g.length(F.col("p_v0"), F.col("p_v1")).alias("length"))


def face_measures(mesh: Mesh) -> DataFrame:
    """(mesh_id, f, nx, ny, nz, area, cx, cy, cz): unit normal, area and centroid."""
    p = [F.col(c) for c in ("pa", "pb", "pc")]
    n, m = g.unit(g.face_normal(*p)), g.centroid(*p)
    return with_corners(mesh).select("mesh_id", "f", n.alias("n"), g.face_area(*p).alias("area"), m.alias("m")).select("mesh_id", "f", *(F.col(f"n.{c}").alias(f"n{c}") for c in "xyz"), "area", *(F.col(f"m.{c}").alias(f"c{c}") for c in "xyz"))


def corner_angles(mesh: Mesh) -> DataFrame:
    """(mesh_id, f, k, v, angle)."""
    a, b, c = (F.col(x) for x in ("pa", "pb", "pc"))
    three = F.array(*(F.struct(F.lit(k).alias("k"), F.col(v).alias("v"), g.angle(*p).alias("angle")) for k, (v, p) in enumerate((("a", (a, b, c)), ("b", (b, c, a)), ("c", (c, a, b))))))
    return with_corners(mesh).select("mesh_id", "f", F.explode(three).alias("s")).select("mesh_id", "f", "s.*")


def angle_defects(mesh: Mesh) -> DataFrame:
    """(mesh_id, v, defect): 2 pi less the angles at v, 0 on a boundary."""
    half = halfedges(mesh.faces)
    total = corner_angles(mesh).groupBy("mesh_id", "v").agg(F.sum("angle").alias("total"))
    degree = half.groupBy("mesh_id", F.col("tail").alias("v")).agg(F.count(F.lit(1)).alias("out"))
    ends = half.select("mesh_id", F.explode(F.array("tail", "head")).alias("v"), F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).distinct()
    around = ends.groupBy("mesh_id", "v").agg(F.count(F.lit(1)).alias("edges"))
    defect = F.when(F.col("out") == F.col("edges"), 2 * F.pi() - F.col("total")).otherwise(F.lit(0.0))
    return total.join(degree, ["mesh_id", "v"]).join(around, ["mesh_id", "v"]).select("mesh_id", "v", defect.alias("defect"))


def vertex_normals(mesh: Mesh) -> DataFrame:
    """(mesh_id, v, nx, ny, nz): faces' normals (by area) weighted by the angle at v."""
    n = g.face_normal(F.col("pa"), F.col("pb"), F.col("pc"))
    normal = with_corners(mesh).select("mesh_id", "f", n.alias("n"))
    s = corner_angles(mesh).join(normal, ["mesh_id", "f"]).groupBy("mesh_id", "v").agg(*(F.sum(F.col(f"n.{c}") * F.col("angle")).alias(c) for c in "xyz"))
    u = g.unit(g.point("x", "y", "z"))
    return s.select("mesh_id", "v", u.alias("u")).select("mesh_id", "v", *(F.col(f"u.{c}").alias(f"n{c}") for c in "xyz"))


def edge_weights(mesh: Mesh, kind: str = "Uniform") -> DataFrame:
    """(mesh_id, e, v0, v1, weight) for one of the weightings.

    coTan: the sum of the cotangents that face the edge. MeanValue: half-angle tangents at the tail of the edge's first
    halfedge over the length. Authalic: cotangents at its head over the squared length. A weight below 0 is 0.01, on an edge
    without length 0. One join of the corners and one grouping by the edge's ends; edges are numbered last.
    """
    g.embedding_type(kind)
    if kind == "Uniform":
        return edges(halfedges(mesh.faces)).select("mesh_id", "e", "v0", "v1", F.lit(1.0).alias("weight"))
    p = [F.col(c) for c in ("pa", "pb", "pc")]
    ids = [F.col(c) for c in "abc"]
    # a side with its opposite corner says what it adds at either end; both ends are summed, as the first halfedge is not known yet
    at = {"coTan": lambda v, w, o: g.cotan(o, v, w), "MeanValue": lambda v, w, o: F.tan(g.angle(v, w, o) / 2), "Authalic": lambda v, w, o: g.cotan(w, v, o)}[kind]
    sides = []
    for k in range(3):
        (i, pt), (j, ph), po = (ids[k], p[k]), (ids[(k + 1) % 3], p[(k + 1) % 3]), p[(k + 2) % 3]
        here = at(pt, ph, po)
        there = here if kind == "coTan" else at(ph, pt, po)
        sides.append(F.struct((3 * F.col("f") + k).alias("h"), i.alias("tail"), j.alias("head"), (here if kind == "coTan" else F.when(i < j, here).otherwise(there)).alias("lo_part"), (here if kind == "coTan" else F.when(i < j, there).otherwise(here)).alias("hi_part"), g.length(pt, ph).alias("l")))
    side = with_corners(mesh).select("mesh_id", F.explode(F.array(*sides)).alias("s")).select("mesh_id", "s.*")
    made = side.groupBy("mesh_id", F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).agg(F.min("h").alias("h"), F.min_by("tail", "h").alias("v0"), F.min_by("head", "h").alias("v1"), F.sum("lo_part").alias("s_lo"), F.sum("hi_part").alias("s_hi"), F.max("l").alias("l"))
    s = F.when(F.col("v0") == F.col("lo"), F.col("s_lo")).otherwise(F.col("s_hi"))
    w = {"coTan": s, "MeanValue": F.try_divide(s, F.col("l")), "Authalic": F.try_divide(s, F.col("l") * F.col("l"))}[kind]
    weighed = made.withColumn("w", F.coalesce(w, F.lit(0.0))).select("mesh_id", "h", "v0", "v1", F.when(F.col("w") < 0, LEAST_WEIGHT).otherwise(F.col("w")).alias("weight"))
    return numbered(weighed, "h", "e").select("mesh_id", "e", "v0", "v1", "weight")


def laplacian(weights: DataFrame) -> DataFrame:
    """(mesh_id, row, col, val): off the diagonal the weights, on it minus their row sums."""
    both = weights.select("mesh_id", F.explode(F.array(F.struct(F.col("v0").alias("row"), F.col("v1").alias("col")), F.struct(F.col("v1").alias("row"), F.col("v0").alias("col")))).alias("s"), "weight").select("mesh_id", "s.row", "s.col", F.col("weight").alias("val"))
    diagonal = both.groupBy("mesh_id", "row").agg((-F.sum("val")).alias("val")).select("mesh_id", "row", F.col("row").alias("col"), "val")
    return both.unionByName(diagonal)


def incidence(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """Face-edge and vertex-edge incidence as (mesh_id, row, col, val), edges turned from the smaller vertex to the larger."""
    edge = edges(halfedges(mesh.faces))
    half = paired(halfedges(mesh.faces), edge)
    by_face = half.select("mesh_id", F.col("f").alias("row"), F.col("e").alias("col"), F.when(F.col("tail") < F.col("head"), 1).otherwise(-1).alias("val"))
    ends = F.array(F.struct(F.least("v0", "v1").alias("row"), F.lit(-1).alias("val")), F.struct(F.greatest("v0", "v1").alias("row"), F.lit(1).alias("val")))
    by_vertex = edge.select("mesh_id", F.col("e").alias("col"), F.explode(ends).alias("s")).select("mesh_id", "s.row", "col", "s.val")
    return by_face, by_vertex


def uv_measures(uv_faces: DataFrame) -> DataFrame:
    """(mesh_id, area_uv, mean_u, mean_w, suu, suw, sww): of faces' uv corners a, b, c, with the scatter of their centroids."""
    area = g.face_area(F.col("ua"), F.col("ub"), F.col("uc"))
    m = g.centroid(F.col("ua"), F.col("ub"), F.col("uc"))
    rows = uv_faces.select("mesh_id", area.alias("area"), m["x"].alias("u"), m["y"].alias("w"))
    return rows.groupBy("mesh_id").agg(F.sum("area").alias("area_uv"), F.avg("u").alias("mean_u"), F.avg("w").alias("mean_w"), (F.var_pop("u") * F.count("u")).alias("suu"), (F.covar_pop("u", "w") * F.count("u")).alias("suw"), (F.var_pop("w") * F.count("w")).alias("sww"))


def least_height_turn(points: DataFrame, turns: int = 36) -> DataFrame:
    """(mesh_id, turn, height) of the least extent in w over ``turns`` rotations of half a circle, the first on ties."""
    t = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    angle = F.col("turn") * F.pi() / turns
    rows = points.select("mesh_id", "u", "w", t).withColumn("y", F.col("u") * F.sin(angle) + F.col("w") * F.cos(angle))
    extent = rows.groupBy("mesh_id", "turn").agg((F.max("y") - F.min("y")).alias("height"))
    best = extent.groupBy("mesh_id").agg(F.min(F.struct(F.round("height", 9).alias("h"), "turn")).alias("b"))
    return best.select("mesh_id", "b.turn", F.col("b.h").alias("height"))


def least_height_uv(uv: DataFrame, turns: int = 36) -> DataFrame:
    """(mesh_id, point_id, u, w): the points turned as :func:`least_height_turn` says."""
    turn = F.broadcast(least_height_turn(uv, turns).select("mesh_id", (F.col("turn") * F.pi() / turns).alias("angle")))
    co, si = F.cos("angle"), F.sin("angle")
    return uv.join(turn, "mesh_id").select("mesh_id", "point_id", (co * F.col("u") - si * F.col("w")).alias("u"), (si * F.col("u") + co * F.col("w")).alias("w"))


def principal_uv(uv_faces: DataFrame) -> DataFrame:
    """(mesh_id, f, ua, ub, uc) turned about the mean of the faces' centroids onto their principal axes; the mean is added back."""
    m = uv_measures(uv_faces)
    a, b, c = F.col("suu"), F.col("suw"), F.col("sww")
    disc = F.sqrt((a - c) ** 2 + 4 * b * b) / 2
    x, y = F.when(b < 0, -b).otherwise(b), F.when(b < 0, a - ((a + c) / 2 - disc)).otherwise((a + c) / 2 + disc - a)
    n = F.sqrt(x * x + y * y)
    axis = m.select("mesh_id", "mean_u", "mean_w", F.coalesce(F.try_divide(x, n), F.lit(0.0)).alias("vx"), F.coalesce(F.try_divide(y, n), F.lit(0.0)).alias("vy"))

    def turned(p: str):
        du, dw = F.col(p)["x"] - F.col("mean_u"), F.col(p)["y"] - F.col("mean_w")
        return g.point(F.col("vx") * du + F.col("vy") * dw + F.col("mean_u"), -F.col("vy") * du + F.col("vx") * dw + F.col("mean_w")).alias(p)

    return uv_faces.join(F.broadcast(axis), "mesh_id").select("mesh_id", "f", *(turned(p) for p in ("ua", "ub", "uc")))


def area_ratio(mesh: Mesh, uv_faces: DataFrame) -> DataFrame:
    """(mesh_id, ratio): the surface's area over that in uv; 1 where the latter is not above 0."""
    there = with_corners(mesh).groupBy("mesh_id").agg(F.sum(g.face_area(F.col("pa"), F.col("pb"), F.col("pc"))).alias("area"))
    flat = uv_measures(uv_faces).select("mesh_id", "area_uv")
    return there.join(flat, "mesh_id").select("mesh_id", F.when((F.col("area_uv") > 0) & (F.col("area_uv") < float("inf")), F.try_divide("area", "area_uv")).otherwise(F.lit(1.0)).alias("ratio"))


def boundary_wedges(mesh: Mesh, uv: DataFrame) -> DataFrame:
    """(mesh_id, v, exterior, scaling, tx, ty) for boundary vertices with one boundary halfedge each way; uv: (mesh_id, v, u, w).

    exterior: pi less the angles at v. scaling: of the boundary edges into and out of v, log of the uv length over the length
    in space, weighted by the uv lengths. tx, ty: the unit sum of their unit directions in uv.
    """
    rim = boundary(halfedges(mesh.faces)).select("mesh_id", "tail", "head")
    at = mesh.vertices.join(uv, ["mesh_id", "v"]).select("mesh_id", "v", g.point("x", "y", "z").alias("p"), g.point("u", "w").alias("q"))
    for c in ("tail", "head"):
        rim = rim.join(at.select("mesh_id", F.col("v").alias(c), F.col("p").alias(f"p_{c}"), F.col("q").alias(f"q_{c}")), ["mesh_id", c])
    d = g.minus(F.col("q_head"), F.col("q_tail"))
    rim = rim.select("mesh_id", "tail", "head", g.norm(d).alias("l"), F.ln(F.try_divide(g.norm(d), g.length(F.col("p_tail"), F.col("p_head")))).alias("s"), g.unit(d).alias("t"))
    into = rim.select("mesh_id", F.col("head").alias("v"), *(F.col(c).alias(f"{c}1") for c in ("l", "s", "t")))
    out = rim.select("mesh_id", F.col("tail").alias("v"), *(F.col(c).alias(f"{c}2") for c in ("l", "s", "t")))
    turn = corner_angles(mesh).groupBy("mesh_id", "v").agg((F.pi() - F.sum("angle")).alias("exterior"))
    scaling = F.try_divide(F.col("l1") * F.col("s1") + F.col("l2") * F.col("s2"), F.col("l1") + F.col("l2"))
    tangent = g.unit(g.plus(F.col("t1"), F.col("t2")))
    return into.join(out, ["mesh_id", "v"]).join(turn, ["mesh_id", "v"]).select("mesh_id", "v", "exterior", scaling.alias("scaling"), tangent["x"].alias("tx"), tangent["y"].alias("ty"))


def period_map(first: tuple, second: tuple) -> list:
    """The 2 x 2 matrix, by rows, that takes one pair of periods ((u, w) columns) to another: second times the inverse of first."""
    column = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else g._col(x)
    (a, c), (b, d) = ([column(x) for x in p] for p in first)
    (e, k), (f, m) = ([column(x) for x in p] for p in second)
    det = a * d - b * c
    return [F.try_divide(x, det) for x in (e * d - f * c, f * a - e * b, k * d - m * c, m * a - k * b)]


def longest_path(lengths: DataFrame) -> DataFrame:
    """One row (path_id, length): the longest of (path_id, length), the least path_id on ties."""
    return lengths.agg(F.max_by(F.struct("path_id", "length"), F.struct("length", -F.col("path_id"))).alias("s")).select("s.*")


def path_lengths(points: DataFrame) -> DataFrame:
    """(path_id, n_points, length) of polylines (path_id, seq, x, y, z)."""
    w = W.partitionBy("path_id").orderBy("seq")
    here = g.point("x", "y", "z")
    step = points.withColumn("p", here).withColumn("before", F.lag("p").over(w))
    return step.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum(g.length(F.col("before"), F.col("p"))), F.lit(0.0)).alias("length"))
