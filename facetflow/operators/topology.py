"""Meshes as tables, and their connectivity as joins and groupings.

vertices(mesh_id, v, x, y, z) and faces(mesh_id, f, a, b, c) make up a mesh; any number of meshes stand in one table.
Halfedge h = 3 f + k runs from corner k of face f to the next; an edge is numbered by the order of its first halfedge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.functions import geometry as g
from facetflow.shared import fresh


class MeshError(ValueError):
    """A mesh that the caller asked to be sound is not."""


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    faces: DataFrame


def numbered(df: DataFrame, key: str, name: str, width: int = 1 << 16) -> DataFrame:
    """``name``: the rank of ``key`` (distinct, not negative) within its mesh, from 0, without one sort of all rows.

    Ranks are counted within buckets of ``width`` keys, and the buckets' counts are added up.
    """
    bucket, n, own, before = (fresh(c, df) for c in ("bucket", "n", "own", "before"))
    bucketed = df.withColumn(bucket, F.floor(F.col(key) / width))
    sizes = bucketed.groupBy("mesh_id", bucket).agg(F.count(F.lit(1)).alias(n))
    up_to = F.coalesce(F.sum(n).over(W.partitionBy("mesh_id").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("mesh_id", bucket, up_to.alias(before))
    rank = F.row_number().over(W.partitionBy("mesh_id", bucket).orderBy(key)) - 1
    return bucketed.withColumn(own, rank).join(offsets, ["mesh_id", bucket]).withColumn(name, F.col(before) + F.col(own)).drop(bucket, own, before)


def rotated_faces(faces: DataFrame) -> DataFrame:
    """Faces as the accessors list them: from the corner that the last halfedge leaves."""
    return faces.select("mesh_id", "f", F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c"))


def halfedges(faces: DataFrame) -> DataFrame:
    """(mesh_id, h, f, k, tail, head, nxt, prv)."""
    ends = F.array(*(F.struct(F.lit(k).alias("k"), F.col(t).alias("tail"), F.col(e).alias("head")) for k, (t, e) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))))
    one = faces.select("mesh_id", "f", F.explode(ends).alias("s")).select("mesh_id", "f", "s.*")
    base = F.col("f") * 3
    return one.select("mesh_id", (base + F.col("k")).alias("h"), "f", "k", "tail", "head", (base + (F.col("k") + 1) % 3).alias("nxt"), (base + (F.col("k") + 2) % 3).alias("prv"))


def edges(half: DataFrame) -> DataFrame:
    """(mesh_id, e, v0, v1, h, n_faces): h is the first halfedge, v0 and v1 its ends."""
    by_ends = half.groupBy("mesh_id", F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).agg(F.min("h").alias("h"), F.min_by("tail", "h").alias("v0"), F.min_by("head", "h").alias("v1"), F.count(F.lit(1)).alias("n_faces"))
    return numbered(by_ends, "h", "e").select("mesh_id", "e", "v0", "v1", "h", "n_faces")


def paired(half: DataFrame, edge: DataFrame) -> DataFrame:
    """Halfedges with flip (null on a boundary) and edge e. A directed edge that occurs twice is no pair."""
    back = half.select("mesh_id", F.col("head").alias("tail"), F.col("tail").alias("head"), F.col("h").alias("flip"))
    with_flip = half.join(back, ["mesh_id", "tail", "head"], "left")
    ends = edge.select("mesh_id", "e", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    keyed = with_flip.withColumn("lo", F.least("tail", "head")).withColumn("hi", F.greatest("tail", "head"))
    return keyed.join(ends, ["mesh_id", "lo", "hi"]).select("mesh_id", "h", "f", "k", "tail", "head", "nxt", "prv", "flip", "e")


def degrees(half: DataFrame) -> DataFrame:
    """(mesh_id, v, degree) of closed meshes: outgoing halfedges."""
    return half.groupBy("mesh_id", F.col("tail").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def vertex_halfedge(half: DataFrame) -> DataFrame:
    """(mesh_id, v, h): the last halfedge that leaves v."""
    return half.groupBy("mesh_id", F.col("tail").alias("v")).agg(F.max("h").alias("h"))


def boundary(half: DataFrame) -> DataFrame:
    """Halfedges without a partner."""
    back = half.select("mesh_id", F.col("head").alias("tail"), F.col("tail").alias("head"))
    return half.join(back, ["mesh_id", "tail", "head"], "left_anti").select("mesh_id", "h", "f", "tail", "head")


def isolated_vertices(mesh: Mesh) -> DataFrame:
    used = mesh.faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("v"))
    return mesh.vertices.join(used, ["mesh_id", "v"], "left_anti").select("mesh_id", "v")


def remove_isolated(mesh: Mesh) -> Mesh:
    """Drop isolated vertices and number the others by their first use in the faces."""
    first = halfedges(mesh.faces).groupBy("mesh_id", F.col("tail").alias("v")).agg(F.min("h").alias("first"))
    new = numbered(first, "first", "new").select("mesh_id", "v", "new")
    faces = mesh.faces
    for c in ("a", "b", "c"):
        faces = faces.join(new.select("mesh_id", F.col("v").alias(c), F.col("new").alias(f"new_{c}")), ["mesh_id", c])
    faces = faces.select("mesh_id", "f", *(F.col(f"new_{c}").alias(c) for c in ("a", "b", "c")))
    return Mesh(mesh.vertices.join(new, ["mesh_id", "v"]).select("mesh_id", F.col("new").alias("v"), "x", "y", "z"), faces)


def non_manifold_edges(edge: DataFrame) -> DataFrame:
    return edge.where("n_faces > 2")


def misdirected_edges(half: DataFrame) -> DataFrame:
    """Directed edges that several faces run along: none, if all faces of the mesh are turned alike."""
    return half.groupBy("mesh_id", "tail", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def vertex_fans(half: DataFrame, components) -> DataFrame:
    """(mesh_id, v, fans): into how many fans of edge-joined faces the faces of a vertex fall. More than one: not manifold.

    ``components`` labels the nodes of an edge table, as graph.components does.
    """
    # a corner of face f at v is node h; faces on both sides of an edge at v join their corners
    out = half.select("mesh_id", F.col("tail").alias("v"), F.col("head").alias("w"), "h")
    into = half.select("mesh_id", F.col("head").alias("v"), F.col("tail").alias("w"), F.col("nxt").alias("h2"))
    joined = out.join(into, ["mesh_id", "v", "w"]).select("mesh_id", F.col("h").alias("a"), F.col("h2").alias("b"))
    label = components(joined)
    corner = out.select("mesh_id", "v", F.col("h").alias("node")).join(label, ["mesh_id", "node"], "left")
    return corner.groupBy("mesh_id", "v").agg(F.countDistinct(F.coalesce("root", "node")).alias("fans"))


def summary(mesh: Mesh) -> DataFrame:
    """(mesh_id, n_vertices, n_edges, n_faces, euler, area, diameter): the diameter is that of the bounding box."""
    corner = with_corners(mesh)
    of_faces = corner.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"), F.sum(g.face_area(F.col("pa"), F.col("pb"), F.col("pc"))).alias("area"))
    of_vertices = mesh.vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.sqrt(sum(((F.max(c) - F.min(c)) ** 2 for c in "yz"), (F.max("x") - F.min("x")) ** 2)).alias("diameter"))
    ends = halfedges(mesh.faces).select("mesh_id", F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).distinct()
    of_edges = ends.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_edges"))
    euler = F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")
    return of_vertices.join(of_edges, "mesh_id").join(of_faces, "mesh_id").select("mesh_id", "n_vertices", "n_edges", "n_faces", euler.alias("euler"), "area", "diameter")


def check(mesh: Mesh, require_closed: bool = True, components=None) -> None:
    """Raise a MeshError with the first fault found: bad indices, edges of three faces, isolated vertices, a boundary.

    With ``components`` (see :func:`vertex_fans`) vertices around which the faces fall into several fans are a fault too.
    """
    used = mesh.faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("v"))
    half = halfedges(mesh.faces)
    faults = [("Invalid face indices", used.join(mesh.vertices, ["mesh_id", "v"], "left_anti")), ("Mesh has non-manifold edges.", non_manifold_edges(edges(half))), ("Mesh has isolated vertices.", isolated_vertices(mesh))]
    if components is not None:
        faults.append(("Mesh has non-manifold vertices.", vertex_fans(half, components).where("fans > 1")))
    if require_closed:
        faults.append(("Mesh has a boundary.", boundary(half)))
    for message, rows in faults:
        if rows.limit(1).count():
            raise MeshError(message)


def vertex_kinds(mesh: Mesh) -> DataFrame:
    """(mesh_id, v, isolated, on_boundary, inside_hole): of no face; at an edge of one face; all of whose edges are of one face."""
    half = halfedges(mesh.faces)
    ends = edges(half).select("mesh_id", F.explode(F.array("v0", "v1")).alias("v"), (F.col("n_faces") == 1).alias("open"))
    around = ends.groupBy("mesh_id", "v").agg(F.max("open").alias("some"), F.min("open").alias("every"))
    at = mesh.vertices.select("mesh_id", "v").join(around, ["mesh_id", "v"], "left")
    no = F.lit(False)
    return at.select("mesh_id", "v", F.col("some").isNull().alias("isolated"), F.coalesce("some", no).alias("on_boundary"), F.coalesce("every", no).alias("inside_hole"))


def real_faces(mesh: Mesh, poles: DataFrame | None = None) -> DataFrame:
    """(mesh_id, f, real): a face is real unless it has a vertex of ``poles`` (mesh_id, pole), which were taken out."""
    out = mesh.faces.select("mesh_id", "f", F.explode(F.array("a", "b", "c")).alias("v"))
    if poles is None:
        return mesh.faces.select("mesh_id", "f", F.lit(True).alias("real"))
    at = out.join(poles.select("mesh_id", F.col("pole").alias("v"), F.lit(True).alias("at_pole")), ["mesh_id", "v"], "left")
    return at.groupBy("mesh_id", "f").agg((~F.coalesce(F.max("at_pole"), F.lit(False))).alias("real"))


def shared_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, f, other, e): for each face each face beside it, and the edge between them."""
    half = halfedges(faces)
    sides = paired(half, edges(half)).select("mesh_id", "f", "e")
    beside = sides.select("mesh_id", F.col("f").alias("other"), "e")
    return sides.join(beside, ["mesh_id", "e"]).where("f <> other").select("mesh_id", "f", "other", "e")


def with_corners(mesh: Mesh) -> DataFrame:
    """Faces with their corners' positions pa, pb, pc."""
    out = mesh.faces
    for c in ("a", "b", "c"):
        at = mesh.vertices.select("mesh_id", F.col("v").alias(c), g.point("x", "y", "z").alias(f"p{c}"))
        out = out.join(at, ["mesh_id", c])
    return out.select("mesh_id", "f", "a", "b", "c", "pa", "pb", "pc")


def subdivide(mesh: Mesh) -> Mesh:
    """Barycentric subdivision: old vertices, edge midpoints in the order of edges, face centroids; six faces for each."""
    half = halfedges(rotated_faces(mesh.faces))
    edge = edges(halfedges(mesh.faces))
    size = mesh.vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nv"))
    size = size.join(edge.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("ne")), "mesh_id")
    p = mesh.vertices.select("mesh_id", "v", "x", "y", "z")
    ends = edge.select("mesh_id", "e", F.explode(F.array("v0", "v1")).alias("v")).join(p, ["mesh_id", "v"])
    mid = ends.groupBy("mesh_id", "e").agg(*((F.sum(c) / 2).alias(c) for c in "xyz")).join(size, "mesh_id").select("mesh_id", (F.col("nv") + F.col("e")).alias("v"), *"xyz")
    corner = with_corners(mesh)
    m = g.centroid(F.col("pa"), F.col("pb"), F.col("pc"))
    centre = corner.select("mesh_id", "f", m.alias("m")).join(size, "mesh_id").select("mesh_id", (F.col("nv") + F.col("ne") + F.col("f")).alias("v"), "m.x", "m.y", "m.z")
    # each halfedge (u, v) of a face, with midpoint w and centre d, gives the faces (u, w, d) and (w, v, d)
    keyed = paired(half, edge.select("mesh_id", "e", "v0", "v1")).join(size, "mesh_id")
    w, d, first = F.col("nv") + F.col("e"), F.col("nv") + F.col("ne") + F.col("f"), 6 * F.col("f") + 2 * F.col("k")
    two = F.array(F.struct(first.alias("f"), F.col("tail").alias("a"), w.alias("b"), d.alias("c")), F.struct((first + 1).alias("f"), w.alias("a"), F.col("head").alias("b"), d.alias("c")))
    faces = keyed.select("mesh_id", F.explode(two).alias("s")).select("mesh_id", "s.*")
    return Mesh(p.unionByName(mid).unionByName(centre), faces)


def normalize_area(mesh: Mesh) -> Mesh:
    """Each mesh about its mean vertex, scaled to area 1."""
    area = with_corners(mesh).groupBy("mesh_id").agg(F.sum(g.face_area(F.col("pa"), F.col("pb"), F.col("pc"))).alias("area"))
    mean = mesh.vertices.groupBy("mesh_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz")).join(area, "mesh_id")
    k = F.sqrt(1 / F.nullif("area", F.lit(0.0)))
    moved = mesh.vertices.join(mean, "mesh_id").select("mesh_id", "v", *(((F.col(c) - F.col(f"m{c}")) * k).alias(c) for c in "xyz"))
    return Mesh(moved, mesh.faces)


def normalize_radius(mesh: Mesh, scale: bool = True) -> Mesh:
    """Each mesh about its mean vertex, divided by the largest distance from it (1e-8 at least) if ``scale``."""
    mean = mesh.vertices.groupBy("mesh_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    about = mesh.vertices.join(mean, "mesh_id").select("mesh_id", "v", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))
    if not scale:
        return Mesh(about, mesh.faces)
    radius = about.groupBy("mesh_id").agg(F.greatest(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)), F.lit(1e-8)).alias("r"))
    return Mesh(about.join(radius, "mesh_id").select("mesh_id", "v", *((F.col(c) / F.col("r")).alias(c) for c in "xyz")), mesh.faces)
