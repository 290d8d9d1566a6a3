"""Repair and cutting of meshes: fans of faces around vertices, turning, parting, and loading as one.

A corner of a face is numbered by the halfedge that leaves it. The corners around a vertex fall into fans: corners of the two faces
of an edge there are of one fan, unless the edge is cut. A manifold vertex has one fan.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import graph
from facetflow.operators.condense import MeshIds
from facetflow.operators.topology import Mesh, MeshError, check, halfedges, isolated_vertices, normalize_area, numbered, remove_isolated


#: Vertices of near ids whose fans one task finds at a time.
VERTICES = 1 << 14


class Split(NamedTuple):
    """The mesh, and copies (mesh_id, v, ref): the new vertices and those that they repeat."""

    mesh: Mesh
    copies: DataFrame


def fans(mesh: Mesh, cut: DataFrame | None = None) -> DataFrame:
    """(mesh_id, f, k, v, h, fan): for each corner the least corner of its fan; edges of ``cut`` (mesh_id, lo, hi) part fans."""
    half = halfedges(mesh.faces)
    # both edges of each corner, whichever way its face runs along them
    ends = F.array(F.struct(F.col("tail").alias("v"), F.col("head").alias("w"), F.col("h").alias("corner")), F.struct(F.col("head").alias("v"), F.col("tail").alias("w"), F.col("nxt").alias("corner")))
    met = half.select("mesh_id", F.explode(ends).alias("s")).groupBy("mesh_id", "s.v", "s.w").agg(F.min("s.corner").alias("a"), F.max("s.corner").alias("b"), F.count(F.lit(1)).alias("n"))
    joined = met.where("n = 2").select("mesh_id", "v", "a", "b", F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi"))
    out = half.select("mesh_id", F.col("tail").alias("v"), "h", "f", "k")
    if cut is not None:
        joined = joined.join(cut.select("mesh_id", "lo", "hi"), ["mesh_id", "lo", "hi"], "left_anti")
    label = _least_corners(joined)
    return out.select("mesh_id", "f", "k", "v", "h").join(label.select("mesh_id", F.col("node").alias("h"), "root"), ["mesh_id", "h"], "left").select("mesh_id", "f", "k", "v", "h", F.coalesce("root", "h").alias("fan"))


def _least_corners(links: DataFrame) -> DataFrame:
    """(mesh_id, node, root): corners of links (mesh_id, v, a, b), and the least that each is linked to. Links are among corners of one
    vertex, so a task that has all links of some vertices needs nothing else.
    """
    ids = MeshIds(links)

    def least(key, pdf):
        node, root = graph._merged(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"mesh_id": key[0], "node": node, "root": root})

    return ids.back(ids.to_long(links).groupBy("mesh_id", F.floor(F.col("v") / VERTICES).alias("run")).applyInPandas(least, "mesh_id long, node long, root long"))


def split(mesh: Mesh, cut: DataFrame | None = None) -> Split:
    """A vertex for each fan: that of the least corner keeps the id, others get new ids behind all, in the order of their least corners.

    Without ``cut`` this takes vertices apart that are not manifold; with the edges of a cut graph it cuts the mesh along them.
    """
    corner = graph.cut(fans(mesh, cut))
    one = corner.groupBy("mesh_id", "v", "fan").agg(F.count(F.lit(1)).alias("n"))
    first = one.groupBy("mesh_id", "v").agg(F.min("fan").alias("first"))
    size = mesh.vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("nv"))
    new = numbered(one.join(first, ["mesh_id", "v"]).where("fan <> first").select("mesh_id", F.col("v").alias("ref"), "fan"), "fan", "rank")
    new = graph.cut(new.join(F.broadcast(size), "mesh_id").select("mesh_id", "ref", "fan", (F.col("nv") + F.col("rank")).alias("v")))
    placed = corner.join(new.select("mesh_id", "fan", F.col("v").alias("new")), ["mesh_id", "fan"], "left").select("mesh_id", "f", "k", F.coalesce("new", "v").alias("v"))
    faces = placed.groupBy("mesh_id", "f").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in enumerate("abc")))
    copies = new.select("mesh_id", "v", "ref")
    more = copies.join(mesh.vertices.withColumnRenamed("v", "ref"), ["mesh_id", "ref"]).select("mesh_id", "v", "x", "y", "z")
    return Split(Mesh(mesh.vertices.select("mesh_id", "v", "x", "y", "z").unionByName(more), faces), copies)


def identification_map(copies: DataFrame) -> DataFrame:
    """(mesh_id, v, copy, n): each vertex that has copies with each of them, and how many vertices it is now."""
    n = copies.groupBy("mesh_id", F.col("ref").alias("v")).agg((F.count(F.lit(1)) + 1).alias("n"))
    return copies.select("mesh_id", F.col("ref").alias("v"), F.col("v").alias("copy")).join(n, ["mesh_id", "v"])


def oriented(faces: DataFrame) -> DataFrame:
    """Faces (mesh_id, f, a, b, c) turned alike within each component, as its least face is; a turned face swaps b and c.

    Each face is two nodes, as it stands and turned. Neighbours that run along their edge in one direction link unlike nodes,
    others like ones. A face is turned if it hangs on the turned node of the component's least face; MeshError if on both.
    """
    half = halfedges(faces).select("mesh_id", "f", "tail", "head", F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi"))
    one, two = half.alias("x"), half.alias("y")
    met = one.join(two, (F.col("x.mesh_id") == F.col("y.mesh_id")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.f") < F.col("y.f")))
    unlike = (F.col("x.tail") == F.col("y.tail")).cast("long")
    links = F.array(*(F.struct((2 * F.col("x.f") + s).alias("a"), (2 * F.col("y.f") + (s + unlike) % 2).alias("b")) for s in (0, 1)))
    label = graph.cut(graph.components(met.select(F.col("x.mesh_id").alias("mesh_id"), F.explode(links).alias("s")).select("mesh_id", "s.a", "s.b")))
    of = label.groupBy("mesh_id", F.floor(F.col("node") / 2).alias("f")).agg(F.max(F.when(F.col("node") % 2 == 0, F.col("root"))).alias("plain"), F.max(F.when(F.col("node") % 2 == 1, F.col("root"))).alias("turned"))
    if of.where("plain = turned").limit(1).count():
        raise MeshError("Mesh cannot be oriented.")
    turn = F.coalesce(F.col("plain") % 2 == 1, F.lit(False))
    return faces.join(of, ["mesh_id", "f"], "left").select("mesh_id", "f", "a", F.when(turn, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("b")).otherwise(F.col("c")).alias("c"))


def separated(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, component, v, old, x, y, z) and faces (mesh_id, component, f, a, b, c), numbered anew in each component.

    Components stand in the order of their first faces, vertices in the order of their first use, faces as they were.
    """
    half = halfedges(mesh.faces)
    use = half.groupBy("mesh_id", F.col("tail").alias("v")).agg(F.min("h").alias("first"))
    label = graph.cut(graph.components(half.select("mesh_id", F.col("tail").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "v"))
    rows = graph.cut(use.join(label, ["mesh_id", "v"]))
    order = numbered(rows.groupBy("mesh_id", "root").agg(F.min("first").alias("first")), "first", "component").select("mesh_id", "root", "component")
    own = F.struct("mesh_id", "component").alias("mesh_id")  # a component is a mesh to the numbering
    rows = rows.join(order, ["mesh_id", "root"])
    ids = graph.cut(numbered(rows.select(own, F.col("v").alias("old"), "first"), "first", "v").select("mesh_id.mesh_id", "mesh_id.component", "old", "v"))
    vertices = ids.join(mesh.vertices.withColumnRenamed("v", "old"), ["mesh_id", "old"]).select("mesh_id", "component", "v", "old", "x", "y", "z")
    faces = mesh.faces
    for c in "abc":
        at = ids.select("mesh_id", F.col("old").alias(c), F.col("v").alias(f"new_{c}"), *(["component"] if c == "a" else []))
        faces = faces.join(at, ["mesh_id", c])
    faces = numbered(faces.select(own, F.col("f").alias("old_f"), *(F.col(f"new_{c}").alias(c) for c in "abc")), "old_f", "f")
    return vertices, faces.select("mesh_id.mesh_id", "mesh_id.component", "f", "a", "b", "c")


def repaired(mesh: Mesh) -> Mesh:
    """Without isolated vertices (if there is one, all are numbered by first use), every vertex manifold, faces turned alike."""
    if isolated_vertices(mesh).limit(1).count():
        mesh = remove_isolated(mesh)
    mesh = split(mesh).mesh
    return Mesh(mesh.vertices, oriented(mesh.faces))


def repaired_cuttable(mesh: Mesh, uncuttable: DataFrame) -> tuple[Mesh, DataFrame]:
    """The mesh as :func:`repaired` leaves it, and its edges (mesh_id, lo, hi) that no cut may pass.

    A mesh from which vertices were removed, or of which some were taken apart, has none: all its edges can be cut then.
    """
    lone = isolated_vertices(mesh).select("mesh_id")
    if lone.limit(1).count():
        mesh = remove_isolated(mesh)
    parts = split(mesh)
    changed = graph.cut(lone.unionByName(parts.copies.select("mesh_id")).distinct())
    kept = uncuttable.select("mesh_id", "lo", "hi").distinct().join(changed, "mesh_id", "left_anti")
    return Mesh(parts.mesh.vertices, oriented(parts.mesh.faces)), kept


def load_mesh(spark: SparkSession, source, faces=None, normalize: bool = False) -> Mesh:
    """One mesh from an OBJ file's path, or from rows of coordinates and rows of indices: repaired, checked, of one component.

    A mesh from a file must be closed, one from arrays may have a boundary.
    """
    from facetflow.sources import obj

    mesh = repaired(obj.read_obj(spark, [source]) if faces is None else obj.from_arrays(spark, source, faces))
    check(mesh, require_closed=faces is None)
    half = halfedges(mesh.faces)
    label = graph.components(half.select("mesh_id", F.col("tail").alias("a"), F.col("head").alias("b")))
    if label.select("root").distinct().limit(2).count() != 1:
        raise MeshError("Mesh has not exactly one component.")
    return normalize_area(mesh) if normalize else mesh
