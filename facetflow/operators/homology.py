"""Loops and one-forms of closed connected meshes, from a spanning tree of vertices and one of faces.

Edges outside both trees are 2 g in number. Each closes one loop through the vertices' tree, and is crossed by one closed
path of faces. Both are kept as signed edges: ways to the root are added with opposite signs, and what they share cancels.
An edge counts from its smaller vertex to its larger.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.operators import graph, solve
from facetflow.operators.topology import Mesh, edges, halfedges, numbered, paired
from facetflow.shared import sent_by_key


class Trees(NamedTuple):
    """edges (mesh_id, e, lo, hi, left, right); vertices and faces (mesh_id, node, parent, e); rest (.., generator)."""

    edges: DataFrame
    vertices: DataFrame
    faces: DataFrame
    rest: DataFrame


def tree(edge: DataFrame) -> DataFrame:
    """(mesh_id, node, parent, e): the tree of the nodes' levels, from the least node."""
    return graph.cut(graph.bfs_tree(graph.cut(edge)).select("mesh_id", "node", "parent", "e"))


def _tree_of_polygons(faces: DataFrame, both: DataFrame, cut: DataFrame) -> DataFrame:
    """A tree of faces that holds each edge which cannot be cut, and between polygons those of a tree of levels."""
    inner = both.where("not cuttable").select("mesh_id", "lo", "hi")
    of = graph.cut(polygons(faces, inner))
    between = cut.where("cuttable")
    for c in ("left", "right"):
        between = between.join(of.select("mesh_id", F.col("f").alias(c), F.col("polygon").alias(f"{c}_polygon")), ["mesh_id", c])
    steps = between.where("left_polygon <> right_polygon").select("mesh_id", F.col("left_polygon").alias("a"), F.col("right_polygon").alias("b"), "e")
    taken = tree(steps).where("parent is not null").select("mesh_id", "e")
    whole = cut.join(taken.unionByName(cut.where("not cuttable").select("mesh_id", "e")), ["mesh_id", "e"], "left_semi")
    return tree(whole.select("mesh_id", F.col("left").alias("a"), F.col("right").alias("b"), "e"))


def polygons(faces: DataFrame, uncuttable: DataFrame) -> DataFrame:
    """(mesh_id, f, polygon): faces that share an edge of ``uncuttable`` (mesh_id, lo, hi) are of one polygon, named by its least face."""
    half = halfedges(faces).select("mesh_id", "f", F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi"))
    inner = half.join(uncuttable.select("mesh_id", "lo", "hi").distinct(), ["mesh_id", "lo", "hi"], "left_semi")
    met = inner.groupBy("mesh_id", "lo", "hi").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    label = graph.components(met.select("mesh_id", "a", "b"))
    return faces.select("mesh_id", "f").join(label.select("mesh_id", F.col("node").alias("f"), "root"), ["mesh_id", "f"], "left").select("mesh_id", "f", F.coalesce("root", "f").alias("polygon"))


def tree_cotree(mesh: Mesh, uncuttable: DataFrame | None = None) -> Trees:
    """A tree of vertices, a tree of faces, and ``rest``: the edges in neither, numbered by e.

    Both are trees of levels, from the least vertex and the least face. Edges of ``uncuttable`` (mesh_id, lo, hi), such as diagonals of
    polygons, are in no tree of vertices and all in that of faces, which is one of polygons; so none is left over, and no loop has one.

    left is the face that runs along an edge from lo to hi, right the other.
    """
    half = halfedges(mesh.faces)
    sided = paired(half, edges(half)).groupBy("mesh_id", "e").agg(
        F.min(F.least("tail", "head")).alias("lo"), F.max(F.greatest("tail", "head")).alias("hi"),
        F.max(F.when(F.col("tail") < F.col("head"), F.col("f"))).alias("left"), F.max(F.when(F.col("tail") > F.col("head"), F.col("f"))).alias("right"),
    )
    if uncuttable is None:
        sided = sided.withColumn("cuttable", F.lit(True))
    else:
        sided = sided.join(uncuttable.select("mesh_id", "lo", "hi", F.lit(False).alias("cuttable")).distinct(), ["mesh_id", "lo", "hi"], "left").withColumn("cuttable", F.coalesce("cuttable", F.lit(True)))
    both = graph.cut(sided)
    edge = both.drop("cuttable")
    of_vertices = tree(both.where("cuttable").select("mesh_id", F.col("lo").alias("a"), F.col("hi").alias("b"), "e"))
    cut = graph.cut(both.join(of_vertices.where("parent is not null").select("mesh_id", "e"), ["mesh_id", "e"], "left_anti").where("left is not null and right is not null"))
    if uncuttable is None:
        of_faces = tree(cut.select("mesh_id", F.col("left").alias("a"), F.col("right").alias("b"), "e"))
    else:
        of_faces = _tree_of_polygons(mesh.faces, both, cut)
    cut = cut.drop("cuttable")
    rest = cut.join(of_faces.where("parent is not null").select("mesh_id", "e"), ["mesh_id", "e"], "left_anti")
    return Trees(edge, of_vertices, of_faces, graph.cut(numbered(rest, "e", "generator")))


def _chains(trees: Trees, tree: DataFrame, plus: str, minus: str, sign) -> DataFrame:
    """rest's edge, and the way to the root from its ``plus`` end less that from its ``minus`` end."""
    rest = trees.rest
    starts = rest.select("mesh_id", F.explode(F.array(plus, minus)).alias("start"))
    ways = graph.root_paths(tree, starts).join(sent_by_key(trees.edges), ["mesh_id", "e"]).select("mesh_id", "start", "e", sign.alias("sign"))
    ends = F.array(F.struct(F.col(plus).alias("start"), F.lit(1).alias("turn")), F.struct(F.col(minus).alias("start"), F.lit(-1).alias("turn")))
    both = rest.select("mesh_id", "generator", F.explode(ends).alias("s")).select("mesh_id", "generator", "s.start", "s.turn")
    rows = both.join(ways, ["mesh_id", "start"]).select("mesh_id", "generator", "e", (F.col("turn") * F.col("sign")).alias("val"))
    rows = rows.unionByName(rest.select("mesh_id", "generator", "e", F.lit(1).alias("val")))
    return rows.groupBy("mesh_id", "generator", "e").agg(F.sum("val").cast("int").alias("val")).where("val <> 0")


def loops(trees: Trees) -> DataFrame:
    """(mesh_id, generator, e, val): closed loops of edges, +1 where a loop runs from lo to hi, -1 against."""
    return _chains(trees, trees.vertices, "hi", "lo", F.when(F.col("node") == F.col("lo"), 1).otherwise(-1))


def closed_forms(trees: Trees) -> DataFrame:
    """(mesh_id, generator, e, val): one-forms that add up to 0 around each face, 1 on their own edge, 0 on the others of rest."""
    return _chains(trees, trees.faces, "right", "left", F.when(F.col("node") == F.col("left"), 1).otherwise(-1))


def harmonic_forms(trees: Trees, tolerance: float = 1e-9) -> DataFrame:
    """(mesh_id, generator, e, val): the closed forms without their gradient part, so that they also add up to 0 at each vertex."""
    form = graph.cut(closed_forms(trees))
    at = form.join(trees.edges, ["mesh_id", "e"])
    ends = F.array(F.struct(F.col("hi").alias("v"), F.col("val").alias("value")), F.struct(F.col("lo").alias("v"), (-F.col("val")).alias("value")))
    load = at.select("mesh_id", F.col("generator").alias("system"), F.explode(ends).alias("s")).select("mesh_id", "system", "s.v", F.col("s.value").cast("double").alias("value"))
    root = trees.vertices.where("parent is null").select("mesh_id", F.col("node").alias("v"), F.lit(0.0).alias("value"))
    fixed = trees.rest.select("mesh_id", F.col("generator").alias("system")).join(root, "mesh_id")
    weights = trees.edges.select("mesh_id", F.col("lo").alias("v0"), F.col("hi").alias("v1"), F.lit(1.0).alias("weight"))
    x = solve.dirichlet(weights, fixed, load, tolerance=tolerance)
    rows = trees.edges.join(trees.rest.select("mesh_id", "generator"), "mesh_id").select("mesh_id", "generator", "e", "lo", "hi")
    for c in ("lo", "hi"):
        rows = rows.join(x.select("mesh_id", F.col("system").alias("generator"), F.col("v").alias(c), F.col("value").alias(f"x_{c}")), ["mesh_id", "generator", c])
    return rows.join(form, ["mesh_id", "generator", "e"], "left").select("mesh_id", "generator", "e", (F.coalesce("val", F.lit(0)) - (F.col("x_hi") - F.col("x_lo"))).alias("val"))
