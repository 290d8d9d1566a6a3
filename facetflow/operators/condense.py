"""Graphs condensed block by block, level by level, for questions whose answer passes through the vertices around a block.

Vertices fall into blocks of bounded size: runs in the order of their faces or edges where that is given, else of their ids; where places
are given too (cells in Morton order, cut into runs of as many vertices), each mesh takes what has fewer edges across. A vertex with a neighbour in an earlier block belongs to the interface; the others are inside, and no two
insides touch. A task condenses a block: its inside goes, and what it did to the vertices around it becomes edges among them
(an algebra says which). Four blocks make one of the next level, so levels grow with the logarithm of the vertices, and each level is
one grouped job. What is left of a mesh in the end is solved at once, and each level's insides follow from what is around them. A block is
held by one task: at most ``dense`` vertices inside, and as many around. One that would be larger is left whole, and if then too
much is left of a mesh, the caller's iteration solves the condensed graph.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from facetflow.shared import FEW, beside, drop_shared, materialize, sent_by_key

KEY = ["mesh_id", "system"]
#: A vertex apart, beside all blocks, which none holds: no vertex may have this number.
APART = -1
#: Vertices of a block of the first level in the mean; the most inside a block, and left of a mesh, that one task solves.
BLOCK, DENSE = 800, 2400


class Algebra(Protocol):
    """What a block does. ``rows``: (v, other, weight) from each vertex inside; ``values``: (system, v, value)."""

    #: Of edges between the same two vertices, in a task.
    merge: np.ufunc

    def merged(self, weight: str) -> Column:
        """The same in a table."""

    def fill(self, rows: pd.DataFrame, values: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Edges (a, b, value), a < b, and values (v, system, value) that the inside leaves to the vertices around it."""

    def inside(self, rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        """(v, system, value) of the inside, ``values`` having those of what is around it too."""


def both_ways(weights: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    ends = F.array(F.struct(F.col(a).alias("v"), F.col(b).alias("other")), F.struct(F.col(b).alias("v"), F.col(a).alias("other")))
    return weights.select("mesh_id", "weight", F.explode(ends).alias("s")).select("mesh_id", "s.v", "s.other", "weight")


def morton(places: DataFrame, bits: int) -> DataFrame:
    """(mesh_id, v, cell): cells of the mesh's bounding box, 2 ** bits along each axis, in Morton order."""
    box = places.groupBy("mesh_id").agg(*(F.min(c).alias(f"low_{c}") for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("wide"))
    part = {c: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col("wide")), F.lit(0.0)) * (1 << bits)), F.lit((1 << bits) - 1)) for c in "xyz"}
    code: Column = F.lit(0).cast("long")
    for k in range(bits):
        for i, c in enumerate("xyz"):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"cell_{c}"), k).bitwiseAND(1), 3 * k + i))
    cells = beside(places.select("mesh_id", "v", *"xyz"), box, ["mesh_id"]).select("mesh_id", "v", *(part[c].cast("long").alias(f"cell_{c}") for c in "xyz"))
    return cells.select("mesh_id", "v", code.alias("cell"))


def order_of(rows: DataFrame, at: str, *ends: str) -> DataFrame:
    """(mesh_id, v, at): the least ``at`` of the rows that have v among ``ends``: faces or edges of near numbers have near vertices."""
    return rows.select("mesh_id", F.col(at).alias("at"), F.explode(F.array(*ends)).alias("v")).groupBy("mesh_id", "v").agg(F.min("at").alias("at"))


def blocks(nodes: DataFrame, places: DataFrame | None, size: int, most: int, order: DataFrame | None = None) -> DataFrame:
    """(mesh_id, v, block): runs of about ``size`` of the vertices (mesh_id, v), neighbours by place, or by ``order`` (mesh_id, v, at) or id.

    ``most``: of a mesh's vertices.
    """
    if places is None:
        at = nodes.withColumn("at", F.col("v")) if order is None else nodes.join(sent_by_key(order.select("mesh_id", "v", "at")), ["mesh_id", "v"], "left").withColumn("at", F.coalesce("at", "v"))
        # some 16 cells a block, however far apart the numbers are
        top = 1 if order is None else max(1.0, (at.agg(F.max("at")).first()[0] or 0) / max(1, most))
        celled = at.select("mesh_id", "v", F.floor(F.col("at") * 16 / F.lit(float(size * top))).alias("cell"))
    else:
        bits = max(1, min(10, int(np.ceil(np.log2(max(1.0, 16 * most / (6 * size))) / 2))))
        celled = nodes.join(morton(places, bits), ["mesh_id", "v"], "left").select("mesh_id", "v", F.coalesce("cell", F.lit(0)).alias("cell"))
    count = celled.groupBy("mesh_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("mesh_id").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    run = count.select("mesh_id", "cell", F.floor(F.coalesce(before, F.lit(0)) / size).alias("block"))
    return celled.join(run, ["mesh_id", "cell"]).select("mesh_id", "v", "block")


def across(graph: DataFrame, block: DataFrame) -> DataFrame:
    """(mesh_id, met): edges (mesh_id, a, b) between blocks, for the meshes that have some."""
    ends = graph.where(F.col("a") != APART)
    for c in "ab":
        ends = ends.join(sent_by_key(block.select("mesh_id", F.col("v").alias(c), F.col("block").alias(f"block_{c}"))), ["mesh_id", c])
    return ends.where("block_a <> block_b").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("met"))


def best_blocks(graph: DataFrame, nodes: DataFrame, places: DataFrame | None, size: int, most: int, order: DataFrame | None) -> DataFrame:
    """The blocks, of those by order or id and those by place, that fewer of a mesh's edges join (by order on ties)."""
    first = blocks(nodes, None, size, most, order)
    if places is None:
        return materialize(first, "blocks")
    both = materialize(first.join(sent_by_key(blocks(nodes, places, size, most).withColumnRenamed("block", "place_block")), ["mesh_id", "v"]), "blocks")
    ends = graph.where(F.col("a") != APART)
    for c in "ab":
        ends = ends.join(sent_by_key(both.select("mesh_id", F.col("v").alias(c), F.col("block").alias(f"block_{c}"), F.col("place_block").alias(f"place_{c}"))), ["mesh_id", c])
    met = ends.groupBy("mesh_id").agg(F.count(F.when(F.col("block_a") != F.col("block_b"), 1)).alias("met"), F.count(F.when(F.col("place_a") != F.col("place_b"), 1)).alias("other"))
    placed = materialize(met.where("met > other").select("mesh_id", F.lit(True).alias("placed")), "by-place")
    n = placed.count()
    if not n:
        return both.select("mesh_id", "v", "block")
    # meshes are blocks apart: each takes the ones that it chose
    pick = both.join(F.broadcast(placed), "mesh_id", "left") if n <= FEW else both.join(placed, "mesh_id", "left")
    return pick.select("mesh_id", "v", F.when(F.col("placed"), F.col("place_block")).otherwise(F.col("block")).alias("block"))


#: What a row of a condensed level holds: an edge or a value that goes on; of what is inside, an edge, a value, or a vertex around it;
#: the number of vertices of the block that go on.
EDGE, VALUE, INNER, LOAD, AROUND, LEFT = range(6)
#: Between two vertices, the one apart included: their blocks go with them from level to level.
ENDS = ["mesh_id", "a", "b", "block_a", "block_b"]


def _level_rows(mesh: int, part: int, kind: int, **columns) -> pd.DataFrame:
    out = pd.DataFrame({k: columns[k] for k in ("a", "b", "block_a", "block_b", "system", "value") if k in columns})
    for c in ("a", "b", "block_a", "block_b", "system", "value"):
        if c not in out:
            out[c] = 0.0 if c == "value" else 0
    out.insert(0, "part", part)
    out.insert(0, "kind", kind)
    out.insert(0, "mesh_id", mesh)
    return out[["mesh_id", "kind", "part", "a", "b", "block_a", "block_b", "system", "value"]].astype({"a": "int64", "b": "int64", "block_a": "int64", "block_b": "int64", "system": "int64", "value": "float64"})


def _rows(found: DataFrame, kind: int) -> DataFrame:
    """A level's rows of one kind, read for themselves: Spark cogroups no two tables of one origin."""
    return found.sparkSession.read.schema(found.schema).parquet(found._shared_path).where(F.col("kind") == kind)


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` over all shuffle partitions by ``key``: Spark would merge partitions by their few bytes, and a few tasks take all blocks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


class Condensing:
    """``graph`` (mesh_id, a, b, weight), a < b, and ``values`` (mesh_id, system, v, value) of what is not yet condensed; mesh_id long.

    An edge has the blocks of its ends with it. So a level is one grouped job and one table: a block's task has all edges of its
    vertices, sees which of them have a neighbour in an earlier block, and hands on what goes on beside what stays.
    """

    def __init__(self, algebra: Algebra, graph: DataFrame, values: DataFrame, places: DataFrame | None, block: int, dense: int, order: DataFrame | None = None):
        self.algebra, self.dense = algebra, dense
        graph = materialize(graph, "graph")
        nodes = materialize(graph.select("mesh_id", F.explode(F.array("a", "b")).alias("v")).where(F.col("v") != APART).distinct(), "nodes")
        self.most, self.all = self._counted(nodes.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")))[:2]
        none = F.lit(0).cast("long")
        if self.most > dense:
            of = best_blocks(graph, nodes, places, block, self.most, order)
            for c in "ab":  # the vertex apart has none
                graph = graph.join(sent_by_key(of.select("mesh_id", F.col("v").alias(c), F.col("block").alias(f"block_{c}"))), ["mesh_id", c], "left" if c == "a" else "inner")
            graph = graph.withColumn("block_a", F.coalesce("block_a", F.lit(APART).cast("long")))
            values = values.join(sent_by_key(of), ["mesh_id", "v"])
        else:
            graph, values = graph.withColumn("block_a", none).withColumn("block_b", none), values.withColumn("block", none)
        self.graph, self.values = graph.select(*ENDS, "weight"), values.select(*KEY, "v", "block", "value")
        self.levels: list[DataFrame] = []
        fields = {"mesh_id": T.LongType(), "system": T.LongType(), "v": T.LongType(), "value": T.DoubleType()}
        self.schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    @staticmethod
    def _counted(each: DataFrame) -> tuple[int, int]:
        """Of vertices n that are left, rows of meshes: of the mesh with the most, and of all."""
        one = each.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        return int(one["most"] or 0), int(one["all"] or 0)

    def run(self) -> bool:
        """Condense until each mesh fits a task; whether it does."""
        shift, fits = 0, True
        while self.most > self.dense:
            before = self.all
            left = self._level(shift)
            self.most, self.all = self._counted(left.groupBy("mesh_id").agg(F.sum("value").alias("n")))
            if len(self.levels) > 3 and self.all > 0.8 * before:  # blocks are too large, or have too much around them
                fits = self.most <= self.dense
                break
            # four blocks make one, or more of them where they hold little
            parts = left.where("value > 0").count()
            shift += 2
            while shift < 62 and 2 * self.all / max(1, parts) * 4 <= self.dense / 2:
                shift, parts = shift + 1, parts / 2
        self.graph = self.graph.groupBy("mesh_id", "a", "b").agg(self.algebra.merged("weight").alias("weight"))
        self.values = self.values.groupBy(*KEY, "v").agg(F.sum("value").alias("value"))
        return fits

    def _level(self, shift: int) -> DataFrame:
        """(mesh_id, part, value): how many vertices of each block go on."""
        algebra, dense = self.algebra, self.dense
        ends = [F.struct(F.col(a).alias("v"), F.col(f"block_{a}").alias("block"), F.col(b).alias("other"), F.col(f"block_{b}").alias("other_block")) for a, b in (("a", "b"), ("b", "a"))]
        part = ["mesh_id", "part"]
        number = F.shiftright("block", shift).alias("part")
        rows = self.graph.select("mesh_id", "weight", F.explode(F.array(*ends)).alias("s")).select("mesh_id", "s.*", "weight").where(F.col("v") != APART).select("*", number)
        own = self.values.select("*", number)
        kinds = [("mesh_id", T.LongType()), ("kind", T.LongType()), ("part", T.LongType()), *((c, T.LongType()) for c in ("a", "b", "block_a", "block_b", "system")), ("value", T.DoubleType())]

        def made(key, one, two):
            mesh, part = int(key[0]), int(key[1])
            if not len(one):  # nothing leads to or from its vertices
                return _level_rows(mesh, part, LEFT, a=[])
            order = np.lexsort((one["other"], one["v"]))
            v, other, block, other_block, weight = (one[c].to_numpy()[order] for c in ("v", "other", "block", "other_block", "weight"))
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (other[1:] != other[:-1])])
            weight = algebra.merge.reduceat(weight, first)
            v, other, block, other_block = (x[first] for x in (v, other, block, other_block))
            apart, there = other == APART, other_block >> shift
            inner = ~np.isin(v, v[(there < part) & ~apart])
            inside = np.unique(v[inner])
            own = np.isin(other, inside)
            around = np.unique(other[inner & ~own])
            if max(len(inside), len(around)) > dense:  # too large for a task: left whole
                inner, inside, own, around = np.zeros(len(v), dtype=bool), inside[:0], np.zeros(len(v), dtype=bool), around[:0]
            at, where = np.unique(np.r_[v, other], return_index=True)
            blocks = np.r_[block, other_block][where]
            of = lambda x: blocks[np.searchsorted(at, x)]
            # an edge between blocks goes on with the earlier of them, whose vertex alone may be inside
            stay = ~inner & ~own & (apart | (there > part) | ((there == part) & (v < other)))
            a, b = np.minimum(v[stay], other[stay]), np.maximum(v[stay], other[stay])
            out = [_level_rows(mesh, part, EDGE, a=a, b=b, block_a=of(a), block_b=of(b), value=weight[stay])]
            held = np.isin(two["v"].to_numpy(), inside)
            keep, given = two[~held], two[held]
            out.append(_level_rows(mesh, part, VALUE, a=keep["v"].to_numpy(), block_a=keep["block"].to_numpy(), system=keep["system"].to_numpy(), value=keep["value"].to_numpy()))
            if len(inside):
                rows = pd.DataFrame({"v": v[inner], "other": other[inner], "weight": weight[inner]})
                edges, values = algebra.fill(rows, given[["system", "v", "value"]])
                values = values[values["v"] != APART]
                a, b, to = (x.to_numpy(dtype="int64") for x in (edges["a"], edges["b"], values["v"]))
                out.append(_level_rows(mesh, part, EDGE, a=a, b=b, block_a=of(a), block_b=of(b), value=edges["value"].to_numpy()))
                out.append(_level_rows(mesh, part, VALUE, a=to, block_a=of(to), system=values["system"].to_numpy(), value=values["value"].to_numpy()))
                out.append(_level_rows(mesh, part, INNER, a=v[inner], b=other[inner], value=weight[inner]))
                out.append(_level_rows(mesh, part, LOAD, a=given["v"].to_numpy(), system=given["system"].to_numpy(), value=given["value"].to_numpy()))
                out.append(_level_rows(mesh, part, AROUND, a=around))
            out.append(_level_rows(mesh, part, LEFT, a=[0], value=[float(len(np.unique(v)) - len(inside))]))
            return pd.concat(out, ignore_index=True)

        found = materialize(dealt(rows, *part).groupBy(*part).cogroup(dealt(own, *part).groupBy(*part)).applyInPandas(made, T.StructType([T.StructField(n, t) for n, t in kinds])), "condensed")
        self.levels.append(found)
        self.graph = _rows(found, EDGE).select(*ENDS, F.col("value").alias("weight"))
        self.values = _rows(found, VALUE).select(*KEY, F.col("a").alias("v"), F.col("block_a").alias("block"), "value")
        return _rows(found, LEFT).select("mesh_id", "part", "value")

    def inner(self) -> list[DataFrame]:
        """Level by level (mesh_id, part, v, other, weight): the edges from what is inside the blocks."""
        return [_rows(found, INNER).select("mesh_id", "part", F.col("a").alias("v"), F.col("b").alias("other"), F.col("value").alias("weight")) for found in self.levels]

    def rest(self) -> DataFrame:
        """(mesh_id, system, v, value) of what is left, each mesh by one task."""
        rows = both_ways(self.graph).where(F.col("v") != APART)
        return rows.groupBy("mesh_id").cogroup(self.values.groupBy("mesh_id")).applyInPandas(self._inside(), self.schema)

    def _inside(self):
        algebra = self.algebra

        def inside(key, one, two):
            out = algebra.inside(one, two)
            out.insert(0, "mesh_id", int(key[0]))
            return out[["mesh_id", "system", "v", "value"]]

        return inside

    def expanded(self, x: DataFrame) -> DataFrame:
        """``x`` of what is left, with the values of all that was condensed."""
        x = materialize(x, "found")
        part = ["mesh_id", "part"]
        for found, rows in reversed(list(zip(self.levels, self.inner()))):
            own = _rows(found, LOAD).select(*part, "system", F.col("a").alias("v"), "value")
            around = _rows(found, AROUND).select(*part, F.col("a").alias("v")).join(sent_by_key(x), ["mesh_id", "v"]).select(*part, "system", "v", "value")
            inner = dealt(rows, *part).groupBy(*part).cogroup(dealt(own.unionByName(around), *part).groupBy(*part)).applyInPandas(self._inside(), self.schema)
            x = x.unionByName(materialize(inner, "found"))
        drop_shared(*self.levels)
        return x


class MeshIds:
    """Ids of meshes of any kind as longs, and back."""

    def __init__(self, meshes: DataFrame):
        plain = isinstance(meshes.schema["mesh_id"].dataType, T.LongType)
        self.table = None if plain else materialize(meshes.select("mesh_id").distinct().withColumn("number", F.monotonically_increasing_id()), "meshes")

    def to_long(self, df: DataFrame) -> DataFrame:
        return df if self.table is None else beside(df, self.table, ["mesh_id"]).drop("mesh_id").withColumnRenamed("number", "mesh_id")

    def back(self, df: DataFrame) -> DataFrame:
        return df if self.table is None else beside(df.withColumnRenamed("mesh_id", "number"), self.table, ["number"]).drop("number")
