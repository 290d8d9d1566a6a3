"""Graphs over mesh tables: components and trees by iterated joins, breadth-first levels and shortest distances by condensed blocks.

Each round's state is written to the shared checkpoint folder, so lineage stays short and a lost executor costs no more than
its part of a round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.operators.condense import APART, BLOCK, DENSE, Condensing, MeshIds, both_ways, dealt, order_of
from facetflow.shared import drop_shared, sent_by_key, spread
from facetflow.shared import materialize as cut


#: Tables of fewer rows are joined without a look for hot keys.
FEW_ROWS = 1 << 17
#: Links that are left between parts, of all meshes, which a task for each mesh merges at once.
AT_ONCE = 1 << 18


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between numbers: each number, and the least of its component."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(mesh_id, node, root) for each node of edges (mesh_id, a, b): root is the least node of its component.

    Edges of near ids meet in a task, which links each node to the least that it is joined to there, the head of its part. Only heads
    of parts that share a node go on: few are merged at once (AT_ONCE), more by large-star and small-star steps until nothing
    changes, grouped minima and one join each, in which the neighbours of a hub are dealt out. Then each node takes its head's root.
    """
    ids = MeshIds(edges)
    own = ids.to_long(edges.select("mesh_id", "a", "b"))

    def near(batches):
        for pdf in batches:
            for mesh, some in pdf.groupby("mesh_id"):
                node, root = _merged(some["a"].to_numpy(), some["b"].to_numpy())
                yield pd.DataFrame({"mesh_id": mesh, "u": node, "v": root})

    kind = "mesh_id long, u long, v long"
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_by_place = own.repartition(parts, "mesh_id", F.floor(F.least("a", "b") / 16384)).sortWithinPartitions("mesh_id", F.least("a", "b"))
    every = cut(sorted_by_place.mapInPandas(near, kind))  # with a row for each node of each part
    heads = cut(every.groupBy("mesh_id", F.col("u").alias("node")).agg(F.min("v").alias("m"), F.max("v").alias("most")))
    shared = heads.where("m <> most").select("mesh_id", F.col("node").alias("u"), "m")
    links = cut(every.join(shared, ["mesh_id", "u"]).where("v <> m").select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    n = links.count()
    if n <= AT_ONCE:

        def whole(key, pdf):
            node, root = _merged(pdf["u"].to_numpy(), pdf["v"].to_numpy())
            return pd.DataFrame({"mesh_id": key[0], "u": node, "v": root})

        roots = links.groupBy("mesh_id").applyInPandas(whole, kind).where("u <> v")
    else:
        roots = _stars(links, max_rounds)
    roots = cut(roots.select("mesh_id", F.col("u").alias("m"), F.col("v").alias("root")))
    found = heads.select("mesh_id", "node", "m")
    found = found.join(F.broadcast(roots), ["mesh_id", "m"], "left") if n <= AT_ONCE else spread(found, roots, ["mesh_id", "m"], F.col("node"), "left")
    return ids.back(found.select("mesh_id", "node", F.coalesce("root", "m").alias("root")))


def _stars(links: DataFrame, max_rounds: int) -> DataFrame:
    """(mesh_id, u, v): of links (mesh_id, u, v), u > v, each node that is not the least of its component, and that one."""
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("mesh_id", "u", "v").cast("decimal(38,0)"))).first())
    now, mark = links, state(links)
    for _ in range(max_rounds):
        # large-star: each larger neighbour of u goes to the least of u and its neighbours
        both = now.unionByName(now.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("mesh_id", "u").agg(F.min("v").alias("m")).select("mesh_id", "u", F.least("u", "m").alias("m"))
        large = spread(both.where("v > u"), least, ["mesh_id", "u"], F.col("v"), least=FEW_ROWS).select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: each smaller neighbour of u, and u, go to the least of them
        low = large.groupBy("mesh_id", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["mesh_id", "u"]).select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("mesh_id", "u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        got = state(new)
        drop_shared(now)
        now = new
        if got == mark:
            return now
        mark = got
    raise RuntimeError(f"components: no end after {max_rounds} rounds")


def _sums(a: np.ndarray, b: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of steps from a to b by val: each number, the least of its component, and what the steps add up to from that to the number."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root, off = np.arange(len(nodes)), np.zeros(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root], off
        u, v, val, x, y = u[apart], v[apart], val[apart], x[apart], y[apart]
        step = off[u] + val - off[v]  # from x to y
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        root[high[first]] = low[first]
        off[high[first]] = np.where(y[first] > x[first], step[first], -step[first])
        while True:
            up = root[root]
            if (up == root).all():
                break
            off = off + np.where(up == root, 0.0, off[root])
            root = up


def potentials(steps: DataFrame, at_once: int | None = None) -> DataFrame:
    """(mesh_id, generator, node, value): what steps (mesh_id, generator, a, b, val, at) add up to from the least node of each component.

    All ways from node to node must add up to the same, as in the integral of a closed form over a disk. Steps of near numbers ``at``
    meet in a task, which adds them up from the head of each part. Heads of parts that share a node are steps again: few are added up
    at once, more by themselves in this way; where that does not help, along trees of levels by pointer doubling.
    """
    at_once = AT_ONCE if at_once is None else at_once
    ids = MeshIds(steps)
    own = ids.to_long(steps.select("mesh_id", F.col("generator").cast("long").alias("generator"), "a", "b", F.col("val").cast("double").alias("val"), "at"))
    kind = "mesh_id long, generator long, node long, head long, value double"

    def added(mesh, generator, pdf):
        node, head, value = _sums(*(pdf[c].to_numpy() for c in ("a", "b", "val")))
        return pd.DataFrame({"mesh_id": mesh, "generator": generator, "node": node, "head": head, "value": value})

    def near(batches):
        for pdf in batches:
            for (mesh, generator), some in pdf.groupby(["mesh_id", "generator"]):
                yield added(mesh, generator, some)

    key = ["mesh_id", "generator"]
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = cut(own.repartition(parts, *key, F.floor(F.col("at") / 16384)).sortWithinPartitions(*key, "at").mapInPandas(near, kind))
    heads = cut(every.groupBy(*key, "node").agg(F.min(F.struct("head", "value")).alias("m"), F.max("head").alias("most")))
    shared = heads.where("m.head <> most").select(*key, "node", "m")
    links = every.join(shared, [*key, "node"]).where("head <> m.head").groupBy(*key, F.col("m.head").alias("a"), F.col("head").alias("b")).agg(F.min(F.col("m.value") - F.col("value")).alias("val"))
    links = cut(links.withColumn("at", F.floor(F.col("a") / 64)))  # heads are far apart
    n = links.count()
    if n <= at_once:
        far = links.groupBy(*key).applyInPandas(lambda k, pdf: added(*k, pdf), kind)
    elif n < every.count() / 2:
        far = potentials(links, at_once)
    else:
        far = _tree_sums(links)
    far = cut(far.select(*key, F.col("node").alias("head"), F.col("value").alias("more")))
    found = heads.select(*key, "node", F.col("m.head").alias("head"), F.col("m.value").alias("value"))
    found = found.join(F.broadcast(far), [*key, "head"], "left") if n <= at_once else spread(found, far, [*key, "head"], F.col("node"), "left")
    return ids.back(found.select(*key, "node", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))).withColumn("generator", F.col("generator").cast(steps.schema["generator"].dataType))


def _tree_sums(steps: DataFrame) -> DataFrame:
    """(mesh_id, generator, node, value) as :func:`potentials`, along trees of levels."""
    of = steps.select(F.struct("mesh_id", "generator").alias("mesh_id"), "a", "b", "val")
    part = cut(components(of))
    rows = of.join(part.select("mesh_id", F.col("node").alias("a"), "root"), ["mesh_id", "a"])
    own = F.struct("mesh_id.mesh_id", "mesh_id.generator", "root").alias("mesh_id")
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("parent"), (-F.col("val")).alias("val")), F.struct(F.col("b").alias("node"), F.col("a").alias("parent"), F.col("val").alias("val")))
    edge = cut(rows.select(own, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.monotonically_increasing_id().alias("e"), "val"))
    tree = cut(bfs_tree(edge))
    up = edge.select("mesh_id", F.explode(both).alias("s")).select("mesh_id", "s.*").groupBy("mesh_id", "node", "parent").agg(F.min("val").alias("val"))
    step = tree.where("parent is not null").select("mesh_id", "node", "parent").join(up, ["mesh_id", "node", "parent"])
    sums = sums_to_root(step.select("mesh_id", F.lit(0).alias("generator"), "node", "parent", "val"))
    return sums.select("mesh_id.mesh_id", "mesh_id.generator", "node", "value")


#: Vertices of a block whose ways are kept as one matrix (46 MB).
WHOLE = 2400


class Ways:
    """Blocks of a graph of lengths: what counts is the shortest way, and the vertex apart is the start of all of them."""

    merge = np.minimum

    def merged(self, weight: str) -> Column:
        return F.min(weight)

    @staticmethod
    def shortest(n: int, a: np.ndarray, b: np.ndarray, length: np.ndarray, start: np.ndarray, chunk: int = 64) -> np.ndarray:
        """``start`` (ways, n) made as short as edges in both directions allow."""
        tail, head, length = np.r_[a, b], np.r_[b, a], np.r_[length, length]
        order = np.argsort(head, kind="stable")
        tail, head, length = tail[order], head[order], length[order]
        begin = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(head) else np.zeros(0, dtype=int)
        into = head[begin]
        for i in range(0, len(start) if len(head) else 0, chunk):
            some = np.ascontiguousarray(start[i : i + chunk].T)  # a row for each vertex, as edges take rows
            while True:
                old = some[into]
                new = np.minimum(old, np.minimum.reduceat(some[tail] + length[:, None], begin, axis=0))
                if (new == old).all():
                    break
                some[into] = new
            start[i : i + chunk] = some.T
        return start

    @staticmethod
    def eliminated(n: int, m: int, a: np.ndarray, b: np.ndarray, length: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Between the vertices from m on, the shortest ways through those below m, which go one by one, that of the fewest neighbours first.

        ``start`` (n, ways), distances so far, is taken on: a vertex that goes gives its own to those that it leaves.
        """
        way = np.full((n, n), np.inf)
        np.minimum.at(way, (np.r_[a, b], np.r_[b, a]), np.r_[length, length])
        degree = np.isfinite(way).sum(axis=1)
        degree[m:] = 2 * n
        for _ in range(m):
            k = int(degree.argmin())
            near = np.flatnonzero(np.isfinite(way[k]))
            near = near[near != k]
            step, both = way[k, near], np.ix_(near, near)
            if start is not None and np.isfinite(start[k]).any():
                start[near] = np.minimum(start[near], start[k] + step[:, None])
            way[both] = np.minimum(way[both], step[:, None] + step)
            way[near, k] = np.inf
            degree[k] = 3 * n
            left = near[near < m]
            degree[left] = np.isfinite(way[left]).sum(axis=1)
            way[k] = np.inf
        return way[m:, m:]

    @staticmethod
    def parts(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Inside, around, and the edges as places in both, one after the other."""
        v, other = rows["v"].to_numpy(), rows["other"].to_numpy()
        inside = np.unique(v)
        around = np.setdiff1d(other, inside)
        own = np.isin(other, inside)
        at = np.where(own, np.searchsorted(inside, other), len(inside) + np.searchsorted(around, other))
        once = ~own | (v < other)  # an edge within stands in two rows
        return inside, around, np.searchsorted(inside, v)[once], at[once], rows["weight"].to_numpy()[once]

    def fill(self, rows: pd.DataFrame, values: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        inside, around, a, b, length = self.parts(rows)
        m, n = len(inside), len(inside) + len(around)
        if n <= WHOLE:
            way = self.eliminated(n, m, a, b, length)
        else:
            start = np.full((len(around), n), np.inf)
            start[np.arange(len(around)), m + np.arange(len(around))] = 0.0
            way = self.shortest(n, a, b, length, start)[:, m:]
        i, j = np.nonzero(np.triu(np.isfinite(way), 1))
        return pd.DataFrame({"a": around[i], "b": around[j], "value": way[i, j]}), pd.DataFrame({"v": around[:0], "system": around[:0], "value": way[:0, 0] if len(around) else np.zeros(0)})

    def inside(self, rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        inside, around, a, b, length = self.parts(rows)
        start = np.full((1, len(inside) + len(around)), np.inf)
        start[0, len(inside) + np.searchsorted(around, values["v"].to_numpy())] = values["value"].to_numpy()
        start[0, len(inside) + np.flatnonzero(around == APART)] = 0.0
        way = self.shortest(start.shape[1], a, b, length, start)[0, : len(inside)]
        found = np.isfinite(way)
        return pd.DataFrame({"v": inside[found], "system": 0, "value": way[found]})


def distances(edges: DataFrame, sources: DataFrame, within: float | None = None, places: DataFrame | None = None, block: int = BLOCK, dense: int = DENSE, order: DataFrame | None = None) -> DataFrame:
    """(mesh_id, node, distance) along edges (mesh_id, a, b, length) from any of the sources (mesh_id, node); ids are not negative.

    The graph is condensed by blocks (see condense): shortest ways between the vertices around a block stand for its inside. So the
    rounds grow with the logarithm of the nodes, not with the edges of a way. Where that does not help, as in a graph without
    neighbourhoods, edges are relaxed round by round. Nodes farther than ``within`` have no row.
    ``places``: (mesh_id, v, x, y, z), by which nodes near each other share a block; ``order``: (mesh_id, v, at), by which those of near
    numbers ``at`` do, else those of near ids.
    """
    ids = MeshIds(edges.select("mesh_id").unionByName(sources.select("mesh_id")))
    own, starts = ids.to_long(edges.select("mesh_id", "a", "b", "length")), ids.to_long(sources.select("mesh_id", "node").distinct())
    lengths = own.where("a <> b").select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("length").alias("weight"))
    apart = starts.select("mesh_id", F.lit(APART).cast("long").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("weight"))
    graph = lengths.unionByName(apart).groupBy("mesh_id", "a", "b").agg(F.min("weight").alias("weight"))
    none = graph.select("mesh_id", F.lit(0).cast("long").alias("system"), F.col("a").alias("v"), F.col("weight").alias("value")).limit(0)
    state = Condensing(Ways(), graph, none, None if places is None else ids.to_long(places), block, dense, None if order is None else ids.to_long(order))
    if state.run():
        rest = state.rest()
    else:
        start = state.graph.where(F.col("a") == APART).select("mesh_id", F.col("a").alias("node")).distinct()
        far = relaxed(state.graph.withColumnRenamed("weight", "length"), start).where(F.col("node") != APART)
        rest = far.select("mesh_id", F.lit(0).cast("long").alias("system"), F.col("node").alias("v"), F.col("distance").alias("value"))
    far = ids.back(state.expanded(rest)).select("mesh_id", F.col("v").alias("node"), F.col("value").alias("distance"))
    return far if within is None else far.where(F.col("distance") <= within * (1 + 1e-12))  # sums of lengths are rounded


#: Pairs that a task takes through a block at a time.
PAIRS = 512


def pair_distances(edges: DataFrame, pairs: DataFrame, block: int = BLOCK, dense: int = DENSE, order: DataFrame | None = None) -> DataFrame | None:
    """(mesh_id, pair_id, distance) along edges (mesh_id, a, b, length) for pairs (mesh_id, pair_id, source, target) that have a way.

    The graph is condensed once for all pairs. Then both ends of a pair go up its levels: within the block that holds it, an end's
    distances to what is inside give those to the vertices around, and the inside is left. A shortest way has vertices of a highest
    level, all in one block, and there the two ends meet. Rows grow with pairs times levels, not with pairs times vertices. A pair goes
    on only while a shorter way than its best may come. None where the graph does not condense.
    """
    ids = MeshIds(edges.select("mesh_id").unionByName(pairs.select("mesh_id")))
    own = ids.to_long(edges.select("mesh_id", "a", "b", "length")).where("a <> b")
    graph = own.groupBy("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("length").alias("weight"))
    none = graph.select("mesh_id", F.lit(0).cast("long").alias("system"), F.col("a").alias("v"), F.col("weight").alias("value")).limit(0)
    state = Condensing(Ways(), graph, none, None, block, dense, None if order is None else ids.to_long(order))
    if not state.run():
        return None
    asked = cut(ids.to_long(pairs.select("mesh_id", "pair_id", "source", "target")).withColumn("pair", F.monotonically_increasing_id()))
    ends = F.array(*(F.struct(F.lit(k).cast("long").alias("side"), F.col(c).alias("v")) for k, c in enumerate(("source", "target"))))
    ask = asked.select("mesh_id", "pair", F.explode(ends).alias("s")).select("mesh_id", "pair", "s.side", "s.v", F.lit(0.0).alias("value"))
    best = asked.where("source = target").select("mesh_id", "pair", F.lit(0.0).alias("value"))
    key = ["mesh_id", "part", "chunk"]

    def through(key, one, two):
        inside, around, a, b, length = Ways.parts(one)
        m, n = len(inside), len(inside) + len(around)
        system, row = np.unique(two["pair"].to_numpy() * 2 + two["side"].to_numpy(), return_inverse=True)
        start = np.full((n, len(system)), np.inf)
        np.minimum.at(start, (np.searchsorted(inside, two["v"].to_numpy()), row), two["value"].to_numpy())
        if n <= WHOLE:
            Ways.eliminated(n, m, a, b, length, start)
            way = start.T
        else:
            way = Ways.shortest(n, a, b, length, start.T.copy())
        i, j = np.nonzero(np.isfinite(way[:, m:]))
        out = pd.DataFrame({"pair": system[i] // 2, "side": system[i] % 2, "v": around[j], "value": way[i, m + j]})
        both = np.flatnonzero((system[1:] // 2 == system[:-1] // 2)) if len(system) else np.zeros(0, dtype=int)
        met = (way[both] + way[both + 1]).min(axis=1) if len(both) else np.zeros(0)
        out = pd.concat([out, pd.DataFrame({"pair": system[both] // 2, "side": 2, "v": 0, "value": met})[np.isfinite(met)]], ignore_index=True)
        out.insert(0, "mesh_id", int(key[0]))
        return out

    for rows in [*state.inner(), both_ways(state.graph).select("mesh_id", F.lit(0).cast("long").alias("part"), "v", "other", "weight")]:
        of = cut(rows.select("mesh_id", "part", "v").distinct())
        here = cut(ask.join(sent_by_key(of), ["mesh_id", "v"]).select("mesh_id", "part", "pair", "side", "v", "value"))
        chunks = cut(here.groupBy("mesh_id", "part").agg(F.ceil(F.approx_count_distinct("pair") / PAIRS).alias("chunks")))
        many = rows.join(sent_by_key(chunks), ["mesh_id", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        some = here.join(sent_by_key(chunks), ["mesh_id", "part"]).withColumn("chunk", F.pmod(F.xxhash64("pair"), F.col("chunks"))).drop("chunks")
        got = cut(dealt(many, *key).groupBy(*key).cogroup(dealt(some, *key).groupBy(*key)).applyInPandas(through, "mesh_id long, pair long, side long, v long, value double"))
        best = cut(best.unionByName(got.where("side = 2").select("mesh_id", "pair", "value")).groupBy("mesh_id", "pair").agg(F.min("value").alias("value")))
        ask = ask.join(sent_by_key(of), ["mesh_id", "v"], "left_anti").unionByName(got.where("side < 2")).groupBy("mesh_id", "pair", "side", "v").agg(F.min("value").alias("value"))
        ask = cut(ask)
        near = ask.groupBy("mesh_id", "pair").agg(*(F.min(F.when(F.col("side") == k, F.col("value"))).alias(f"m{k}") for k in (0, 1)))
        near = near.where("m0 is not null and m1 is not null").join(best.withColumnRenamed("value", "best"), ["mesh_id", "pair"], "left")
        ask = cut(ask.join(sent_by_key(near), ["mesh_id", "pair"]).where("best is null or value + if(side = 0, m1, m0) < best").select("mesh_id", "pair", "side", "v", "value"))
    drop_shared(*state.levels)
    found = asked.select("mesh_id", "pair", "pair_id").join(best, ["mesh_id", "pair"])
    return ids.back(found.select("mesh_id", "pair_id", F.col("value").alias("distance")))


def bfs_levels(edges: DataFrame, roots: DataFrame, places: DataFrame | None = None, block: int = BLOCK, dense: int = DENSE, order: DataFrame | None = None) -> DataFrame:
    """(mesh_id, node, level): the number of edges from the mesh's root (mesh_id, node), for all nodes reached."""
    far = distances(edges.select("mesh_id", "a", "b", F.lit(1.0).alias("length")), roots, places=places, block=block, dense=dense, order=order)
    return far.select("mesh_id", "node", F.col("distance").cast("long").alias("level"))


def relaxed(edges: DataFrame, sources: DataFrame, within: float | None = None, max_rounds: int = 10_000, cut_every: int = 4) -> DataFrame:
    """What :func:`distances` gives, edge by edge: for short ways, as its rounds are as many as the longest way has edges.

    Only nodes whose distance became less are relaxed in the next round.
    """
    both = cut(edges.select("mesh_id", "length", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("s")).select("mesh_id", "s.node", "s.other", "length"))
    whole = best = active = cut(sources.select("mesh_id", "node", F.lit(0.0).alias("distance")).distinct())
    found = []
    for _ in range(max_rounds):
        offer = active.join(both, ["mesh_id", "node"]).groupBy("mesh_id", F.col("other").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("offer"))
        offer = offer if within is None else offer.where(F.col("offer") <= within)
        less = offer.join(best, ["mesh_id", "node"], "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance") - 1e-12))
        active = cut(less.select("mesh_id", "node", F.col("offer").alias("distance")))
        if not active.limit(1).count():
            return best
        found.append(active)
        best = best.join(active, ["mesh_id", "node"], "left_anti").unionByName(active)
        if len(found) == cut_every:  # till then only what changed is written
            best = cut(best)
            drop_shared(whole, *found[:-1])
            whole, found = best, found[-1:]
    raise RuntimeError(f"relaxed: no end after {max_rounds} rounds")


def bfs_tree(edges: DataFrame) -> DataFrame:
    """(mesh_id, node, level, parent, e) of each mesh's edges (mesh_id, a, b, e), from its least node, which has no parent.

    A node hangs on the least of its neighbours that are one level nearer to the root.
    """
    roots = edges.groupBy("mesh_id").agg(F.least(F.min("a"), F.min("b")).alias("node"))
    level = cut(bfs_levels(edges, roots, order=cut(order_of(edges, "e", "a", "b"))))
    both = edges.select("mesh_id", "e", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("s")).select("mesh_id", "s.node", "s.other", "e")
    near = level.select("mesh_id", F.col("node").alias("other"), (F.col("level") + 1).alias("level"))
    up = both.join(sent_by_key(level), ["mesh_id", "node"]).join(sent_by_key(near), ["mesh_id", "other", "level"]).groupBy("mesh_id", "node").agg(F.min(F.struct("other", "e")).alias("up"))
    return level.join(sent_by_key(up), ["mesh_id", "node"], "left").select("mesh_id", "node", "level", F.col("up.other").alias("parent"), F.col("up.e").alias("e"))


def shortest_tree(edges: DataFrame, distance: DataFrame) -> DataFrame:
    """(mesh_id, node, parent, e): for each node of ``distance`` (mesh_id, node, distance) a neighbour on a shortest way to its source.

    edges: (mesh_id, a, b, length). Of several it is the nearest to the source, then the least; an edge of length 0 leads to
    a parent only where no other does. e is the node itself. Sources have no parent.
    """
    both = edges.select("mesh_id", "length", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("s")).select("mesh_id", "s.node", "s.other", "length")
    near = distance.select("mesh_id", F.col("node").alias("other"), F.col("distance").alias("before"))
    # far from the source sums are rounded by more than 1e-12: of what is within rounding the way that is nearest to the distance counts
    excess = F.col("before") + F.col("length") - F.col("distance")
    fits = (excess <= 1e-12 * (1 + F.col("distance"))) & ((F.col("before") < F.col("distance") - 1e-15) | ((F.col("length") == 0) & (F.col("distance") > 0)))
    step = both.join(distance, ["mesh_id", "node"]).join(near, ["mesh_id", "other"]).where(fits).withColumn("excess", F.when(excess > 1e-12, excess).otherwise(0.0))
    # where only edges of length 0 lead to a node it hangs on one that is reached otherwise, or on one that hangs on such a one
    firm = step.where("length > 0").select("mesh_id", F.col("node").alias("other"), F.lit(1).alias("firm")).distinct()
    by = step.join(firm, ["mesh_id", "other"], "left").groupBy("mesh_id", "node").agg(F.min(F.struct((F.col("length") == 0).alias("flat"), F.col("firm").isNull().alias("loose"), "excess", "before", "other")).alias("up"))
    return distance.join(by, ["mesh_id", "node"], "left").select("mesh_id", "node", F.when(F.col("distance") > 0, F.col("up.other")).alias("parent"), F.col("node").alias("e"))


def sums_to_root(steps: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(mesh_id, generator, node, value): the sum of val over the steps (mesh_id, generator, node, parent, val) from node to the root."""
    now = cut(steps.select("mesh_id", "generator", "node", F.col("parent").alias("to"), F.col("val").alias("value")))
    for _ in range(max_rounds):
        ahead = now.select("mesh_id", "generator", F.col("node").alias("to"), F.col("to").alias("far"), F.col("value").alias("more"))
        # those that have come to a root take no part: they would all share one key
        going = spread(now.where("to is not null"), ahead, ["mesh_id", "generator", "to"], F.col("node"), "left", least=FEW_ROWS).select("mesh_id", "generator", "node", F.col("far").alias("to"), (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))
        new = cut(now.where("to is null").unionByName(going))
        drop_shared(now)
        now = new
        if not now.where("to is not null").limit(1).count():
            return now.select("mesh_id", "generator", "node", "value")
    raise RuntimeError(f"sums_to_root: no end after {max_rounds} rounds")


def root_paths(tree: DataFrame, starts: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(mesh_id, start, node, e): the nodes on the way from each start (mesh_id, start) to the root, with the edge up from each.

    Steps double in each round: a tree of depth n takes log2 n rounds. Their tables hold most of the tree and never go to the driver.
    """
    jump = tree.where("parent is not null").select("mesh_id", "node", F.col("parent").alias("to"))
    reached, old = starts.select("mesh_id", "start").distinct().withColumn("node", F.col("start")), []
    for _ in range(max_rounds):
        jump = cut(jump)
        drop_shared(*old)
        if not jump.limit(1).count():
            return reached.join(sent_by_key(tree.where("parent is not null").select("mesh_id", "node", "e")), ["mesh_id", "node"]).select("mesh_id", "start", "node", "e")
        further = reached.join(sent_by_key(jump), ["mesh_id", "node"]).select("mesh_id", "start", F.col("to").alias("node"))
        old = [jump, reached]
        reached = cut(reached.unionByName(further))
        jump = jump.join(sent_by_key(jump.select("mesh_id", F.col("node").alias("to"), F.col("to").alias("far"))), ["mesh_id", "to"]).select("mesh_id", "node", F.col("far").alias("to"))
    raise RuntimeError(f"root_paths: no end after {max_rounds} rounds")
