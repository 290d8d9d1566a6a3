"""Meshes of genus 1 cut open to a disk: their ring, the unit square, forms integrated over it, and its nine tiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.operators import graph, homology, locate, measures, solve
from facetflow.operators.condense import order_of
from facetflow.operators.embedding import boundary_rings
from facetflow.operators.surgery import Split, split
from facetflow.operators.topology import Mesh, MeshError, edges, halfedges
from facetflow.shared import beside


def rooted_ring(cut: Split) -> DataFrame:
    """(mesh_id, n, pos, v, orig, side, start, stop): the ring of the disk from a copy of the root, in its four sides.

    The root is the one vertex that stands on the ring four times; its copies part the sides, and the ring starts at that of
    the least id. MeshError where there is no such vertex or a vertex stands there more often.
    """
    ring = graph.cut(boundary_rings(halfedges(cut.mesh.faces)).join(cut.copies, ["mesh_id", "v"], "left").select("mesh_id", "n", "pos", "v", F.coalesce("ref", "v").alias("orig")))
    times = ring.groupBy("mesh_id", "orig").agg(F.count(F.lit(1)).alias("times")).where("times >= 4")
    bad = ring.select("mesh_id").distinct().join(times.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("roots"), F.max("times").alias("most")), "mesh_id", "left").where("roots is null or roots <> 1 or most <> 4")
    if bad.limit(1).count():
        raise MeshError("The generators do not meet at one vertex.")
    at = ring.join(times.select("mesh_id", "orig"), ["mesh_id", "orig"]).groupBy("mesh_id").agg(F.min_by("pos", "v").alias("head"), F.collect_list("pos").alias("at"))  # four places a mesh
    moved = lambda p: F.pmod(p - F.col("head"), F.col("n"))
    turned = ring.join(F.broadcast(at), "mesh_id").select("mesh_id", "n", moved(F.col("pos")).alias("pos"), "v", "orig", F.array_sort(F.transform("at", moved)).alias("at"))
    side = F.size(F.filter("at", lambda p: p <= F.col("pos"))) - 1
    return turned.withColumn("side", side).select("mesh_id", "n", "pos", "v", "orig", "side", F.get("at", F.col("side")).alias("start"), F.coalesce(F.get("at", F.col("side") + 1), F.col("n")).alias("stop"))


def generators(ring: DataFrame, swap: bool = False) -> DataFrame:
    """(mesh_id, generator, pos, v): the original vertices along the first two sides, from the root to before the root."""
    number = F.when(F.col("side") == 0, 2 if swap else 1).otherwise(1 if swap else 2)
    return ring.where("side < 2").select("mesh_id", number.alias("generator"), (F.col("pos") - F.col("start")).alias("pos"), F.col("orig").alias("v"))


def square(ring: DataFrame) -> DataFrame:
    """(mesh_id, v, u, w): the ring evenly on the sides of the unit square, counter-clockwise from (0, 0)."""
    t = (F.col("pos") - F.col("start")) / (F.col("stop") - F.col("start"))
    s, zero, one = F.col("side"), F.lit(0.0), F.lit(1.0)
    u = F.when(s == 0, t).when(s == 1, one).when(s == 2, 1 - t).otherwise(zero)
    w = F.when(s == 0, zero).when(s == 1, t).when(s == 2, one).otherwise(1 - t)
    return ring.select("mesh_id", "v", u.alias("u"), w.alias("w"))


def planar_embedding(cut: Split, kind: str = "Uniform", tolerance: float = 1e-10) -> DataFrame:
    """(mesh_id, v, u, w): the disk in the unit square, inner vertices at the weighted mean of their neighbours."""
    placed = graph.cut(square(rooted_ring(cut)))
    two = F.array(F.struct(F.lit(0).alias("system"), F.col("u").alias("value")), F.struct(F.lit(1).alias("system"), F.col("w").alias("value")))
    fixed = graph.cut(placed.select("mesh_id", "v", F.explode(two).alias("s")).select("mesh_id", "s.system", "v", "s.value"))
    weights = graph.cut(measures.edge_weights(cut.mesh, kind).select("mesh_id", "v0", "v1", "weight"))
    x = solve.dirichlet(weights, fixed, places=cut.mesh.vertices, tolerance=tolerance, order=graph.cut(order_of(cut.mesh.faces, "f", *"abc")))
    return x.groupBy("mesh_id", "v").agg(*(F.max(F.when(F.col("system") == k, F.col("value"))).alias(c) for k, c in enumerate("uw")))


def integrated(cut: Split, forms: DataFrame) -> DataFrame:
    """(mesh_id, generator, v, value): closed one-forms (mesh_id, generator, e, lo, hi, val) of the closed mesh, added up over the disk.

    val counts from lo to hi, original vertices. Values count from the disk's first vertex; the disk has no hole, so all ways to a
    vertex give the same (see graph.potentials).
    """
    at = edges(halfedges(cut.mesh.faces)).select("mesh_id", F.col("e").alias("at"), F.col("v0").alias("a"), F.col("v1").alias("b"))
    for c in "ab":
        at = at.join(cut.copies.select("mesh_id", F.col("v").alias(c), F.col("ref").alias(f"ref_{c}")), ["mesh_id", c], "left").withColumn(f"ref_{c}", F.coalesce(f"ref_{c}", c))
    at = at.withColumn("lo", F.least("ref_a", "ref_b")).withColumn("hi", F.greatest("ref_a", "ref_b"))
    val = F.when(F.col("ref_a") == F.col("lo"), F.col("val")).otherwise(-F.col("val")).cast("double")
    step = at.join(forms.select("mesh_id", "generator", "lo", "hi", "val"), ["mesh_id", "lo", "hi"]).select("mesh_id", "generator", "a", "b", val.alias("val"), "at")
    return graph.potentials(step).select("mesh_id", "generator", F.col("node").alias("v"), "value")


def periods(loops: DataFrame, forms: DataFrame) -> DataFrame:
    """(mesh_id, loop, generator, value): what each one-form (mesh_id, generator, e, val) adds up to along each loop (.., generator, e, val)."""
    along = loops.select("mesh_id", F.col("generator").alias("loop"), "e", F.col("val").alias("way"))
    return along.join(forms.select("mesh_id", "generator", "e", "val"), ["mesh_id", "e"]).groupBy("mesh_id", "loop", "generator").agg(F.sum(F.col("way") * F.col("val")).alias("value"))


class Coordinates(NamedTuple):
    """A torus cut open along its trees' loops, and (mesh_id, v, u, w) of the disk's vertices."""

    cut: Split
    uv: DataFrame


def harmonic_coordinates(mesh: Mesh, uncuttable: DataFrame | None = None) -> Coordinates:
    """Coordinates whose steps along edges are harmonic, and that rise by 1, one each, once around the two loops of the trees.

    Two harmonic forms are added up over the disk that the loops leave; the inverse of their periods takes the sums to
    coordinates. So copies of a vertex differ by whole numbers. MeshError for meshes of another genus than 1.
    """
    trees = homology.tree_cotree(mesh, uncuttable)
    if trees.rest.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").limit(1).count() or not trees.rest.limit(1).count():
        raise MeshError("Mesh is not of genus 1.")
    loop = graph.cut(homology.loops(trees))
    ends = trees.edges.select("mesh_id", "e", "lo", "hi")
    made = split(mesh, graph.cut(loop.join(ends, ["mesh_id", "e"]).select("mesh_id", "lo", "hi").distinct()))
    cut = Split(Mesh(graph.cut(made.mesh.vertices), graph.cut(made.mesh.faces)), graph.cut(made.copies))
    forms = graph.cut(homology.harmonic_forms(trees).join(ends, ["mesh_id", "e"]))
    at = lambda rows, keys: rows.groupBy(*keys).agg(*(F.max(F.when(F.col("generator") == k, F.col("value"))).alias(f"h{k}") for k in (0, 1)))
    sums = at(integrated(cut, forms), ["mesh_id", "v"])
    around = at(periods(loop, forms), ["mesh_id", "loop"])
    one, two = (around.where(F.col("loop") == k).select("mesh_id", F.col("h0").alias(f"p{k}0"), F.col("h1").alias(f"p{k}1")) for k in (0, 1))
    # the map that takes the loops' periods to (1, 0) and (0, 1)
    entries = measures.period_map((("p00", "p01"), ("p10", "p11")), ((1.0, 0.0), (0.0, 1.0)))
    maps = one.join(two, "mesh_id").select("mesh_id", *(x.alias(f"m{k}") for k, x in enumerate(entries)))
    rows = beside(sums, maps, ["mesh_id"])
    u, w = F.col("m0") * F.col("h0") + F.col("m1") * F.col("h1"), F.col("m2") * F.col("h0") + F.col("m3") * F.col("h1")
    return Coordinates(cut, graph.cut(rows.select("mesh_id", "v", u.alias("u"), w.alias("w"))))


def cover(cut: Split, uv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The disk in the plane three by three times: nodes (mesh_id, node, tile, v, orig, u, w) and edges (mesh_id, a, b, length).

    node = 9 v + tile. A tile's edges have their length in the plane; copies of one vertex at the same place of the plane are
    linked at length 0, each with the least of them.
    """
    nine = F.array(*(F.struct(F.lit(3 * (a + 1) + b + 1).alias("tile"), F.lit(a).alias("tu"), F.lit(b).alias("tw")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    own = uv.join(cut.copies, ["mesh_id", "v"], "left").select("mesh_id", "v", F.coalesce("ref", "v").alias("orig"), "u", "w", F.explode(nine).alias("s"))
    nodes = own.select("mesh_id", (9 * F.col("v") + F.col("s.tile")).alias("node"), "s.tile", "v", "orig", (F.col("u") + F.col("s.tu")).alias("u"), (F.col("w") + F.col("s.tw")).alias("w"))
    edge = edges(halfedges(cut.mesh.faces)).select("mesh_id", "v0", "v1")
    for c in ("v0", "v1"):
        edge = edge.join(uv.select("mesh_id", F.col("v").alias(c), F.col("u").alias(f"u_{c}"), F.col("w").alias(f"w_{c}")), ["mesh_id", c])
    length = F.sqrt((F.col("u_v0") - F.col("u_v1")) ** 2 + (F.col("w_v0") - F.col("w_v1")) ** 2)
    inner = edge.select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("tile"), "v0", "v1", length.alias("length")).select("mesh_id", (9 * F.col("v0") + F.col("tile")).alias("a"), (9 * F.col("v1") + F.col("tile")).alias("b"), "length")
    on_seam = nodes.join(cut.copies.select("mesh_id", F.col("ref").alias("orig")).distinct(), ["mesh_id", "orig"], "left_semi").withColumn("pu", F.round("u", 9)).withColumn("pw", F.round("w", 9))
    place = ["mesh_id", "orig", "pu", "pw"]
    least = on_seam.groupBy(*place).agg(F.min("node").alias("a"))
    seam = on_seam.join(least, place).where("node <> a").select("mesh_id", "a", F.col("node").alias("b"), F.lit(0.0).alias("length"))
    return nodes, inner.unionByName(seam)


def _edges_within(nodes: DataFrame, edge: DataFrame, sources: DataFrame, within: float) -> DataFrame:
    """The cover's edges whose ends are no farther than ``within`` from each mesh's source (mesh_id, node) in the plane: no way is shorter than straight."""
    at = nodes.join(sources, ["mesh_id", "node"]).select("mesh_id", F.col("u").alias("u_source"), F.col("w").alias("w_source"))
    straight = F.sqrt((F.col("u") - F.col("u_source")) ** 2 + (F.col("w") - F.col("w_source")) ** 2)
    near = graph.cut(beside(nodes.select("mesh_id", "node", "u", "w"), at, ["mesh_id"]).where(straight <= within + 1e-6).select("mesh_id", "node"))
    for c in "ab":
        edge = edge.join(near.withColumnRenamed("node", c), ["mesh_id", c], "left_semi")
    return graph.cut(edge.select("mesh_id", "a", "b", "length"))


def _cover_order(nodes: DataFrame) -> DataFrame:
    """(mesh_id, v, at): tiles of a vertex and its copies stand together."""
    return graph.cut(nodes.select("mesh_id", F.col("node").alias("v"), (9 * F.col("orig") + F.col("tile")).alias("at")))


def cover_distances(nodes: DataFrame, edge: DataFrame, sources: DataFrame, within: float | None = None) -> DataFrame:
    """(mesh_id, node, distance) over the cover from each mesh's source (mesh_id, node), up to ``within``."""
    some = edge if within is None else _edges_within(nodes, edge, sources, within)
    return graph.distances(some, sources, within=within, order=_cover_order(nodes))


def cover_lengths(nodes: DataFrame, edge: DataFrame, ends: DataFrame, within: float | None = None) -> DataFrame:
    """(mesh_id, end, distance, length): of the ways of :func:`cover_paths`, their distance and the sum of their segments in the plane.

    All ways from a source share its tree, so their segments are added up along that by pointer doubling, and no way is written out.
    """
    sources = ends.select("mesh_id", F.col("source").alias("node")).distinct()
    far = graph.cut(cover_distances(nodes, edge, sources, within))
    some = edge if within is None else _edges_within(nodes, edge, sources, within)
    step = graph.shortest_tree(some, far).where("parent is not null").select("mesh_id", F.lit(0).alias("generator"), "node", "parent")
    for c in ("node", "parent"):
        step = step.join(nodes.select("mesh_id", F.col("node").alias(c), F.col("u").alias(f"u_{c}"), F.col("w").alias(f"w_{c}")), ["mesh_id", c])
    length = F.sqrt((F.col("u_node") - F.col("u_parent")) ** 2 + (F.col("w_node") - F.col("w_parent")) ** 2)
    sums = graph.sums_to_root(step.select("mesh_id", "generator", "node", "parent", length.alias("val"))).select("mesh_id", F.col("node").alias("end"), F.col("value").alias("length"))
    return ends.select("mesh_id", "end").join(far.withColumnRenamed("node", "end"), ["mesh_id", "end"]).join(sums, ["mesh_id", "end"], "left").select("mesh_id", "end", "distance", F.coalesce("length", F.lit(0.0)).alias("length"))


def cover_paths(nodes: DataFrame, edge: DataFrame, ends: DataFrame, within: float | None = None) -> DataFrame:
    """(mesh_id, end, seq, node, v, u, w): a shortest way from each mesh's source to each end, of the cover's nodes.

    ends: (mesh_id, source, end). Steps between copies at one place are left out, so consecutive rows differ in place.
    """
    sources = ends.select("mesh_id", F.col("source").alias("node")).distinct()
    far = graph.cut(cover_distances(nodes, edge, sources, within))
    tree = graph.cut(graph.shortest_tree(edge, far))
    way = graph.root_paths(tree, ends.select("mesh_id", F.col("end").alias("start"))).select("mesh_id", F.col("start").alias("end"), "node")
    way = way.unionByName(ends.select("mesh_id", "end", F.col("source").alias("node"))).distinct()
    rows = way.join(far, ["mesh_id", "node"]).join(nodes, ["mesh_id", "node"])
    # of the copies at one place the least stands for all
    rows = rows.groupBy("mesh_id", "end", F.col("orig").alias("v"), F.round("u", 9).alias("u"), F.round("w", 9).alias("w")).agg(F.min("distance").alias("distance"), F.min("node").alias("node"))
    seq = F.row_number().over(W.partitionBy("mesh_id", "end").orderBy("distance")) - 1
    return rows.select("mesh_id", "end", seq.cast("long").alias("seq"), "node", "v", "u", "w", "distance")


#: Ways between two places are sought among nodes whose two distances to them add up to this many times their own distance, at first.
STRETCH = 1.5


def snapped(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, mesh_id, node, u, w): the cover's node nearest to each point (point_id, mesh_id, u, w), of copies at one place the least."""
    many = nodes.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    near = locate.nearest_vertices(points, nodes.select("mesh_id", F.col("node").alias("v"), "u", "w"), max(1, int((many / 9) ** 0.5)))
    return near.select("point_id", "mesh_id", F.col("v").alias("node")).join(nodes.select("mesh_id", "node", "u", "w"), ["mesh_id", "node"])


def _around_pairs(nodes: DataFrame, pairs: DataFrame, cells: int) -> DataFrame:
    """(mesh_id, pair_id, node, orig, u, w): the nodes in each pair's ellipse, whose foci are its ends."""
    cell = lambda c: F.floor(c * cells)
    mid = {c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2 for c in "uw"}
    half = F.col("bound") / 2
    box = pairs.withColumn("i", F.explode(F.sequence(cell(mid["u"] - half), cell(mid["u"] + half)))).withColumn("j", F.explode(F.sequence(cell(mid["w"] - half), cell(mid["w"] + half))))
    own = nodes.select("mesh_id", "node", "orig", "u", "w", cell(F.col("u")).alias("i"), cell(F.col("w")).alias("j"))
    far = [F.sqrt((F.col("u") - F.col(f"u{k}")) ** 2 + (F.col("w") - F.col(f"w{k}")) ** 2) for k in (1, 2)]
    return box.join(own, ["mesh_id", "i", "j"]).where(far[0] + far[1] <= F.col("bound") + 1e-9).select("mesh_id", "pair_id", "node", "orig", "u", "w")


def _pair_ends(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mesh_id, pair_id, node1, u1, w1, node2, u2, w2): the nodes nearest to both places of pairs (pair_id, mesh_id, u1, w1, u2, w2)."""
    both = pairs.select("mesh_id", "pair_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("u1").alias("u"), F.col("w1").alias("w")), F.struct(F.lit(1).alias("k"), F.col("u2").alias("u"), F.col("w2").alias("w")))).alias("s"))
    asked = both.select(F.struct("pair_id", "s.k").alias("point_id"), "mesh_id", "s.u", "s.w")
    at = graph.cut(snapped(nodes, asked).select("mesh_id", "point_id.pair_id", "point_id.k", "node", "u", "w"))
    ends = [at.where(F.col("k") == k).select("mesh_id", "pair_id", F.col("node").alias(f"node{k + 1}"), F.col("u").alias(f"u{k + 1}"), F.col("w").alias(f"w{k + 1}")) for k in (0, 1)]
    return graph.cut(ends[0].join(ends[1], ["mesh_id", "pair_id"]))


def _pair_distances(nodes: DataFrame, edge: DataFrame, ends: DataFrame) -> DataFrame | None:
    """See graph.pair_distances: the three tiles beside each other along w make one strip, and strips follow each other along u."""
    wide = nodes.groupBy("mesh_id").agg((F.max("orig") + 1).alias("wide"))
    strip = F.floor(F.col("tile") / 3) * F.col("wide") + F.col("orig")
    order = graph.cut(beside(nodes.select("mesh_id", "node", "tile", "orig"), wide, ["mesh_id"]).select("mesh_id", F.col("node").alias("v"), (3 * strip + F.col("tile") % 3).cast("long").alias("at")))
    return graph.pair_distances(edge, ends.select("mesh_id", "pair_id", F.col("node1").alias("source"), F.col("node2").alias("target")), order=order)


def pair_lengths(nodes: DataFrame, edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, mesh_id, node1, node2, distance): ends and lengths of the ways of :func:`pair_paths`, which are not written out for that."""
    ends = _pair_ends(nodes, pairs)
    found = _pair_distances(nodes, edge, ends)
    if found is None:
        return pair_paths(nodes, edge, pairs).groupBy("pair_id", "mesh_id").agg(F.min_by("node", "seq").alias("node1"), F.max_by("node", "seq").alias("node2"), F.max("distance").alias("distance"))
    return ends.join(found, ["mesh_id", "pair_id"]).select("pair_id", "mesh_id", "node1", "node2", "distance")


def pair_paths(nodes: DataFrame, edge: DataFrame, pairs: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """(pair_id, mesh_id, seq, node, v, u, w, distance): a shortest way over the cover for each pair (pair_id, mesh_id, u1, w1, u2, w2).

    Both places go to their nearest nodes. A way no longer than a bound stays in the ellipse that the bound makes around its ends: so
    each pair is a small graph of its own, solved beside all others. The bound is the way's length, which is found for all pairs
    at once; where it is not (a cover that does not condense), a pair is settled if its way is no longer than its bound, and the
    others try again with twice the bound, until it holds the whole cover. Pairs without any way have no rows.
    """
    ends = _pair_ends(nodes, pairs)
    straight = F.sqrt((F.col("u1") - F.col("u2")) ** 2 + (F.col("w1") - F.col("w2")) ** 2)
    size = edge.agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    longest = size["longest"] or 0.0
    known = _pair_distances(nodes, edge, ends)
    if known is None:
        left = graph.cut(ends.withColumn("bound", stretch * straight + 2 * longest))
    else:
        left = graph.cut(ends.join(known, ["mesh_id", "pair_id"]).withColumn("bound", F.col("distance") * (1 + 1e-9) + 1e-9).drop("distance"))
    cells = max(1, int((size["n"] / 27) ** 0.5 / 4))
    found = None
    while True:
        here = graph.cut(_around_pairs(nodes, left, cells))
        own = F.struct("mesh_id", "pair_id").alias("mesh_id")  # a pair is a mesh to the graph's operators
        known = here.select(own, "node", "orig", "u", "w")
        rows = here.select("mesh_id", "pair_id", F.col("node").alias("a")).join(edge, ["mesh_id", "a"])
        rows = graph.cut(rows.join(here.select("mesh_id", "pair_id", F.col("node").alias("b")), ["mesh_id", "pair_id", "b"]).select(own, "a", "b", "length"))
        goal = left.select(own, F.col("node1").alias("source"), F.col("node2").alias("end"))
        way = graph.cut(cover_paths(known.withColumn("tile", F.lit(0)).withColumn("v", F.col("orig")), rows, goal))
        length = way.groupBy("mesh_id").agg(F.max("distance").alias("length"), F.max_by("node", "distance").alias("last"))
        reached = length.join(way.where("seq = 0").select("mesh_id"), "mesh_id").select("mesh_id.mesh_id", "mesh_id.pair_id", "length")
        settled = graph.cut(left.join(reached, ["mesh_id", "pair_id"]).where((F.col("length") <= F.col("bound") + 1e-12) & ((F.col("length") > 0) | (straight < 1e-12))).select("mesh_id", "pair_id"))
        done = way.select("mesh_id.mesh_id", "mesh_id.pair_id", "seq", "node", "v", "u", "w", "distance").join(settled, ["mesh_id", "pair_id"], "left_semi")
        found = done if found is None else found.unionByName(done)
        # the cover is three wide
        left = graph.cut(left.join(settled, ["mesh_id", "pair_id"], "left_anti").where("bound < 40").withColumn("bound", 2 * F.col("bound")))
        if not left.limit(1).count():
            return found.select("pair_id", "mesh_id", "seq", "node", "v", "u", "w", "distance")


def _same_places(nodes: DataFrame) -> DataFrame:
    """(mesh_id, node, place): the least of the cover's nodes at the place of each."""
    at = nodes.withColumn("pu", F.round("u", 9)).withColumn("pw", F.round("w", 9))
    key = ["mesh_id", "orig", "pu", "pw"]
    return at.join(at.groupBy(*key).agg(F.min("node").alias("place")), key).select("mesh_id", "node", "place")


def cover_faces(cut: Split, nodes: DataFrame) -> DataFrame:
    """(mesh_id, f, a, b, c): the faces of all nine tiles, f = 9 face + tile, with corners that seams share."""
    place = graph.cut(_same_places(nodes))
    rows = cut.mesh.faces.select("mesh_id", "f", *"abc", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("tile"))
    rows = rows.select("mesh_id", (9 * F.col("f") + F.col("tile")).alias("f"), *((9 * F.col(c) + F.col("tile")).alias(c) for c in "abc"))
    for c in "abc":
        rows = rows.join(place.select("mesh_id", F.col("node").alias(c), F.col("place").alias(f"at_{c}")), ["mesh_id", c]).drop(c).withColumnRenamed(f"at_{c}", c)
    return rows.select("mesh_id", "f", "a", "b", "c")


def _points_of_edge(number, lo: Column, hi: Column, low: Column, high: Column, m: int) -> Column:
    """An array of m points (id, x, y, z), evenly on the edge between the points ``low`` and ``high``."""
    return F.transform(F.sequence(F.lit(1), F.lit(m)), lambda k: F.struct(number(lo, hi, k).alias("id"), *((low[x] + (high[x] - low[x]) * k / (m + 1)).alias(x) for x in "xyz")))


def pulled_paths(faces: DataFrame, positions: DataFrame, ways: DataFrame, points: tuple[int, ...] = (3, 15)) -> DataFrame:
    """(pair_id, mesh_id, seq, x, y, z, distance): ways (pair_id, mesh_id, seq, node) over the cover, pulled tight across its faces.

    ``faces``: see :func:`cover_faces`; ``positions`` (mesh_id, node, x, y, z) in space. Around a way lies a corridor of faces. Each of
    its edges gets some points, any two points of a face are joined by a straight line, and the shortest way from end to end replaces
    the old one; its own corridor, with more points, is next (``points`` an edge, round by round). The cover is a plane without
    holes, so the way keeps its homotopy class; edges stay lines of the graph, so it gets no longer. Each pair is a graph of its own.
    """
    top = faces.agg(F.max(F.greatest("a", "b", "c")).alias("n")).first()["n"]
    if top is None:
        raise MeshError("Mesh has no faces.")
    wide = top + 1
    own = F.struct("mesh_id", "pair_id").alias("mesh_id")  # a pair is a mesh to the graph's operators
    ends = graph.cut(ways.groupBy("mesh_id", "pair_id").agg(F.min_by("node", "seq").alias("first"), F.max_by("node", "seq").alias("last")))
    corners = graph.cut(faces.select("mesh_id", "f", F.explode(F.array("a", "b", "c")).alias("node")))
    near = graph.cut(ways.select("mesh_id", "pair_id", "node").distinct().join(corners, ["mesh_id", "node"]).select("mesh_id", "pair_id", "f").distinct())
    out = None
    for m in points:
        # points of an edge by its ends and a number from 0, which is the lower end
        number = lambda lo, hi, k: (lo * wide + hi) * (m + 1) + k  # noqa: E731, B023
        on = near.join(faces, ["mesh_id", "f"])
        for c in "abc":
            on = on.join(positions.select("mesh_id", F.col("node").alias(c), F.struct("x", "y", "z").alias(f"p{c}")), ["mesh_id", c])
        sides = []
        for a, b in (("a", "b"), ("b", "c"), ("c", "a")):
            lo, hi = F.least(a, b), F.greatest(a, b)
            low, high = F.when(F.col(a) < F.col(b), F.col(f"p{a}")).otherwise(F.col(f"p{b}")), F.when(F.col(a) < F.col(b), F.col(f"p{b}")).otherwise(F.col(f"p{a}"))
            sides.append(_points_of_edge(number, lo, hi, low, high, m))
        tips = F.array(*(F.struct(number(F.col(c), F.col(c), F.lit(0)).alias("id"), *(F.col(f"p{c}")[x].alias(x) for x in "xyz")) for c in "abc"))
        at = graph.cut(on.select(own, "f", F.explode(F.concat(tips, *sides)).alias("s")).select("mesh_id", "f", "s.*"))
        other = at.select("mesh_id", "f", F.col("id").alias("b"), *(F.col(x).alias(f"{x}2") for x in "xyz"))
        gap = F.sqrt(sum(((F.col(x) - F.col(f"{x}2")) ** 2 for x in "yz"), (F.col("x") - F.col("x2")) ** 2))
        lines = graph.cut(at.withColumnRenamed("id", "a").join(other, ["mesh_id", "f"]).where("a < b").select("mesh_id", "a", "b", gap.alias("length")).distinct())
        goal = ends.select(own, number(F.col("first"), F.col("first"), F.lit(0)).alias("first"), number(F.col("last"), F.col("last"), F.lit(0)).alias("last"))
        far = graph.cut(graph.distances(lines, goal.select("mesh_id", F.col("first").alias("node"))))
        tree = graph.cut(graph.shortest_tree(lines, far))
        way = graph.root_paths(tree, goal.select("mesh_id", F.col("last").alias("start"))).select("mesh_id", "node").unionByName(goal.select("mesh_id", F.col("first").alias("node"))).distinct()
        place = at.select("mesh_id", F.col("id").alias("node"), "x", "y", "z").dropDuplicates(["mesh_id", "node"])
        out = graph.cut(way.join(far, ["mesh_id", "node"]).join(place, ["mesh_id", "node"]))
        near = graph.cut(at.select("mesh_id", "f", F.col("id").alias("node")).join(out.select("mesh_id", "node"), ["mesh_id", "node"]).select("mesh_id.mesh_id", "mesh_id.pair_id", "f").distinct())
    seq = F.row_number().over(W.partitionBy("mesh_id").orderBy("distance", "node")) - 1
    return out.select("mesh_id.pair_id", "mesh_id.mesh_id", seq.cast("long").alias("seq"), "x", "y", "z", "distance")
