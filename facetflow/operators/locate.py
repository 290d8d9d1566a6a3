"""Point location as joins: in a triangulated plane by cells of each triangle's size, on a sphere by cells of direction."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions import geometry as g
from facetflow.operators.topology import Mesh, edges, halfedges, paired
from facetflow.shared import materialize

PLANAR_TOLERANCE = 1e-12
SPHERE_TOLERANCE = 1e-8


#: Pairs of levels that a table's triangles are told apart by, at most; a point asks all that occur.
MOST_LEVELS = 12
#: The same for the three axes on a sphere.
SPHERE_LEVELS = 32
#: Levels of cells: their width is 2 ** -level.
COARSEST, FINEST = -40, 40


class Cells(NamedTuple):
    """Triangles by the cells they touch, and the levels that occur, as tuples of one level for each axis."""

    placed: DataFrame
    levels: list[tuple[int, ...]]


def _levels(extents: list[Column], finer: int = 0) -> list[Column]:
    """For each extent the finest level whose cells are as wide at least, or so many levels finer.

    Never null, and seen to be so: else Spark would ask whether it is, with the whole expression in each join below.
    """
    return [F.coalesce(F.greatest(F.lit(COARSEST), F.least(F.lit(FINEST), F.floor(-F.log2(F.greatest(x, F.lit(2.0**-60)))) + finer)).cast("int"), F.lit(0)) for x in extents]


def _coarser(found: list[tuple[int, ...]], most: int = MOST_LEVELS) -> int:
    """The least step so that at most ``most`` tuples of levels are left when each is rounded down to a multiple of it."""
    step = 1
    while len({tuple(x // step for x in t) for t in found}) > most:
        step += 1
    return step


def planar_cells(triangles: DataFrame) -> Cells:
    """Triangles (mesh_id, f, ua, ub, uc) with the cells (lu, lw, i, j) that their bounding boxes touch, nine at most.

    A triangle stands at a level of its own width and of its own height (a cell is half of it at least), so no large one falls into many small cells, and no
    small one shares its cell with many others than small ones. Levels are told apart as finely as MOST_LEVELS allows.
    """
    box = [(F.least(*(F.col(p)[c] for p in ("ua", "ub", "uc"))), F.greatest(*(F.col(p)[c] for p in ("ua", "ub", "uc")))) for c in "xy"]
    pad = 1e-9
    sized = triangles.select("mesh_id", "f", "ua", "ub", "uc", *(x.alias(n) for x, n in zip(_levels([hi - lo + 2 * pad for lo, hi in box], 1), ("lu", "lw"))), *((x + d).alias(n) for (lo, hi), axis in zip(box, "uw") for x, d, n in ((lo, -pad, f"{axis}0"), (hi, pad, f"{axis}1"))))
    found = [(r["lu"], r["lw"]) for r in sized.where("u0 is not null and w0 is not null and u1 is not null and w1 is not null").select("lu", "lw").distinct().collect()]  # 81 levels each at most
    step = _coarser(found)
    down = lambda c: F.coalesce((F.floor(F.col(c) / step) * step).cast("int"), F.lit(0))
    cell = lambda x, level: F.floor(F.col(x) * F.pow(F.lit(2.0), F.col(level)))
    rows = sized.withColumn("lu", down("lu")).withColumn("lw", down("lw"))
    rows = rows.select("mesh_id", "f", "ua", "ub", "uc", "lu", "lw", F.explode(F.sequence(cell("u0", "lu"), cell("u1", "lu"))).alias("i"), cell("w0", "lw").alias("j0"), cell("w1", "lw").alias("j1"))
    placed = rows.select("mesh_id", "f", "ua", "ub", "uc", "lu", "lw", "i", F.explode(F.sequence("j0", "j1")).alias("j"))
    return Cells(placed, sorted({(a // step * step, b // step * step) for a, b in found}))


def cells_of_points(points: DataFrame, levels: list[tuple[int, ...]]) -> DataFrame:
    """Points (point_id, mesh_id, u, w) with their cell (lu, lw, i, j) at each of the levels."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("lu"), F.lit(b).alias("lw"), F.lit(2.0**a).alias("ku"), F.lit(2.0**b).alias("kw")) for a, b in levels or [(0, 0)])))
    fine = points.where("abs(u) < 1e12 and abs(w) < 1e12").select("point_id", "mesh_id", "u", "w", each.alias("s"))
    return fine.select("point_id", "mesh_id", "u", "w", "s.lu", "s.lw", F.floor(F.col("u") * F.col("s.ku")).alias("i"), F.floor(F.col("w") * F.col("s.kw")).alias("j"))


def lowest_faces(pairs: DataFrame, same: Column | None = None) -> DataFrame:
    """Of points beside triangles (f, ua, ub, uc) the lowest face that holds each; pairs for which ``same`` is not true do not count."""
    weights = g.planar_barycentric("u", "w", F.col("ua"), F.col("ub"), F.col("uc"))
    hits = pairs.select("point_id", "mesh_id", "f", (weights if same is None else F.when(same, weights)).alias("l")).where(F.array_min("l") >= -PLANAR_TOLERANCE)
    hits = hits.select("point_id", "mesh_id", "f", *(F.get("l", F.lit(k)).alias(f"l{k}") for k in range(3)))
    return hits.groupBy("point_id", "mesh_id").agg(F.min(F.struct("f", "l0", "l1", "l2")).alias("s")).select("point_id", "mesh_id", "s.*")


def planar(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(point_id, mesh_id, f, l0, l1, l2) for points (point_id, mesh_id, u, w) in triangles (mesh_id, f, ua, ub, uc).

    A triangle goes to the cells of its own size that its bounding box touches, a point to its cell at each level that occurs; they
    meet in an equi-join and the exact weights decide. Of several faces (shared edges) the lowest counts. Points outside, and
    those with a coordinate that is null, no number or beyond 1e12, have no row.
    """
    cells = planar_cells(triangles)
    return lowest_faces(cells_of_points(points, cells.levels).join(cells.placed, ["mesh_id", "lu", "lw", "i", "j"]))


def sphere(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(point_id, mesh_id, f, l0, l1, l2) for directions (point_id, mesh_id, x, y, z) on meshes of triangles (pa, pb, pc).

    The ray from the centre hits the face whose least raw weight is greatest, the lowest face on ties; weights are clamped
    to 0 and add up to 1. A face goes to the cells of space, as wide as itself along each axis, that its directions touch, a point to its direction's
    cell at each level that occurs; only points that no face of their cells holds (within SPHERE_TOLERANCE) meet all faces of their
    mesh, which are dealt over tasks for that. One that no face looks towards has the face of the nearest centroid, with equal
    weights. Points of no length, or with a coordinate that is null or no number, have no row.
    """
    corners = ("pa", "pb", "pc")
    p = g.point("x", "y", "z")
    # a direction of length 1 is left as it is, so that a vertex's own is that vertex to the last digit
    aimed = points.select("point_id", "mesh_id", F.when(F.abs(g.norm(p) - 1) < 1e-12, p).otherwise(g.unit(p)).alias("p")).where((g.norm(p) > 1e-15) & (g.norm(p) < float("inf")))
    u = [g.unit(F.col(c)) for c in corners]
    normal = g.face_normal(*(F.col(f"u{c}") for c in corners))
    # a direction in the face differs from a point of the flat face on the unit sphere by 1 less the plane's distance at most
    sunk = 1 - F.coalesce(F.abs(F.try_divide(g.dot(normal, F.col("upa")), g.norm(normal))), F.lit(0.0))
    flat = triangles.select("mesh_id", "f", *corners, *(x[k].alias(f"u{c}{k}") for x, c in zip(u, corners) for k in "xyz"))
    box = flat.select("mesh_id", "f", *corners, *(g.point(*(f"u{c}{k}" for k in "xyz")).alias(f"u{c}") for c in corners), *(F.col(f"u{c}{k}") for c in corners for k in "xyz")).withColumn("pad", sunk + 1e-9)
    within = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    low, high = ([f(*(F.col(f"u{c}{k}") for c in corners)) for k in "xyz"] for f in (F.least, F.greatest))
    box = box.select("mesh_id", "f", *corners, *(within(x - F.col("pad")).alias(f"{k}0") for x, k in zip(low, "xyz")), *(within(x + F.col("pad")).alias(f"{k}1") for x, k in zip(high, "xyz")))
    extents = [F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"]
    sized = box.withColumns({"level": _levels([F.greatest(*extents)])[0]} | {f"own{k}": x for k, x in zip("xyz", _levels(extents))})
    # an axis along which a face is four times narrower, or sixteen, has finer cells
    thin = lambda k: (F.col("level") + F.floor((F.col(f"own{k}") - F.col("level")) / 2) * 2).cast("int")
    sized = sized.select("mesh_id", "f", *corners, *(f"{k}{n}" for k in "xyz" for n in "01"), *(thin(k).alias(f"l{k}") for k in "xyz"))
    found = [(r["lx"], r["ly"], r["lz"]) for r in sized.select("lx", "ly", "lz").distinct().collect()]  # what 81 levels of an axis leave
    step = _coarser(found, SPHERE_LEVELS)
    levels = sorted({tuple(x // step * step for x in t) for t in found})
    cell = lambda x, width: F.floor((x + 1) * width)
    placed = sized.withColumns({f"l{k}": F.coalesce((F.floor(F.col(f"l{k}") / step) * step).cast("int"), F.lit(0)) for k in "xyz"})
    for k, n in zip("xyz", "ijk"):
        width = F.pow(F.lit(2.0), F.col(f"l{k}"))
        placed = placed.withColumn(n, F.explode(F.sequence(cell(F.col(f"{k}0"), width), cell(F.col(f"{k}1"), width))))
    at = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"l{k}") for k, x in zip("xyz", t)), *(F.lit(2.0**x).alias(f"w{k}") for k, x in zip("xyz", t))) for t in levels or [(0, 0, 0)])))
    own = aimed.select("point_id", "mesh_id", "p", at.alias("s")).select("point_id", "mesh_id", "p", *(f"s.l{k}" for k in "xyz"), *(cell(F.col("p")[c], F.col(f"s.w{c}")).alias(name) for c, name in zip("xyz", "ijk")))
    boxed = F.lit(True)
    for k in "xyz":
        boxed = boxed & F.col("p")[k].between(F.col(f"{k}0"), F.col(f"{k}1"))

    def weighed(pairs: DataFrame) -> DataFrame:
        # numbers, not points, from step to step: Spark would write out a point's expression wherever it is used
        pa, pb, pc = (F.col(c) for c in corners)
        normal = g.face_normal(pa, pb, pc)
        rows = pairs.withColumns({f"n{c}": normal[c] for c in "xyz"})
        n = g.point("nx", "ny", "nz")
        rows = rows.withColumns({"ray": F.try_divide(g.dot(n, pa), g.dot(n, F.col("p")))}).where("ray > 0")
        # the weights of the hit are as the volumes between the ray and each side, which differences give without loss on small faces
        rows = rows.withColumns({f"d{n}{c}": F.col(n)[c] - F.col("p")[c] for n in corners for c in "xyz"})
        d = [g.point(*(f"d{n}{c}" for c in "xyz")) for n in corners]
        rows = rows.withColumns({f"s{k}": g.dot(F.col("p"), g.cross(d[(k + 1) % 3], d[(k + 2) % 3])) for k in range(3)})
        rows = rows.withColumns({f"r{k}": F.try_divide(F.col(f"s{k}"), F.col("s0") + F.col("s1") + F.col("s2")) for k in range(3)})
        return rows.select("point_id", "mesh_id", "f", "r0", "r1", "r2", F.round(F.least("r0", "r1", "r2"), 12).alias("least"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("point_id", "mesh_id").agg(F.min(F.struct((-F.col("least")).alias("m"), "f", "r0", "r1", "r2")).alias("s")).select("point_id", "mesh_id", "s.*")

    held = [F.greatest(F.col(f"r{k}"), F.lit(0.0)) for k in range(3)]
    weights = [(h / (held[0] + held[1] + held[2])).alias(f"l{k}") for k, h in enumerate(held)]
    # a filter of single weights would be pushed below them, and their expressions written out in it
    near = materialize(best(weighed(own.join(placed, ["mesh_id", "lx", "ly", "lz", "i", "j", "k"]).where(boxed))).where(F.col("m") <= SPHERE_TOLERANCE).drop("m"), "located")
    missed = aimed.join(near, ["point_id", "mesh_id"], "left_anti")
    if missed.isEmpty():
        return near.select("point_id", "mesh_id", "f", *weights)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missed = materialize(missed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "not-located")
    faces = triangles.select("mesh_id", "f", *corners, F.pmod(F.xxhash64("f"), F.lit(parts)).cast("int").alias("part"))
    all_of = missed.join(faces, ["mesh_id", "part"])
    wide = materialize(best(weighed(all_of)).drop("m"), "located-far")
    gap = g.length(F.col("p"), g.centroid(*(F.col(c) for c in corners)))
    third = F.lit(1.0 / 3)
    lost = all_of.join(wide.select("point_id", "mesh_id"), ["point_id", "mesh_id"], "left_anti")
    last = lost.groupBy("point_id", "mesh_id").agg(F.min_by("f", F.struct(F.round(gap, 12), "f")).alias("f")).select("point_id", "mesh_id", "f", *(third.alias(f"r{k}") for k in range(3)))
    return near.unionByName(wide).unionByName(last).select("point_id", "mesh_id", "f", *weights)


def surface_points(points: DataFrame, mesh: Mesh) -> DataFrame:
    """(point_id, mesh_id, kind, id, t): face points (point_id, mesh_id, f, l0, l1, l2) as a vertex v, an edge e at t, or a face f.

    t is the share of the way along the edge's first halfedge.
    """
    half = halfedges(mesh.faces)
    edge = edges(half)
    way = paired(half, edge).join(edge.select("mesh_id", "e", F.col("h").alias("first")), ["mesh_id", "e"]).select("mesh_id", "f", "k", "tail", "e", (F.col("h") == F.col("first")).alias("forward"))
    made = points.select("point_id", "mesh_id", "f", g.surface_point("l0", "l1", "l2").alias("s")).select("point_id", "mesh_id", "f", "s.*")
    on = made.join(way, ["mesh_id", "f", "k"], "left")
    ident = F.when(F.col("kind") == "vertex", F.col("tail")).when(F.col("kind") == "edge", F.col("e")).otherwise(F.col("f"))
    return on.select("point_id", "mesh_id", "kind", ident.alias("id"), F.when(F.col("forward"), F.col("t")).otherwise(1 - F.col("t")).alias("t"))


def straight(pairs: DataFrame, mesh: Mesh) -> DataFrame:
    """Pairs (pair_id, mesh_id, f1, a0, a1, a2, f2, b0, b1, b2) whose shortest way is one segment without any search, as (pair_id, mesh_id, reason).

    face: both in one face. edge: both on one edge. beside: one inside a face and the other on an edge of it.
    """
    ends = {}
    for n, f, c in ((1, "f1", "a"), (2, "f2", "b")):
        rows = pairs.select(F.col("pair_id").alias("point_id"), "mesh_id", F.col(f).alias("f"), *(F.col(f"{c}{k}").alias(f"l{k}") for k in range(3)))
        ends[n] = surface_points(rows, mesh).select(F.col("point_id").alias("pair_id"), "mesh_id", F.col("kind").alias(f"kind{n}"), F.col("id").alias(f"id{n}"))
    half = halfedges(mesh.faces)
    sides = paired(half, edges(half)).groupBy("mesh_id", "e").agg(F.collect_set("f").alias("beside"))  # the two faces of an edge
    both = pairs.select("pair_id", "mesh_id", "f1", "f2").join(ends[1], ["pair_id", "mesh_id"]).join(ends[2], ["pair_id", "mesh_id"])
    e = F.when((F.col("kind1") == "edge") & (F.col("kind2") == "face"), F.col("id1")).when((F.col("kind2") == "edge") & (F.col("kind1") == "face"), F.col("id2"))
    other = F.when(F.col("kind1") == "face", F.col("id1")).otherwise(F.col("id2"))
    both = both.withColumn("e", e).withColumn("other", other).join(sides, ["mesh_id", "e"], "left")
    reason = F.when(F.col("f1") == F.col("f2"), "face").when((F.col("kind1") == "edge") & (F.col("kind2") == "edge") & (F.col("id1") == F.col("id2")), "edge").when(F.array_contains("beside", F.col("other")), "beside")
    return both.select("pair_id", "mesh_id", reason.alias("reason")).where("reason is not null")


def path_face_points(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(path_id, seq, f, l0, l1, l2): points (path_id, seq, mesh_id, f, x, y, z) of paths with their weights in their face (pa, pb, pc)."""
    rows = points.join(triangles.select("mesh_id", "f", "pa", "pb", "pc"), ["mesh_id", "f"])
    return rows.select("path_id", "seq", "f", *(x.alias(f"l{k}") for k, x in enumerate(g.barycentric(g.point("x", "y", "z"), F.col("pa"), F.col("pb"), F.col("pc")))))


def to_points(located: DataFrame, triangles: DataFrame) -> DataFrame:
    """(point_id, mesh_id, x, y, z): face points (f, l0, l1, l2) on triangles (pa, pb, pc)."""
    p = g.blend([F.col(f"l{k}") for k in range(3)], [F.col(c) for c in ("pa", "pb", "pc")])
    return located.join(triangles, ["mesh_id", "f"]).select("point_id", "mesh_id", p.alias("p")).select("point_id", "mesh_id", "p.x", "p.y", "p.z")


#: Vertices of a cell that a point meets in one list.
NEAR = 256


def nearest_vertices(points: DataFrame, vertices: DataFrame, cells: int) -> DataFrame:
    """(point_id, mesh_id, v, distance): the nearest of vertices (mesh_id, v, u, w), the lowest on ties.

    A vertex goes to its cell and the eight around it, a point meets the lists of its cell's (NEAR in one); what is nearer than a cell's width is
    settled. Others try again with cells twice as wide, those that are still left with much wider ones, until a cell holds all that there is: so every point of a mesh that has a
    vertex gets a row. Points and vertices with a coordinate that is null, no number or infinite take no part.
    """
    fine = "u is not null and w is not null and not isnan(u) and not isnan(w) and abs(u) < double('infinity') and abs(w) < double('infinity')"
    points, vertices = points.where(fine), vertices.where(fine)
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    gap = lambda x: F.struct(((F.col("u") - x["vu"]) ** 2 + (F.col("w") - x["vw"]) ** 2).alias("d"), x["v"].alias("v"))
    even = lambda x: F.struct(F.round(x["d"], 12).alias("d"), x["v"].alias("v"))
    # only what may be the least when rounded is rounded, which takes far longer than the rest
    nearest = lambda m: F.array_min(F.transform(F.filter("gaps", lambda x: x["d"] <= m["d"] + 2e-12), even))
    left = points.join(vertices.select("mesh_id").distinct(), "mesh_id", "left_semi").select("point_id", "mesh_id", "u", "w")
    out, n, least, rounds = None, float(cells), None, 0
    while True:
        cell = lambda c, n=n: F.floor(F.col(c) * n)
        near = vertices.select("mesh_id", "v", F.col("u").alias("vu"), F.col("w").alias("vw"), cell("u").alias("i"), cell("w").alias("j"), F.explode(steps).alias("s")).select("mesh_id", "v", "vu", "vw", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
        most = near.groupBy("mesh_id", "i", "j").count().agg(F.max("count")).first()[0] or 0
        lists = near.groupBy("mesh_id", "i", "j", F.pmod(F.xxhash64("v"), F.lit(-(-most // NEAR) or 1)).alias("part")).agg(F.collect_list(F.struct("v", "vu", "vw")).alias("near"))
        asked = left.select("point_id", "mesh_id", "u", "w", cell("u").alias("i"), cell("w").alias("j"))
        # a point meets lists, not vertices; those that meet none stand in the table too
        met = asked.join(lists, ["mesh_id", "i", "j"], "left").select("point_id", "mesh_id", F.transform("near", gap).alias("gaps"))
        met = met.select("point_id", "mesh_id", F.get(F.transform(F.array(F.array_min("gaps")), nearest), F.lit(0)).alias("s"))
        best = materialize(met.groupBy("point_id", "mesh_id").agg(F.min("s").alias("s")), "nearest")
        last = least is not None and n <= least  # all are within a cell of each other
        settles = F.col("s").isNotNull() if last else F.coalesce(F.col("s.d") <= 1.0 / n**2, F.lit(False))
        settled = best.where(settles).select("point_id", "mesh_id", "s.v", F.sqrt("s.d").alias("distance"))
        out = settled if out is None else out.unionByName(settled)
        more = best.where(~settles).select("point_id", "mesh_id")
        if last or more.isEmpty():
            return out
        left = materialize(left.join(more, ["point_id", "mesh_id"], "left_semi"), "not-settled")
        if least is None:
            far = F.max(F.greatest(F.abs("u"), F.abs("w")))
            least = 0.5 / max(1e-300, 2 * max(x.agg(far).first()[0] or 0.0 for x in (left, vertices)))
        rounds += 1
        n = n / (2 if rounds < 4 else 16) if n > 1e-9 else least  # beyond that the rest is taken at once


def tiles(vertices: DataFrame) -> DataFrame:
    """(mesh_id, tile, tu, tw, v, u, w): nine translated copies of the unit square, tu outer and tw inner."""
    nine = F.array(*(F.struct(F.lit(3 * (a + 1) + b + 1).alias("tile"), F.lit(a).alias("tu"), F.lit(b).alias("tw")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return vertices.select("mesh_id", "v", "u", "w", F.explode(nine).alias("s")).select("mesh_id", "s.tile", "s.tu", "s.tw", "v", (F.col("u") + F.col("s.tu")).alias("u"), (F.col("w") + F.col("s.tw")).alias("w"))
