"""Labelled subdivisions, and short loops against Dijkstra's algorithm in plain Python."""

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.operators import graph, homology, loops, measures, surgery, topology
from facetflow.operators import torus as torus_of
from facetflow.plans import surfaces
from facetflow.shared import materialize
from facetflow.sources import obj, tables


@pytest.fixture(scope="module")
def torus(spark, sf):
    return tables.part_torus(spark, sf)


@pytest.fixture(scope="module")
def trees(torus):
    return homology.tree_cotree(torus)


def _far(near, source):
    far, queue = {}, [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in far:
            far[v] = d
            for w, l in near[v]:
                heapq.heappush(queue, (d + l, w))
    return far


def test_shortest_loops(torus, trees):
    got = defaultdict(list)
    for r in loops.shortest_loops(torus, trees).collect():
        got[r.generator].append(r)
    along = homology.loops(trees).join(trees.edges, ["mesh_id", "e"]).select("mesh_id", "lo", "hi").distinct()
    cut = surgery.split(torus, materialize(along))
    ref = {r.v: r.ref for r in cut.copies.collect()}
    place = {r.v: np.array([r.x, r.y, r.z]) for r in cut.mesh.vertices.collect()}
    faces = {r.f: (r.a, r.b, r.c) for r in cut.mesh.faces.collect()}
    near = defaultdict(set)
    for a, b, c in faces.values():
        for v, w in ((a, b), (b, c), (c, a)):
            length = float(np.linalg.norm(place[v] - place[w]))
            near[v].add((w, length))
            near[w].add((v, length))
    rest = trees.rest.collect()
    assert len(rest) == len(got) == 2
    for e in rest:
        on = lambda f, v: next(x for x in faces[f] if ref.get(x, x) == v)
        want = min(_far(near, on(e.left, v))[on(e.right, v)] for v in (e.lo, e.hi))
        assert abs(sum(r.length for r in got[e.generator]) - want) < 1e-9
        sums = defaultdict(int)
        for r in got[e.generator]:
            sums[r.hi] += r.val
            sums[r.lo] -= r.val
        assert not any(sums.values())


def test_labels_of_a_pair_cut_to_a_disk(torus, trees):
    loop, crossed = (materialize(x) for x in loops.crossing_pair(trees))
    assert loop.join(crossed, ["mesh_id", "lo", "hi"]).count() == 1
    mesh, labels = loops.subdivide_labelled(torus, loop, crossed)
    assert labels.where("generator = 1").count() == 2 * loop.count() and labels.where("generator = 2").count() == 2 * crossed.count()
    ends = topology.edges(topology.halfedges(mesh.faces)).select("mesh_id", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    assert labels.join(ends, ["mesh_id", "lo", "hi"], "left_anti").count() == 0
    assert topology.summary(surgery.split(mesh, labels).mesh).first().euler == 1


def test_labels_without_a_root(torus, trees):
    loop, crossed = (materialize(x) for x in loops.crossing_pair(trees))
    with pytest.raises(topology.MeshError, match="one vertex"):
        loops.subdivide_labelled(torus, loop, crossed.limit(0))
    with pytest.raises(topology.MeshError, match="one vertex"):
        loops.subdivide_labelled(torus, loop.limit(1), crossed)


def test_a_short_pair_meets_once(torus, trees):
    loop, crossed = loops.short_pair(torus, trees)
    assert loop.join(crossed, ["mesh_id", "lo", "hi"]).count() == 1
    length = loops.shortest_loops(torus, trees).groupBy("generator").agg(F.sum("length").alias("length"), F.count("length").alias("n")).orderBy("length").first()
    assert loop.count() == length.n
    # the path's faces are passed once each, and follow each other
    sides = crossed.join(trees.edges, ["mesh_id", "lo", "hi"]).select(F.explode(F.array("left", "right")).alias("f")).groupBy("f").count()
    assert sides.where("count <> 2").count() == 0
    mesh, labels = loops.subdivide_labelled(torus, loop, crossed)
    assert topology.summary(surgery.split(mesh, labels).mesh).first().euler == 1


def test_loop_vertices(spark):
    rows = spark.createDataFrame([(0, 1, 3, 9), (0, 1, 3, 5), (0, 1, 5, 9), (0, 2, 1, 2), (0, 2, 1, 2)], "mesh_id long, generator int, lo long, hi long")
    assert {r.generator: r.vertices for r in loops.loop_vertices(rows).collect()} == {1: [3, 5, 9], 2: [1, 2]}


def test_harmonic_coordinates_of_copies_differ_by_whole_numbers(spark, torus):
    made = torus_of.harmonic_coordinates(torus)
    uv = {r.v: np.array([r.u, r.w]) for r in made.uv.collect()}
    assert len(uv) == made.cut.mesh.vertices.count()
    steps = [uv[r.v] - uv[r.ref] for r in made.cut.copies.collect()]
    assert steps and max(abs(d - d.round()).max() for d in steps) < 1e-6 and all(abs(d).max() > 0.5 for d in steps)
    # each inner vertex is the mean of its neighbours, as its steps add up to nothing
    half = topology.halfedges(made.cut.mesh.faces)
    rim = {r.tail for r in topology.boundary(half).collect()}
    sums = defaultdict(list)
    for r in half.collect():
        sums[r.tail].append(uv[r.head] - uv[r.tail])
    assert max(abs(np.sum(d, axis=0)).max() for v, d in sums.items() if v not in rim) < 1e-8
    with pytest.raises(topology.MeshError, match="genus 1"):
        torus_of.harmonic_coordinates(tables.icosahedron_mesh(spark))


def test_edges_that_cannot_be_cut(spark, torus):
    """Diagonals of the quadrangles are in no loop; after a repair all edges can be cut."""
    diagonal = topology.edges(topology.halfedges(torus.faces)).join(torus.faces.where("f % 2 = 0").select("mesh_id", F.least("a", "c").alias("x"), F.greatest("a", "c").alias("y")), "mesh_id").where("least(v0, v1) = x and greatest(v0, v1) = y").select("mesh_id", F.col("x").alias("lo"), F.col("y").alias("hi"))
    diagonal = materialize(diagonal)
    of = homology.tree_cotree(torus, diagonal)
    assert of.rest.count() == 2 and of.rest.join(diagonal, ["mesh_id", "lo", "hi"], "left_semi").count() == 0
    for tree in (homology.loops(of), of.vertices):
        assert tree.join(of.edges, ["mesh_id", "e"]).join(diagonal, ["mesh_id", "lo", "hi"], "left_semi").count() == 0
    assert of.faces.join(of.edges, ["mesh_id", "e"]).join(diagonal, ["mesh_id", "lo", "hi"], "left_semi").count() == diagonal.count()
    used = of.vertices.where("parent is not null").count() + of.faces.where("parent is not null").count()
    assert used == of.vertices.count() - 1 + of.faces.count() - 1
    mesh, kept = surgery.repaired_cuttable(torus, diagonal)
    assert kept.count() == diagonal.count() and mesh.faces.count() == torus.faces.count()
    more = topology.Mesh(torus.vertices.unionByName(spark.createDataFrame([(0, 10**6, 0.0, 0.0, 0.0)], "mesh_id long, v long, x double, y double, z double")), torus.faces)
    assert surgery.repaired_cuttable(more, diagonal)[1].count() == 0


def test_predicates(spark):
    v = spark.createDataFrame([(0, i, float(i), float(i * i), 0.0) for i in range(8)], "mesh_id long, v long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3), (0, 2, 0, 3, 1), (0, 3, 4, 5, 6)], "mesh_id long, f long, a long, b long, c long")
    kinds = {r.v: (r.isolated, r.on_boundary, r.inside_hole) for r in topology.vertex_kinds(topology.Mesh(v, faces)).collect()}
    assert kinds[0] == (False, False, False) and kinds[1] == (False, True, False) and kinds[4] == (False, True, True) and kinds[7] == (True, False, False)
    real = topology.real_faces(topology.Mesh(v, faces), spark.createDataFrame([(0, 2)], "mesh_id long, pole long"))
    assert {r.f: r.real for r in real.collect()} == {0: False, 1: False, 2: True, 3: True}
    assert topology.real_faces(topology.Mesh(v, faces)).where("not real").count() == 0
    beside = {(r.f, r.other) for r in topology.shared_edges(faces).collect()}
    assert beside == {(a, b) for a in range(3) for b in range(3) if a != b}
    cones = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3), (0, 2, 0, 3, 1), (0, 3, 0, 4, 5), (0, 4, 0, 5, 6), (0, 5, 0, 6, 4)], "mesh_id long, f long, a long, b long, c long")
    two = topology.Mesh(v.where("v < 7"), cones)
    topology.check(two, require_closed=False)
    with pytest.raises(topology.MeshError, match="non-manifold vertices"):
        topology.check(two, require_closed=False, components=graph.components)


def test_text_of_places_and_positions(spark):
    mesh = topology.Mesh(spark.createDataFrame([(0, i, float(i), 0.5, 2.0) for i in range(3)], "mesh_id long, v long, x double, y double, z double"), spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, f long, a long, b long, c long"))
    uv = spark.createDataFrame([(0, i, i / 4, 1.0) for i in range(4)], "mesh_id long, v long, u double, w double")
    places = spark.createDataFrame([(0, 0, 3, 1, 2)], "mesh_id long, f long, a long, b long, c long")
    text = [r.value for r in obj.both_lines(mesh, uv, places).orderBy("part", "n").collect()]
    assert text[0] == "v 0.000000 0.500000 2.000000" and text[3] == "vt 0.000000 1.000000" and text[-1] == "f 1/4 2/2 3/3" and len(text) == 8
    flat = [r.value for r in obj.both_lines(mesh, uv, places, only_uv=True).orderBy("part", "n").collect()]
    assert flat[1] == "v 0.250000 1.000000 0.0" and flat[-1] == "f 4 2 3" and len(flat) == 5


def test_ways_between_places(spark, sf):
    """On the even grid each way is as long as its steps along and across, whichever tiles it passes; a pair of one node has one row."""
    cut = surfaces._cut(spark, sf)
    nodes, edge = (materialize(x) for x in torus_of.cover(cut, surfaces._disk_uv(spark, sf, cut)))
    rows = [(1, 0, 0.02, 0.01, 0.32, 0.16), (2, 0, 0.92, 0.01, 1.18, -0.12), (3, 0, 0.5, 0.5, 0.51, 0.49), (4, 0, -0.4, 0.2, -0.4, 0.45)]
    pairs = spark.createDataFrame(rows, "pair_id long, mesh_id long, u1 double, w1 double, u2 double, w2 double")
    got = defaultdict(list)
    for r in torus_of.pair_paths(nodes, edge, pairs).orderBy("pair_id", "seq").collect():
        got[r.pair_id].append(r)
    for k, _, u1, w1, u2, w2 in rows:
        p, q = round(u2 * 10) - round(u1 * 10), round(w2 * 20) - round(w1 * 20)
        slope = (0.1**2 + 0.05**2) ** 0.5
        want = min(abs(p), abs(q)) * slope + max(abs(p) - abs(q), 0) * 0.1 + max(abs(q) - abs(p), 0) * 0.05 if p * q >= 0 else abs(p) * 0.1 + abs(q) * 0.05
        way = got[k]
        assert abs(way[-1].distance - want) < 1e-9 and [r.seq for r in way] == list(range(len(way)))
        assert abs(sum(np.hypot(a.u - b.u, a.w - b.w) for a, b in zip(way, way[1:])) - want) < 1e-9
    assert len(got[3]) == 1 and len(got) == 4
    # pulled tight: in the flat cover hardly longer than a straight line, on the surface no longer than along edges
    ways = materialize(torus_of.pair_paths(nodes, edge, pairs.where("pair_id < 3")))
    faces = materialize(torus_of.cover_faces(cut, nodes))
    flat = materialize(nodes.select("mesh_id", "node", F.col("u").alias("x"), F.col("w").alias("y"), F.lit(0.0).alias("z")))
    length = {r.pair_id: r.d for r in torus_of.pulled_paths(faces, flat, ways).groupBy("pair_id").agg(F.max("distance").alias("d")).collect()}
    for k in (1, 2):
        straight = float(np.hypot(got[k][-1].u - got[k][0].u, got[k][-1].w - got[k][0].w))
        assert straight - 1e-9 <= length[k] <= 1.002 * straight and length[k] <= got[k][-1].distance + 1e-9
    assert length[2] < got[2][-1].distance - 0.05
    at = nodes.select("mesh_id", "node", F.col("orig").alias("v")).join(tables.part_torus(spark, sf).vertices, ["mesh_id", "v"])
    along = measures.path_lengths(ways.join(at.select("mesh_id", "node", *"xyz"), ["mesh_id", "node"]).select(F.col("pair_id").alias("path_id"), "seq", *"xyz"))
    tight = torus_of.pulled_paths(faces, materialize(at.select("mesh_id", "node", *"xyz")), ways)
    pulled = {r.pair_id: r.d for r in tight.groupBy("pair_id").agg(F.max("distance").alias("d")).collect()}
    assert all(pulled[r.path_id] <= r.length + 1e-9 for r in along.collect()) and len(pulled) == 2
    drawn = measures.path_lengths(tight.select(F.col("pair_id").alias("path_id"), "seq", *"xyz"))
    assert all(abs(pulled[r.path_id] - r.length) < 1e-9 for r in drawn.collect())


def test_harmonic_forms_of_a_mesh_of_many_blocks(torus, trees, monkeypatch):
    """Larger than one block, whatever the block's size."""
    from functools import partial

    from facetflow.operators import solve

    monkeypatch.setattr(solve, "dirichlet", partial(solve.dirichlet, block=60, dense=120))
    form = materialize(homology.harmonic_forms(trees))
    for incidence in measures.incidence(torus):
        rows = form.join(incidence.select("mesh_id", "row", F.col("col").alias("e"), F.col("val").alias("sign")), ["mesh_id", "e"])
        sums = rows.groupBy("generator", "row").agg(F.sum(F.col("val") * F.col("sign")).alias("sum"))
        assert sums.agg(F.max(F.abs("sum"))).first()[0] < 1e-9
