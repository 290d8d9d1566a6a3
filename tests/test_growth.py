"""Steps whose jobs or rows once grew faster than their input."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from facetflow.operators import condense, embedding, graph, locate, surgery
from facetflow.operators.topology import Mesh
from facetflow.sources import obj, tables


def tube(n, wide=6):
    """Vertices and faces of a closed torus of n rings."""
    at = lambda i, j: i % n * wide + j % wide
    faces = [f for i in range(n) for j in range(wide) for f in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    return [(0, v, float(v), 0.0, 0.0) for v in range(n * wide)], [(0, f, *abc) for f, abc in enumerate(faces)]


def test_fans_are_found_vertex_by_vertex(spark, monkeypatch):
    vertices, faces = tube(9)
    mesh = Mesh(spark.createDataFrame(vertices, "mesh_id long, v long, x double, y double, z double"), spark.createDataFrame(faces, "mesh_id long, f long, a long, b long, c long"))
    monkeypatch.setattr(graph, "components", None)  # no search over all corners at once
    monkeypatch.setattr(surgery, "VERTICES", 7)
    cut = surgery.split(mesh, spark.createDataFrame([(0, j, (j + 1) % 6) if j < 5 else (0, 0, 5) for j in range(6)], "mesh_id long, lo long, hi long"))
    assert sorted((r.ref, r.v) for r in cut.copies.collect()) == sorted((j, v) for v, j in zip(range(54, 60), [r.ref for r in cut.copies.orderBy("v").collect()]))
    assert sorted(r.ref for r in cut.copies.collect()) == list(range(6)) and cut.mesh.faces.count() == 108
    assert surgery.split(mesh).copies.count() == 0


def test_places_on_a_ring_take_no_more_tables_the_longer_it_is(spark, monkeypatch):
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda *a: written.append(1) or plain(*a))
    tables = []
    for n in (12, 3000):
        order = list(range(n))
        random.Random(3).shuffle(order)
        order = order[order.index(0) :] + order[: order.index(0)]
        half = spark.createDataFrame([(0, h, h, a, b) for h, (a, b) in enumerate(zip(order, order[1:] + order[:1]))], "mesh_id long, h long, f long, tail long, head long")
        written.clear()
        got = {r.v: (r.ring, r.n, r.pos) for r in embedding.boundary_rings(half).collect()}
        assert got == {v: (0, n, k) for k, v in enumerate(order)}
        tables.append(len(written))
    assert tables[0] == tables[1]


def from_one(edges, source):
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    found, heap = {}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in found:
            found[v] = d
            for x, w in near[v]:
                heapq.heappush(heap, (d + w, x))
    return found


@pytest.mark.parametrize("whole", [2400, 0])
def test_many_pairs_share_one_condensed_graph(spark, monkeypatch, whole):
    """Against a heap from each source; no pair has a part of the graph of its own, and each level's tasks take a few pairs at a time."""
    rng = random.Random(5)
    _, faces = tube(60)
    edges = {tuple(sorted(e)) for _, _, a, b, c in faces for e in ((a, b), (b, c), (c, a))} | {(400, 401), (401, 402)}
    edges = [(a, b, rng.choice([0.0, rng.uniform(0.5, 2)])) for a, b in sorted(edges)]
    pairs = [(0, k, rng.randrange(360), rng.randrange(360)) for k in range(60)] + [(0, 60, 7, 7), (0, 61, 3, 401), (0, 62, 400, 402)]
    tables = spark.createDataFrame([(0, *e) for e in edges], "mesh_id long, a long, b long, length double"), spark.createDataFrame(pairs, "mesh_id long, pair_id long, source long, target long")
    monkeypatch.setattr(graph, "PAIRS", 9)
    monkeypatch.setattr(graph, "WHOLE", whole)
    got = {r.pair_id: r.distance for r in graph.pair_distances(*tables, block=40, dense=80).collect()}
    want = {k: from_one(edges, s).get(t) for _, k, s, t in pairs}
    assert got.keys() == {k for k, d in want.items() if d is not None} and 61 not in got
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_a_level_is_one_table(spark, monkeypatch):
    """An edge carries the blocks of its ends, so a level of condensing writes what it found and nothing else."""
    _, faces = tube(80)
    edges = sorted({(0, *sorted(e)) for _, _, a, b, c in faces for e in ((a, b), (b, c), (c, a))})
    written, plain = [], condense.materialize
    monkeypatch.setattr(condense, "materialize", lambda df, name="table": written.append(name) or plain(df, name))
    got = {r.node: r.level for r in graph.bfs_levels(spark.createDataFrame(edges, "mesh_id long, a long, b long"), spark.createDataFrame([(0, 0)], "mesh_id long, node long"), block=30, dense=60).collect()}
    want = from_one([(a, b, 1.0) for _, a, b in edges], 0)
    assert got == {v: int(d) for v, d in want.items()}
    assert written.count("condensed") > 1 and len(written) == 4 + 2 * written.count("condensed")


def test_a_point_meets_lists_of_vertices(spark, monkeypatch):
    """The pairs of a point and a vertex are no rows, and what has been found is not found again to see whether all have it."""
    rng = random.Random(7)
    vertices = [(0, v, rng.choice([rng.random(), rng.random() * 1e-3]), rng.random()) for v in range(300)]
    points = [(k, 0, rng.random() * 3, rng.random()) for k in range(200)]
    both = spark.createDataFrame(points, "point_id long, mesh_id long, u double, w double"), spark.createDataFrame(vertices, "mesh_id long, v long, u double, w double")
    rows, plain = [], locate.materialize

    def kept(df, name="table"):
        out = plain(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(locate, "materialize", kept)
    monkeypatch.setattr(locate, "NEAR", 9)
    got = {r.point_id: (r.v, r.distance) for r in locate.nearest_vertices(*both, 8).collect()}
    for k, _, u, w in points:
        d, v = min((round((u - x) ** 2 + (w - y) ** 2, 12), v) for _, v, x, y in vertices)
        assert got[k][0] == v and abs(got[k][1] - d**0.5) < 1e-9
    assert rows[0] == ("nearest", 200) and len(rows) > 2


def test_a_number_is_formatted_once(spark):
    plan = spark.range(1).select(obj.stream_number(F.col("id") / 3).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1


def test_words_are_written_once_and_a_small_file_is_dealt(spark, sf, monkeypatch):
    written, plain = [], obj.materialize
    monkeypatch.setattr(obj, "materialize", lambda df, name="table": written.append(name) or plain(df, name))
    mesh = tables.part_torus(spark, sf)
    assert mesh.faces.rdd.getNumPartitions() == mesh.vertices.rdd.getNumPartitions() == 8  # the file is one split
    lines = obj.obj_lines(mesh).select("mesh_id", (F.col("part") * F.lit(1 << 40) + F.col("n")).alias("line"), "value")
    back = obj.parse(lines)
    assert written == ["words"]
    key = lambda df: sorted(map(tuple, df.select("f", "a", "b", "c").collect()))
    assert key(back.faces) == key(mesh.faces) and back.vertices.count() == mesh.vertices.count()


def test_blocks_are_dealt_over_all_tasks(spark, monkeypatch):
    """Blocks hold few bytes and take long: Spark would merge their partitions into one."""
    _, faces = tube(80)
    edges = sorted({(0, *sorted(e)) for _, _, a, b, c in faces for e in ((a, b), (b, c), (c, a))})
    tasks, plain = [], condense.materialize
    monkeypatch.setattr(condense, "materialize", lambda df, name="table": (name == "condensed" and tasks.append(df.rdd.getNumPartitions())) or plain(df, name))
    assert graph.bfs_levels(spark.createDataFrame(edges, "mesh_id long, a long, b long"), spark.createDataFrame([(0, 0)], "mesh_id long, node long"), block=30, dense=60).count() == 480
    assert len(tasks) > 1 and set(tasks) == {8}


def test_far_nodes_have_a_parent(spark):
    """Distances of some 10^5 are rounded by more than 1e-12: F2, short_pair_cut's ways broke off."""
    rng, n = random.Random(1), 1500
    rows = [(0, 2 * i + k, 2 * i + 2 + k, x) for k in (0, 1) for i in range(n) for x in [rng.uniform(100, 1000)]] + [(0, 2 * i, 2 * i + 1, x) for i in range(n + 1) for x in [rng.uniform(100, 1000)]]
    edge = graph.cut(spark.createDataFrame(rows, "mesh_id long, a long, b long, length double"))
    far = graph.cut(graph.distances(edge, spark.createDataFrame([(0, 0)], "mesh_id long, node long"), block=200))
    tree = graph.cut(graph.shortest_tree(edge, far))
    assert far.count() == 2 * n + 2 and [r.node for r in tree.where("parent is null").collect()] == [0]
