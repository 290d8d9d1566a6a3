"""Condensed graphs: systems against dense solves, distances against a heap, components against union-find; small blocks, so that there are levels."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.operators import condense, graph, solve

FIXED = "mesh_id {}, system int, v long, value double"


def lattice(n, rng, first=0):
    """Edges (a, b, weight) of an n by n lattice with diagonals, and the places of its vertices."""
    at = lambda i, j: first + i * n + j
    edges = [(at(i, j), at(i + a, j + b)) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0), (1, 1)) if i + a < n and j + b < n]
    return [(a, b, float(rng.uniform(0.5, 2))) for a, b in edges], [(at(i, j), float(i), float(j), 0.0) for i in range(n) for j in range(n)]


def scattered(n, m, rng):
    return [(int(a), int(b), float(rng.uniform(0.5, 2))) for a, b in {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)} | {(i, i + 1) for i in range(n - 1)}]


def dense_solution(edges, fixed, load):
    n = max(max(a, b) for a, b, _ in edges) + 1
    matrix = np.zeros((n, n))
    for a, b, w in edges:
        matrix[a, a] += w
        matrix[b, b] += w
        matrix[a, b] -= w
        matrix[b, a] -= w
    x, free = np.zeros(n), [v for v in range(n) if v not in fixed]
    x[list(fixed)] = list(fixed.values())
    x[free] = np.linalg.solve(matrix[np.ix_(free, free)], np.array([load.get(v, 0.0) for v in free]) - matrix[np.ix_(free, list(fixed))] @ x[list(fixed)])
    return x


@pytest.mark.parametrize("by_place, mesh_kind", [(True, "long"), (False, "string")])
def test_systems_by_blocks(spark, by_place, mesh_kind):
    rng = np.random.default_rng(7)
    name = int if mesh_kind == "long" else (lambda m: f"mesh {m}")
    weights, places, fixed, load, want = [], [], [], [], {}
    for m, (edges, where) in enumerate([lattice(15, rng), lattice(4, rng), (scattered(60, 200, rng), [])]):
        weights += [(name(m), *e) for e in edges]
        places += [(name(m), *p) for p in where]
        held = {0: 1.5, 3: -2.0, 14: 4.0}
        for s in (0, 7):
            own = {v: x + s for v, x in held.items()}
            loads = {v: float(rng.normal()) for v in (1, 5, 9)} if s else {}
            fixed += [(name(m), s, v, x) for v, x in own.items()]
            load += [(name(m), s, v, x) for v, x in loads.items()]
            want |= {(name(m), s, v): x for v, x in enumerate(dense_solution(edges, own, loads))}
    kind = FIXED.format(mesh_kind)
    tables = spark.createDataFrame(weights, f"mesh_id {mesh_kind}, v0 long, v1 long, weight double"), spark.createDataFrame(fixed, kind), spark.createDataFrame(load, kind)
    where = spark.createDataFrame(places, f"mesh_id {mesh_kind}, v long, x double, y double, z double") if by_place else None
    for block, dense in ((40, 70), (800, 2400)):  # by levels, and at once
        got = {(r.mesh_id, r.system, r.v): r.value for r in solve.dirichlet(*tables, places=where, block=block, dense=dense).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_what_cannot_be_condensed_is_iterated(spark):
    rng = np.random.default_rng(9)
    edges = scattered(40, 160, rng)
    weights = spark.createDataFrame([(0, *e) for e in edges], "mesh_id long, v0 long, v1 long, weight double")
    held = {0: 1.5, 3: -2.0}
    got = {r.v: r.value for r in solve.dirichlet(weights, spark.createDataFrame([(0, 0, v, x) for v, x in held.items()], FIXED.format("long")), block=4, dense=5).collect()}
    want = dense_solution(edges, held, {})
    assert len(got) == 40 and max(abs(got[v] - want[v]) for v in got) < 1e-6
    lengths = spark.createDataFrame([(0, *e) for e in edges], "mesh_id long, a long, b long, length double")
    near = {r.node: r.distance for r in graph.distances(lengths, spark.createDataFrame([(0, 7)], "mesh_id long, node long"), block=4, dense=5).collect()}
    right = far(edges, [7])
    assert near.keys() == right.keys() and max(abs(near[k] - right[k]) for k in right) < 1e-9


def far(edges, sources):
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    found, queue = {}, [(0.0, v) for v in sources]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in found:
            found[v] = d
            for u, w in near[v]:
                heapq.heappush(queue, (d + w, u))
    return found


def test_distances_by_blocks(spark):
    rng = np.random.default_rng(8)
    meshes = {"a": lattice(16, rng)[0] + [(900, 901, 1.0), (5, 5, 0.1), (0, 1, 9.0)], "b": scattered(80, 300, rng), "c": [(1, 2, 0.0), (2, 3, 1.0)], "without a source": [(0, 1, 1.0)]}
    sources = {"a": [0, 200], "b": [3], "c": [3, 77]}
    edges = spark.createDataFrame([(m, *e) for m, es in meshes.items() for e in es], "mesh_id string, a long, b long, length double")
    starts = spark.createDataFrame([(m, v) for m, vs in sources.items() for v in vs], "mesh_id string, node long")
    want = {(m, v): d for m, vs in sources.items() for v, d in far(meshes[m], vs).items()}
    for block, dense in ((40, 90), (800, 2400)):
        got = {(r.mesh_id, r.node): r.distance for r in graph.distances(edges, starts, block=block, dense=dense).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    near = {(r.mesh_id, r.node): r.distance for r in graph.distances(edges, starts, within=2.5).collect()}
    assert near.keys() == {k for k, d in want.items() if d <= 2.5}
    levels = {(r.mesh_id, r.node): r.level for r in graph.bfs_levels(edges, starts, block=60, dense=120).collect()}
    assert levels == {(m, v): d for m, vs in sources.items() for v, d in far([(a, b, 1) for a, b, _ in meshes[m]], vs).items()}


def test_no_rows(spark):
    edges = spark.createDataFrame([], "mesh_id long, a long, b long, length double")
    assert graph.distances(edges, spark.createDataFrame([], "mesh_id long, node long")).count() == 0
    assert graph.components(edges).count() == 0
    alone = graph.distances(edges, spark.createDataFrame([(4, 9)], "mesh_id long, node long")).collect()
    assert [(r.mesh_id, r.node, r.distance) for r in alone] == [(4, 9, 0.0)]


def test_blocks_are_runs_of_neighbours(spark):
    places = spark.createDataFrame([(0, *p) for p in lattice(40, np.random.default_rng(1))[1]], "mesh_id long, v long, x double, y double, z double")
    got = condense.blocks(places.select("mesh_id", "v"), places, 100, 1600).groupBy("block").agg(F.count("v").alias("n"), (F.max(F.floor(F.col("v") / 40)) - F.min(F.floor(F.col("v") / 40))).alias("wide")).collect()
    assert len(got) == 16 and all(60 <= r.n <= 140 for r in got) and sum(r.wide for r in got) / 16 < 22


def test_components(spark):
    rnd = random.Random(3)
    edges = [(m, rnd.randint(0, 400), rnd.randint(0, 400)) for m in (0, 1) for _ in range(230)] + [(2, 0, i) for i in range(1, 3000)] + [(3, i * 50_000, (i + 1) * 50_000) for i in range(120)] + [(4, 8, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for m, a, b in edges:
        x, y = sorted((find((m, a)), find((m, b))))
        root[y] = x
    got = {(r.mesh_id, r.node): r.root for r in graph.components(spark.createDataFrame(edges, "mesh_id long, a long, b long")).collect()}
    assert got == {k: find(k)[1] for k in root}


def test_blocks_by_faces_where_places_wander(spark):
    """A strip whose vertices stand at random, and whose ids are in two runs, is parted by the order of its faces."""
    n, wide, rng = 200, 4, np.random.default_rng(2)
    at = lambda i, j: i * wide + j + (10_000 if j % 2 else 0)
    faces = spark.createDataFrame([(0, i * wide + j, at(i, j), at(i + 1, j), at(i, j + 1)) for i in range(n - 1) for j in range(wide - 1)], "mesh_id long, f long, a long, b long, c long")
    edges = [(at(i, j), at(i + a, j + b)) for i in range(n) for j in range(wide) for a, b in ((0, 1), (1, 0)) if i + a < n and j + b < wide]
    rows = spark.createDataFrame([(0, min(e), max(e), 1.0) for e in edges], "mesh_id long, a long, b long, weight double")
    places = spark.createDataFrame([(0, at(i, j), *map(float, rng.uniform(size=3))) for i in range(n) for j in range(wide)], "mesh_id long, v long, x double, y double, z double")
    order = condense.order_of(faces, "f", *"abc")
    nodes = places.select("mesh_id", "v")
    got = condense.best_blocks(rows, nodes, places, 80, n * wide, order)
    assert got.count() == n * wide and got.select("block").distinct().count() >= 8
    assert condense.across(rows, got).first()["met"] <= 100
    held = {at(0, 0): 1.0, at(n - 1, 1): 3.0}
    fixed = spark.createDataFrame([(0, 0, v, x) for v, x in held.items()], FIXED.format("long"))
    found = {r.v: r.value for r in solve.dirichlet(rows.withColumnsRenamed({"a": "v0", "b": "v1"}), fixed, places=places, block=80, dense=160, order=order).collect()}
    number = {v: k for k, v in enumerate(sorted(found))}
    want = dense_solution([(number[a], number[b], 1.0) for a, b in edges], {number[v]: x for v, x in held.items()}, {})
    assert len(found) == n * wide and max(abs(found[v] - want[number[v]]) for v in found) < 1e-9


def test_bounded_ways_are_condensed(spark, monkeypatch):
    """A long way up to a bound takes no round an edge, and a node at the bound itself is in it, however its sum is rounded."""
    monkeypatch.setattr(graph, "relaxed", None)
    edges = spark.createDataFrame([(0, k, k + 1, 0.1) for k in range(300)], "mesh_id long, a long, b long, length double")
    got = {r.node: r.distance for r in graph.distances(edges, spark.createDataFrame([(0, 0)], "mesh_id long, node long"), within=20.0, block=40, dense=90).collect()}
    assert got.keys() == set(range(201)) and max(abs(got[k] - k / 10) for k in got) < 1e-9


@pytest.mark.parametrize("at_once", [None, 0])
def test_potentials(spark, at_once):
    """Sums of steps are differences of the values that made them, whether parts are joined at once or by trees."""
    rng = np.random.default_rng(7)
    value, other = rng.normal(size=3000), rng.normal(size=3000)
    ends = [(i, i + 1) for i in range(2999) if i != 1999] + [(i + 40, i) for i in range(2960) if not 1960 <= i <= 1999]
    rows = [(5, g, a, b, float(x[b] - x[a]), (a * 7919) % 3000) for g, x in ((1, value), (2, other)) for a, b in ends]  # no near numbers: nodes are shared
    steps = spark.createDataFrame(rows, "mesh_id long, generator int, a long, b long, val double, at long").withColumn("at", F.col("at") * 16384)
    got = {(r.generator, r.node): r.value for r in graph.potentials(steps, at_once).collect()}
    assert len(got) == 6000
    for g, x in ((1, value), (2, other)):
        assert max(abs(got[g, i] - (x[i] - x[0 if i < 2000 else 2000])) for i in range(3000)) < 1e-9


def test_components_of_near_ids_need_no_rounds(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("rounds over all nodes")

    monkeypatch.setattr(graph, "_stars", rounds)
    n = 40_000  # parts of 16384 ids and of a batch share nodes
    edges = spark.range(n).where("id % 10000 <> 9999").selectExpr("3L AS mesh_id", "id AS a", "id + 1 AS b")
    got = graph.components(edges).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in got) == [(k * 10000, 10000) for k in range(4)]


def test_components_of_many_links_go_on_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 0)
    edges = spark.range(40_000).where("id % 10000 <> 9999").selectExpr("3L AS mesh_id", "id AS a", "id + 1 AS b")
    got = graph.components(edges).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in got) == [(k * 10000, 10000) for k in range(4)]


def test_ways_to_the_root_broadcast_no_tree(spark):
    tree = spark.range(500).selectExpr("0L AS mesh_id", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "id AS e")
    way = graph.root_paths(tree, spark.createDataFrame([(0, 499)], "mesh_id long, start long"))
    assert "BroadcastHashJoin" not in way._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r.node for r in way.collect()) == list(range(1, 500))
