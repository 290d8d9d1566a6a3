"""Trees, loops, one-forms and embeddings: held against what defines them, and against dense solves by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.operators import embedding, homology, locate, solve, topology
from facetflow.shared import materialize
from facetflow.sources import tables


@pytest.fixture(scope="module")
def trees(spark, sf):
    return homology.tree_cotree(tables.part_torus(spark, sf))


def test_trees_span_and_leave_two_edges(trees):
    n_vertices, n_faces = trees.vertices.count(), trees.faces.count()
    assert n_faces == 2 * n_vertices and trees.rest.count() == 2
    assert trees.vertices.where("parent is null").count() == trees.faces.where("parent is null").count() == 1
    used = trees.vertices.where("parent is not null").select("e").unionByName(trees.faces.where("parent is not null").select("e"))
    assert used.distinct().count() == n_vertices - 1 + n_faces - 1


def test_loops_close_and_meet_their_forms_once(trees):
    loops = homology.loops(trees).cache()
    ends = loops.join(trees.edges, ["mesh_id", "e"]).select("generator", F.explode(F.array(F.struct(F.col("hi").alias("v"), F.col("val")), F.struct(F.col("lo").alias("v"), (-F.col("val")).alias("val")))).alias("s"))
    assert ends.groupBy("generator", "s.v").agg(F.sum("s.val").alias("n")).where("n <> 0").count() == 0
    forms = homology.closed_forms(trees).cache()
    assert _around_faces(trees, forms) == 0
    meet = forms.join(loops.select("mesh_id", F.col("generator").alias("loop"), "e", F.col("val").alias("way")), ["mesh_id", "e"]).groupBy("generator", "loop").agg(F.sum(F.col("val") * F.col("way")).alias("n")).where("n <> 0")
    assert sorted(map(tuple, meet.collect())) == [(0, 0, 1), (1, 1, 1)]


def _around_faces(trees, forms):
    sides = F.array(F.struct(F.col("left").alias("f"), F.col("val")), F.struct(F.col("right").alias("f"), (-F.col("val")).alias("val")))
    rows = forms.join(trees.edges, ["mesh_id", "e"]).select("generator", F.explode(sides).alias("s"))
    return max(abs(r.n) for r in rows.groupBy("generator", "s.f").agg(F.sum("s.val").alias("n")).collect())


def test_harmonic_forms(trees):
    forms = homology.harmonic_forms(trees, 1e-12).cache()
    assert forms.count() == 2 * trees.edges.count()
    assert _around_faces(trees, forms) < 1e-9
    ends = F.array(F.struct(F.col("hi").alias("v"), F.col("val")), F.struct(F.col("lo").alias("v"), (-F.col("val")).alias("val")))
    rows = forms.join(trees.edges, ["mesh_id", "e"]).select("generator", F.explode(ends).alias("s")).groupBy("generator", "s.v").agg(F.sum("s.val").alias("n"))
    assert max(abs(r.n) for r in rows.collect()) < 1e-8


def test_dirichlet_of_several_meshes(spark):
    rng, edges, fixed, load, want = np.random.default_rng(5), [], [], [], {}
    for m, n in ((0, 12), (1, 2), (2, 30)):
        pairs = sorted({(i, i + 1) for i in range(n - 1)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(2 * n)})
        a = np.zeros((n, n))
        for i, j in pairs:
            w = float(rng.uniform(0.5, 2))
            edges.append((m, i, j, w))
            a[i, i] += w
            a[j, j] += w
            a[i, j] -= w
            a[j, i] -= w
        for s in (0, 1):
            b = rng.normal(size=n) if s else np.zeros(n)
            fixed.append((m, s, 0, 3.0 + s))
            load += [(m, s, i, float(b[i])) for i in range(1, n)] if s else []
            x = np.linalg.solve(a[1:, 1:], b[1:] - a[1:, 0] * (3.0 + s))
            want |= {(m, s, i + 1): x[i] for i in range(n - 1)} | {(m, s, 0): 3.0 + s}
    kind = "mesh_id long, system int, v long, value double"
    got = solve.dirichlet(spark.createDataFrame(edges, "mesh_id long, v0 long, v1 long, weight double"), spark.createDataFrame(fixed, kind), spark.createDataFrame(load, kind), 1e-12)
    got = {(r.mesh_id, r.system, r.v): r.value for r in got.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_disk_and_sphere(spark, sf):
    mesh = tables.part_sphere(spark, sf)
    topology.check(mesh)
    faces = np.array([tuple(r) for r in mesh.faces.select("a", "b", "c").collect()])
    ball = np.array([tuple(r) for r in embedding.sphere(mesh).orderBy("v").select(*"xyz").collect()])
    assert np.abs(np.linalg.norm(ball, axis=1) - 1).max() < 1e-9 and np.linalg.norm(ball.mean(axis=0)) < 1e-4
    assert np.linalg.det(ball[faces]).min() > -1e-12
    open_faces = mesh.faces.where("a <> 0 and b <> 0 and c <> 0")
    flat = {r.v: (r.u, r.w) for r in embedding.disk(topology.Mesh(mesh.vertices, open_faces)).collect()}
    kept = [f for f in faces if 0 not in f]
    area = [np.linalg.det([np.subtract(flat[b], flat[a]), np.subtract(flat[c], flat[a])]) for a, b, c in kept]
    assert len(flat) == len(ball) - 1 and min(area) > 0
    two_holes = topology.Mesh(mesh.vertices, mesh.faces.where("a < 200"))
    with pytest.raises(topology.MeshError, match="more than one"):
        embedding.disk(two_holes)


@pytest.fixture(scope="module")
def long_ball(spark):
    """A tube of 300 rings of 6 vertices with two poles, and its places on the sphere: in a disk all but some 40 rings fall together."""
    n, wide = 300, 6
    at = lambda i, j: i * wide + j % wide
    faces = [f for i in range(n - 1) for j in range(wide) for f in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    faces += [f for j in range(wide) for f in ((n * wide, at(0, j), at(0, j + 1)), (n * wide + 1, at(n - 1, j + 1), at(n - 1, j)))]
    vertices = spark.createDataFrame([(0, v, float(v), 0.0, 0.0) for v in range(n * wide + 2)], "mesh_id long, v long, x double, y double, z double")
    mesh = topology.Mesh(vertices, spark.createDataFrame([(0, f, *abc) for f, abc in enumerate(faces)], "mesh_id long, f long, a long, b long, c long"))
    return mesh, materialize(embedding.sphere(mesh, "Uniform"))


def test_a_long_mesh_is_laid_on_the_sphere(long_ball):
    """its disk leaves most places the same, so that it could not be centred."""
    mesh, at = long_ball
    ball = np.array([tuple(r) for r in at.orderBy("v").select(*"xyz").collect()])
    assert len(ball) == 1802 and np.abs(np.linalg.norm(ball, axis=1) - 1).max() < 1e-9 and np.linalg.norm(ball.mean(axis=0)) < 1e-4
    assert embedding.turned_faces(at, mesh.faces).count() == 0


def test_a_long_mesh_is_located_on_itself(long_ball):
    """each vertex in its lowest face, with all weight on itself, however narrow the faces."""
    mesh, at = long_ball
    found = locate.sphere(at.withColumnRenamed("v", "point_id"), topology.with_corners(topology.Mesh(at, mesh.faces)))
    lowest = mesh.faces.select("f", F.explode(F.array("a", "b", "c")).alias("point_id")).groupBy("point_id").agg(F.min("f").alias("low"))
    assert found.join(lowest, "point_id").where("f = low and abs(greatest(l0, l1, l2) - 1) < 1e-9").count() == 1802
