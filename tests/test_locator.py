"""Location in cells of each triangle's size, written locators, and spheres without turned faces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.functions import geometry as g
from facetflow.operators import embedding, locate, surgery, topology
from facetflow.operators.locator import PlanarLocator
from facetflow.shared import materialize
from facetflow.sources import tables

POINT = "struct<x double, y double, z double>"
TRIANGLES = f"mesh_id long, f long, ua {POINT}, ub {POINT}, uc {POINT}"
POINTS = "point_id long, mesh_id long, u double, w double"


def test_one_face_a_million_times_the_others(spark):
    n, small = 60, 1e-3
    rows = [(0, 10**6, (-500.0, -500.0, 0.0), (1500.0, -500.0, 0.0), (-500.0, 1500.0, 0.0))]
    for i in range(n):
        for j in range(n):
            a, b = i * small, j * small
            rows.append((0, i * n + j, (a, b, 0.0), (a + small, b, 0.0), (a, b + small, 0.0)))
    triangles = spark.createDataFrame(rows, TRIANGLES)
    cells = locate.planar_cells(triangles)
    assert cells.placed.groupBy("f").count().agg(F.max("count")).first()[0] <= 9 and len(cells.levels) == 2
    rng = np.random.default_rng(2)
    points = [(k, 0, float(u), float(w)) for k, (u, w) in enumerate(np.r_[rng.uniform(0, n * small, (300, 2)), rng.uniform(-600, 700, (200, 2))])]
    got = {r.point_id: r.f for r in locate.planar(spark.createDataFrame(points, POINTS), triangles).collect()}
    for k, _, u, w in points:
        i, j = int(np.floor(u / small)), int(np.floor(w / small))
        s, t = u / small - i, w / small - j
        inside = 0 <= i < n and 0 <= j < n and s + t <= 1
        large = u >= -500 and w >= -500 and u + w <= 1000
        assert got.get(k) == (i * n + j if inside else 10**6 if large else None)


def test_points_that_are_no_points(spark):
    odd = [(1, 0, None, 0.5), (2, 0, float("nan"), 0.5), (3, 0, 0.5, float("inf")), (4, 0, 1e9, 0.5), (5, None, 0.5, 0.5), (6, 0, 0.4, 0.3), (7, 0, 1e300, 0.5)]
    points = spark.createDataFrame(odd, POINTS)
    assert [r.point_id for r in locate.planar(points, tables.unit_grid(spark, 3)).collect()] == [6]
    assert locate.planar(points, spark.createDataFrame([], TRIANGLES)).count() == 0
    at = spark.createDataFrame([(0, 0, 0.5, 0.25), (0, 1, None, 0.3), (0, 2, 1e6, -1e6)], "mesh_id long, v long, u double, w double")
    assert {r.point_id: r.v for r in locate.nearest_vertices(points, at, 8).collect()} == {4: 2, 6: 0, 7: 0}
    directions = spark.createDataFrame([(1, 0, None, 0.5, 0.1), (2, 0, float("nan"), 0.5, 0.1), (3, 0, 0.0, 0.0, 0.0), (4, 0, float("inf"), 0.0, 0.0), (5, 0, 3.0, 0.1, 0.2)], "point_id long, mesh_id long, x double, y double, z double")
    assert [r.point_id for r in locate.sphere(directions, topology.with_corners(tables.icosahedron_mesh(spark))).collect()] == [5]


@pytest.fixture(scope="module")
def locator(spark, sf):
    return PlanarLocator.from_mesh(tables.part_torus(spark, sf))


def test_located_points_give_their_place_back(spark, sf, locator):
    points = tables.uv_points(spark, sf)
    found = materialize(locator.locate(points))
    assert found.count() == points.count()
    back = locator.to_plane(found).join(points.withColumnsRenamed({"u": "pu", "w": "pw"}), ["point_id", "mesh_id"])
    assert back.where("abs(u - pu) > 1e-6 or abs(w - pw) > 1e-6").count() == 0 and back.count() == points.count()
    plain = locate.planar(points, locator.triangles)
    assert sorted(map(tuple, plain.select("point_id", "f").collect())) == sorted(map(tuple, found.select("point_id", "f").collect()))
    assert locator.locate(spark.createDataFrame([(1, 0, 1.5, 0.2), (2, 5, 0.5, 0.5), (3, 0, None, 0.5)], POINTS)).count() == 0


def test_faces_stay_in_their_buckets(spark, sf, locator):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = PlanarLocator.load(spark, locator.folder)
        plan = again.locate(tables.uv_points(spark, sf))._jdf.queryExecution().executedPlan().toString()
        join = plan[: plan.index("SortMergeJoin")].count("Exchange hashpartitioning(point_id"), plan[plan.index("SortMergeJoin") :].count("Exchange hashpartitioning(cell")
        assert join == (1, 1) or plan.count("Exchange hashpartitioning(cell") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_disk_and_its_seams(spark, locator):
    s = topology.summary(locator.cut.mesh).first()
    assert s.euler == 1 and topology.summary(locator.mesh).first().euler == 0
    times = {r.v: r.n for r in locator.identification_map().collect()}
    assert sorted(set(times.values())) == [2, 4] and list(times.values()).count(4) == 1
    # copies of a vertex are whole steps apart
    uv = {r.v: (r.u, r.w) for r in locator.uv.collect()}
    for r in locator.cut.copies.collect():
        d = np.subtract(uv[r.v], uv[r.ref])
        assert abs(d - d.round()).max() < 1e-9
    root = next(v for v, n in times.items() if n == 4)
    loops = {}
    for r in locator.generators().orderBy("generator", "pos").collect():
        loops.setdefault(r.generator, []).append(r.v)
    labels = {(r.lo, r.hi): r.generator for r in locator.labels.collect()}
    assert set(loops) == {1, 2} and all(v[0] == root for v in loops.values())
    for k, v in loops.items():
        assert {labels[tuple(sorted(p))] for p in zip(v, [*v[1:], v[0]])} == {k}
    swapped = {r.generator for r in locator.generators(swap=True).where("pos = 1").collect()}
    assert swapped == {1, 2} and {r.generator: r.v for r in locator.generators(swap=True).where("pos = 1").collect()}[1] == loops[2][1]
    # no face is turned in the square
    a, b, c = (F.col(x) for x in ("ua", "ub", "uc"))
    area = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    assert locator.triangles.where(area <= 0).count() == 0


def test_places_of_the_callers_choice(spark):
    square = topology.Mesh(spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 2.0, 0.0, 1.0), (0, 2, 2.0, 2.0, 1.0), (0, 3, 0.0, 2.0, 1.0)], "mesh_id long, v long, x double, y double, z double"), spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3)], "mesh_id long, f long, a long, b long, c long"))
    uv = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 1.0, 1.0), (0, 3, 0.0, 1.0)], "mesh_id long, v long, u double, w double")
    at = PlanarLocator.from_uv(square, uv)
    found = at.locate(spark.createDataFrame([(7, 0, 0.75, 0.25), (8, 0, 0.25, 0.25)], POINTS))
    assert {r.point_id: (r.x, r.y, r.z) for r in at.to_surface(found).collect()} == {7: (1.5, 0.5, 1.0), 8: (0.5, 0.5, 1.0)} and {r.point_id: r.f for r in found.collect()} == {7: 0, 8: 0}
    with pytest.raises(topology.MeshError, match="Places"):
        PlanarLocator.from_uv(square, uv.where("v < 3"))
    with pytest.raises(topology.MeshError, match="genus 1"):
        PlanarLocator.from_mesh(tables.icosahedron_mesh(spark))


def test_turned_faces_are_turned_back(spark):
    mesh = tables.icosahedron_mesh(spark)
    fine = topology.subdivide(mesh)
    unit = g.unit(g.point("x", "y", "z"))
    at = materialize(fine.vertices.select("mesh_id", "v", unit.alias("u")).select("mesh_id", "v", "u.x", "u.y", "u.z"))
    faces = materialize(fine.faces)
    assert embedding.turned_faces(at, faces).count() == 0
    assert sorted(embedding.untangled(at, faces).collect()) == sorted(at.collect())
    # three vertices change places with others
    swap = {12: 40, 40: 12, 5: 55, 55: 5}
    moved = at.replace(swap, subset=["v"])
    assert embedding.turned_faces(moved, faces).count() > 0
    fixed = embedding.untangled(moved, faces)
    assert embedding.turned_faces(fixed, faces).count() == 0 and fixed.where("abs(x * x + y * y + z * z - 1) > 1e-9").count() == 0


def test_a_sphere_is_located_on_itself(spark, sf):
    mesh = tables.part_sphere(spark, sf)
    at = materialize(embedding.sphere(mesh))
    assert embedding.turned_faces(at, mesh.faces).count() == 0
    found = locate.sphere(at.withColumnRenamed("v", "point_id"), topology.with_corners(topology.Mesh(at, mesh.faces)))
    corner = mesh.faces.select("f", F.posexplode(F.array("a", "b", "c")).alias("k", "v"))
    lowest = corner.groupBy("v").agg(F.min("f").alias("low"))
    wrong = found.join(lowest, found["point_id"] == lowest["v"]).where("f <> low or abs(greatest(l0, l1, l2) - 1) > 1e-6")
    assert found.count() == at.count() and wrong.count() == 0


def test_cut_meshes_keep_their_faces(spark, sf):
    mesh = tables.part_torus(spark, sf)
    assert surgery.split(mesh).copies.count() == 0
