"""Meshes: counts, invariants, small cases by hand, and the registered queries against their SQL."""

import functools
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.functions import geometry as g
from facetflow.operators import graph, homology, locate, measures, surgery, topology
from facetflow.plans import catalogue, surfaces  # noqa: F401
from facetflow.sources import obj, tables

TETRAHEDRON = "# four corners\nv 1 1 1\nv -1 -1 1\nv -1 1 -1\nv 1 -1 -1\nvn 0 0 1\nf 1/1/1 2/2/1 3\nf 1 4 2\nf 1 3 -1\nf 2 4 3\n"


@pytest.fixture(scope="module")
def tetrahedron(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("obj") / "t.obj"
    path.write_text(TETRAHEDRON)
    return obj.read_obj(spark, [str(path)])


def test_obj_reading(spark, tetrahedron, tmp_path):
    assert tetrahedron.vertices.count() == 4
    assert sorted(tuple(r) for r in tetrahedron.faces.select("f", "a", "b", "c").collect()) == [(0, 0, 1, 2), (1, 0, 3, 1), (2, 0, 2, 3), (3, 1, 3, 2)]
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(["v 0 0", "v 1 0 0", "v 1 1 0", "v 0 1 0", "f 1 2 3 4"])], "mesh_id long, line long, value string")
    quad = obj.parse(lines)
    assert sorted(tuple(r) for r in quad.faces.select("f", "a", "b", "c").collect()) == [(0, 0, 1, 2), (1, 0, 2, 3)]
    assert quad.vertices.where("z is null").count() == 0
    with pytest.raises(ValueError, match="Unable to open file"):
        obj.read_obj(spark, ["mesh.ply"])
    obj.write_obj(tetrahedron, str(tmp_path / "out.obj"), number="exact")
    back = obj.read_obj(spark, [str(tmp_path / "out.obj")])
    assert sorted(back.faces.collect()) == sorted(tetrahedron.faces.collect()) and sorted(back.vertices.collect()) == sorted(tetrahedron.vertices.collect())
    obj.write_obj(tetrahedron, str(tmp_path / "out"))
    folder = tmp_path / "out" / "mesh_id=0"
    text = "".join((folder / p).read_text() for p in sorted(os.listdir(folder)) if p.startswith("part"))
    assert text.splitlines()[0] == "v 1.000000 1.000000 1.000000" and text.splitlines()[-1] == "f 2 4 3"


def test_arrays_with_bad_indices(spark):
    with pytest.raises(ValueError, match="Invalid face indices"):
        obj.from_arrays(spark, [(0, 0), (1, 0), (0, 1)], [(0, 1, 3)])
    assert obj.from_arrays(spark, [(0, 0), (1, 0), (0, 1)], [(0, 1, 2)]).vertices.where("z = 0").count() == 3


def test_tetrahedron_measures(tetrahedron):
    s = topology.summary(tetrahedron).first()
    assert (s.n_vertices, s.n_edges, s.n_faces, s.euler) == (4, 6, 4, 2)
    assert abs(s.area - 13.856406) < 1e-5 and abs(s.diameter - 3.464102) < 1e-5
    assert all(abs(r.defect - math.pi) < 1e-9 for r in measures.angle_defects(tetrahedron).collect())
    assert all(abs(r.weight - 2 / math.sqrt(3)) < 1e-9 for r in measures.edge_weights(tetrahedron, "coTan").collect())
    topology.check(tetrahedron)


def test_faults_are_told(spark, tetrahedron):
    open_mesh = topology.Mesh(tetrahedron.vertices, tetrahedron.faces.where("f < 3"))
    with pytest.raises(topology.MeshError, match="boundary"):
        topology.check(open_mesh)
    topology.check(open_mesh, require_closed=False)
    with pytest.raises(topology.MeshError, match="isolated"):
        topology.check(topology.Mesh(tetrahedron.vertices, tetrahedron.faces.where("f < 1")), require_closed=False)
    third = spark.createDataFrame([(0, 4, 0, 1, 3)], "mesh_id long, f long, a long, b long, c long")
    with pytest.raises(topology.MeshError, match="non-manifold edges"):
        topology.check(topology.Mesh(tetrahedron.vertices, tetrahedron.faces.unionByName(third)))
    with pytest.raises(topology.MeshError, match="indices"):
        topology.check(topology.Mesh(tetrahedron.vertices.where("v < 3"), tetrahedron.faces))


def test_two_cones_at_a_vertex_are_two_fans(spark):
    faces = [(0, 0, 0, 1, 2), (0, 1, 0, 2, 3), (0, 2, 0, 3, 1), (0, 3, 0, 4, 5), (0, 4, 0, 5, 6), (0, 5, 0, 6, 4)]
    half = topology.halfedges(spark.createDataFrame(faces, "mesh_id long, f long, a long, b long, c long"))
    fans = {r.v: r.fans for r in topology.vertex_fans(half, graph.components).collect()}
    assert fans[0] == 2 and all(fans[v] == 1 for v in range(1, 7))


def test_icosahedron(spark):
    mesh = tables.icosahedron_mesh(spark)
    s = topology.summary(mesh).first()
    assert (s.n_vertices, s.n_edges, s.n_faces, s.euler) == (12, 30, 20, 2) and abs(s.area - 34.641016) < 1e-5
    assert {r.degree for r in topology.degrees(topology.halfedges(mesh.faces)).collect()} == {5}
    assert graph.components(topology.edges(topology.halfedges(mesh.faces)).select("mesh_id", F.col("v0").alias("a"), F.col("v1").alias("b"))).where("root <> 0").count() == 0


def test_subdivision(spark, sf):
    mesh = tables.part_torus(spark, sf)
    a, b = topology.summary(mesh).first(), topology.summary(topology.subdivide(mesh)).first()
    assert b.n_vertices == a.n_vertices + a.n_edges + a.n_faces and b.n_edges == 2 * a.n_edges + 6 * a.n_faces and b.n_faces == 6 * a.n_faces
    assert b.euler == a.euler == 0 and abs(a.area - b.area) < 1e-6
    assert topology.misdirected_edges(topology.halfedges(topology.subdivide(mesh).faces)).count() == 0


def test_gauss_bonnet(spark, sf):
    assert abs(measures.angle_defects(tables.part_torus(spark, sf)).agg(F.sum("defect")).first()[0]) < 1e-6
    assert abs(measures.angle_defects(tables.icosahedron_mesh(spark)).agg(F.sum("defect")).first()[0] - 4 * math.pi) < 1e-9


def test_incidence_is_a_complex(spark, sf):
    """Each face's edges, taken with their turns, have no boundary."""
    faces, vertices = measures.incidence(tables.part_torus(spark, sf))
    product = faces.alias("a").join(vertices.alias("b"), F.col("a.col") == F.col("b.col")).groupBy(F.col("a.row"), F.col("b.row").alias("v")).agg(F.sum(F.col("a.val") * F.col("b.val")).alias("s"))
    assert product.where("s <> 0").count() == 0


def test_laplacian_rows_add_up_to_zero(spark, sf):
    for kind in g.EMBEDDING_TYPES:
        rows = measures.laplacian(measures.edge_weights(tables.part_torus(spark, sf), kind)).groupBy("row").agg(F.sum("val").alias("s"))
        assert rows.where("abs(s) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="unknown embedding type"):
        g.embedding_type("cotan")


def test_location_weights_give_the_point_back(spark, sf):
    points, grid = tables.uv_points(spark, sf), tables.unit_grid(spark, 7)
    found = locate.planar(points, grid)
    assert found.count() == points.count()
    p = g.blend([F.col(f"l{k}") for k in range(3)], [F.col(c) for c in ("ua", "ub", "uc")])
    back = found.join(grid, ["mesh_id", "f"]).join(points, ["point_id", "mesh_id"]).select(p.alias("p"), "u", "w", (F.col("l0") + F.col("l1") + F.col("l2")).alias("s"))
    assert back.where("abs(p.x - u) > 1e-9 or abs(p.y - w) > 1e-9 or abs(s - 1) > 1e-9").count() == 0
    outside = spark.createDataFrame([(1, 0, 1.5, 0.5)], "point_id long, mesh_id long, u double, w double")
    assert locate.planar(outside, grid).count() == 0


def test_location_on_the_sphere(spark, sf):
    found = locate.sphere(tables.directions(spark, sf), topology.with_corners(tables.icosahedron_mesh(spark)))
    assert found.count() == tables.directions(spark, sf).count()
    assert found.where("least(l0, l1, l2) < 0 or abs(l0 + l1 + l2 - 1) > 1e-9").count() == 0


def test_distances_against_a_heap(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 120), rng.integers(0, 40, 120), rng.random(120))]
    best = {0: 0.0}
    for _ in range(40):
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + w < best.get(y, np.inf):
                    best[y] = best[x] + w
    df = spark.createDataFrame([(0, *e) for e in edges], "mesh_id long, a long, b long, length double")
    got = {r.node: r.distance for r in graph.distances(df, spark.createDataFrame([(0, 0)], "mesh_id long, node long")).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best)


def test_surface_point_kinds(spark):
    rows = [(0.6, 0.0, 0.4, "edge"), (0.5, 0.2, 0.3, "face"), (0.0, 0.0, 1.0, "vertex"), (0.0, 0.53846, 0.46154, "edge")]
    df = spark.createDataFrame(rows, "a double, b double, c double, want string")
    assert df.where(g.surface_point_kind("a", "b", "c") != F.col("want")).count() == 0


def test_scalar_functions(spark):
    row = spark.range(1).select(
        g.area_from_lengths(F.lit(3.0), F.lit(4.0), F.lit(5.0)).alias("area"), g.angle_from_lengths(F.lit(5.0), F.lit(3.0), F.lit(4.0)).alias("right"), g.cotan_from_lengths(F.lit(5.0), F.lit(3.0), F.lit(4.0)).alias("cot"),
        g.turning_angle(g.point(F.lit(0.0), F.lit(0.0)), g.point(F.lit(1.0), F.lit(0.0)), g.point(F.lit(1.0), F.lit(1.0))).alias("turn"), g.wrap(F.lit(-0.25)).alias("wrap"), g.unit(g.point(F.lit(0.0), F.lit(0.0))).alias("none"), g.catmull_rom(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.5)).alias("spline"),
    ).first()
    assert row.area == 6 and abs(row.right - math.pi / 2) < 1e-12 and abs(row.cot) < 1e-12 and abs(row.turn - math.pi / 2) < 1e-12
    assert row.wrap == 0.75 and row.none.x is None and row.spline == 1.5


def test_streams_write_numbers_like_c(spark):
    xs = [0.0, -0.0, 1.0, -1.5, 1e-5, 123456.0, 1234567.0, 0.0001, 0.00012345678, 999999.5, 1e300, -2.5e-7, 100.0, 3.14159265]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(obj.stream_number("x")).collect()] == ["%g" % x for x in xs]


def test_polygons_and_their_diagonals(spark):
    rows = ["v 0 0 0", "v 1 0 0", "v 1 1 0", "v 0 1 0", "v 2 0 0", "f 1 2 3 4", "f 2 5 3", "f -5 -4 -3 -2 -1"]
    lines = spark.createDataFrame([(0, i * 70_000, x) for i, x in enumerate(rows)], "mesh_id long, line long, value string")
    assert [tuple(r)[1:] for r in obj.parse(lines).faces.orderBy("f").collect()] == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 1, 4, 2), (3, 0, 1, 2), (4, 0, 2, 3), (5, 0, 3, 4)]
    assert sorted(tuple(r)[1:] for r in obj.diagonals(lines).collect()) == [(0, 2), (0, 2), (0, 3)]
    assert {(r.f, r.polygon // 70_000) for r in obj.polygon_of(lines).collect()} == {(0, 5), (1, 5), (2, 6), (3, 7), (4, 7), (5, 7)}


def test_loading_repairs_and_checks(spark):
    # two tetrahedra that share a vertex and are turned anyhow, and a vertex of no face
    v = [(9, 9, 9), (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    one = [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
    mesh = surgery.load_mesh(spark, v[:5], one, normalize=True)
    assert mesh.vertices.count() == 4 and topology.misdirected_edges(topology.halfedges(mesh.faces)).count() == 0
    assert abs(topology.summary(mesh).first().area - 1) < 1e-9
    with pytest.raises(topology.MeshError, match="one component"):
        surgery.load_mesh(spark, v, one + [(1, 5, 6), (1, 5, 7), (1, 6, 7), (5, 6, 7)])
    strip = [(0, 1, 2), (1, 3, 2), (2, 3, 4), (3, 5, 4), (4, 5, 1), (5, 0, 1)]  # a band with one twist
    with pytest.raises(topology.MeshError, match="oriented"):
        surgery.load_mesh(spark, [(i, i * i, 0) for i in range(6)], strip)


def test_knots_and_periods(spark):
    k = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ((0.5, 1.0), (1.0, 2.0), (2.0, 4.0))))
    row = spark.range(1).select(
        g.with_knot(k, F.lit(1.0), F.lit(7.0)).alias("put"), g.with_knot(k, F.lit(0.1), F.lit(7.0)).alias("new"), g.without_knot(k, F.lit(1.0005)).alias("less"), g.without_knot(k, F.lit(1.5)).alias("same"), g.reset_knots(k).alias("zero"),
        g.spline_at(F.slice(k, 1, 0), F.lit(1.0)).alias("none"), g.spline_at(F.slice(k, 1, 1), F.lit(3.0)).alias("one"), g.spline_at(k, F.lit(1.0)).alias("at"), F.array(*measures.period_map(((1.0, 0.0), (0.0, 2.0)), ((3.0, 1.0), (0.0, 4.0)))).alias("map"),
    ).first()
    assert [x.p for x in row.put] == [1.0, 7.0, 4.0] and [x.t for x in row.new] == [0.1, 0.5, 1.0, 2.0] and [x.t for x in row.less] == [0.5, 2.0] and len(row.same) == 3
    assert [x.p for x in row.zero] == [0.0] * 3 and row.none == 0.0 and row.one == 1.0 and row.at == 2.0 and row["map"] == [3.0, 0.0, 1.0, 2.0]


def test_points_far_from_all_vertices_have_a_nearest(spark):
    at = spark.createDataFrame([(0, 0, 0.9, 0.9), (0, 1, 0.95, 0.9)], "mesh_id long, v long, u double, w double")
    p = spark.createDataFrame([(1, 0, 0.05, 0.05), (2, 0, 0.94, 0.9)], "point_id long, mesh_id long, u double, w double")
    assert {r.point_id: r.v for r in locate.nearest_vertices(p, at, 64).collect()} == {1: 0, 2: 1}


def test_sphere_without_a_face_towards_a_point(spark):
    # one face: the point behind it takes its centroid
    t = spark.createDataFrame([(0, 0, (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))], "mesh_id long, f long, pa struct<x double, y double, z double>, pb struct<x double, y double, z double>, pc struct<x double, y double, z double>")
    p = spark.createDataFrame([(1, 0, -1.0, -1.0, -1.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 0.0, 0.0, 0.0)], "point_id long, mesh_id long, x double, y double, z double")
    got = {r.point_id: (r.f, round(r.l0, 6)) for r in locate.sphere(p, t).collect()}
    assert got == {1: (0, 0.333333), 2: (0, 0.333333)}


@pytest.fixture(scope="module")
def shared_steps():
    """What many queries do first, the trees and the cut of the part torus, is done once for all of them."""
    with pytest.MonkeyPatch.context() as patch:
        for module, name in ((homology, "tree_cotree"), (surfaces, "_cut"), (surfaces, "_disk_uv")):
            patch.setattr(module, name, functools.cache(lambda *args, f=getattr(module, name): f(*args)) if name != "tree_cotree" else _first_only(getattr(module, name)))
        yield


def _first_only(f):
    kept = []
    return lambda mesh, uncuttable=None: f(mesh, uncuttable) if uncuttable is not None else (kept or kept.append(f(mesh)) or kept)[0]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_is_that_of_its_sql(spark, sf, name, shared_steps):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if got[c].dtype == object:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all()
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-6, rtol=0, equal_nan=True)


def test_streams_of_points_are_located(spark, sf, tmp_path):
    from facetflow.streaming import locate_stream

    grid, points = tables.unit_grid(spark, 5).cache(), tables.uv_points(spark, sf).limit(300).cache()
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))
    query = locate_stream(stream, lambda p: locate.planar(p, grid), write, str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("point_id", "f").collect()
    assert sorted(got) == sorted(locate.planar(points, grid).select("point_id", "f").collect()) and len(got) == 300
