"""The registered queries over meshes, and the same results in SQL.

The SQL builds its own tables from the given ones (see _TORUS): nothing of it comes from the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions import geometry as g
from facetflow.operators import embedding, graph, homology, locate, measures, topology
from facetflow.sources import obj, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GRID = 31

_TORUS = """WITH size AS (SELECT count(*) // 20 AS n FROM part),
grid AS (SELECT p_partkey AS v, p_partkey // 20 AS i, p_partkey % 20 AS j, 1 + p_size / 100.0::DOUBLE AS r, n FROM part, size WHERE p_partkey // 20 < n),
vert AS (SELECT v, (4 + r * cos(2 * pi() * j / 20)) * cos(2 * pi() * i / n) AS x, (4 + r * cos(2 * pi() * j / 20)) * sin(2 * pi() * i / n) AS y, r * sin(2 * pi() * j / 20) AS z FROM grid),
face AS (SELECT 2 * v AS f, v AS a, (i + 1) % n * 20 + j AS b, (i + 1) % n * 20 + (j + 1) % 20 AS c FROM grid UNION ALL SELECT 2 * v + 1, v, (i + 1) % n * 20 + (j + 1) % 20, i * 20 + (j + 1) % 20 FROM grid),
half AS (SELECT 3 * f AS h, f, 0 AS k, a AS tail, b AS head, c AS opp FROM face UNION ALL SELECT 3 * f + 1, f, 1, b, c, a FROM face UNION ALL SELECT 3 * f + 2, f, 2, c, a, b FROM face),
edge AS (SELECT row_number() OVER (ORDER BY min(h)) - 1 AS e, least(tail, head) AS lo, greatest(tail, head) AS hi, min(h) AS h, arg_min(tail, h) AS v0, arg_min(head, h) AS v1 FROM half GROUP BY least(tail, head), greatest(tail, head)),
tri AS (SELECT f, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz FROM face JOIN vert p ON p.v = a JOIN vert q ON q.v = b JOIN vert s ON s.v = c),
norm AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM tri),
way AS (SELECT h.*, p.x AS tx, p.y AS ty, p.z AS tz, q.x AS hx, q.y AS hy, q.z AS hz, o.x AS ox, o.y AS oy, o.z AS oz, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS l, sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2 + (o.z - p.z) ** 2) AS lo, sqrt((o.x - q.x) ** 2 + (o.y - q.y) ** 2 + (o.z - q.z) ** 2) AS lh FROM half h JOIN vert p ON p.v = tail JOIN vert q ON q.v = head JOIN vert o ON o.v = opp),
ang AS (SELECT *, acos(greatest(-1.0, least(1.0, (l * l + lo * lo - lh * lh) / (2 * l * lo)))) AS angle, acos(greatest(-1.0, least(1.0, (l * l + lh * lh - lo * lo) / (2 * l * lh)))) AS angle_head, acos(greatest(-1.0, least(1.0, (lo * lo + lh * lh - l * l) / (2 * lo * lh)))) AS angle_opp FROM way)
"""

_UV = """uvtri AS (SELECT 2 * v AS f, i / n::DOUBLE AS ax, j / 20.0::DOUBLE AS ay, (i + 1) / n::DOUBLE AS bx, j / 20.0::DOUBLE AS by_, (i + 1) / n::DOUBLE AS cx, (j + 1) / 20.0::DOUBLE AS cy FROM grid
UNION ALL SELECT 2 * v + 1, i / n::DOUBLE, j / 20.0::DOUBLE, (i + 1) / n::DOUBLE, (j + 1) / 20.0::DOUBLE, i / n::DOUBLE, (j + 1) / 20.0::DOUBLE FROM grid)
"""

_POINTS = "pts AS (SELECT DISTINCT a * 1000 + b AS point_id, (4 * a + 1) / 3988.0::DOUBLE AS u, (4 * b + 1) / 3964.0::DOUBLE AS w FROM (SELECT (7 * l_orderkey + l_partkey) % 997 AS a, l_orderkey % 991 AS b FROM lineitem))"

_LINE_POINTS = "pts AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, (4 * max((7 * l_orderkey + l_partkey) % 997) + 1) / 3988.0::DOUBLE AS u, (4 * (l_orderkey % 991) + 1) / 3964.0::DOUBLE AS w FROM lineitem GROUP BY l_orderkey, l_linenumber)"

#: The unit grid in closed form: a point's cell and the side of its diagonal.
_LOCATED = f"""loc AS (SELECT point_id, 2 * (floor(u * {GRID})::BIGINT * {GRID} + floor(w * {GRID})::BIGINT) + (s < t)::BIGINT AS f,
CASE WHEN s >= t THEN 1 - s ELSE 1 - t END AS l0, CASE WHEN s >= t THEN s - t ELSE s END AS l1, CASE WHEN s >= t THEN t ELSE t - s END AS l2 FROM (SELECT *, u * {GRID} - floor(u * {GRID}) AS s, w * {GRID} - floor(w * {GRID}) AS t FROM pts))"""


def r6(x: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _half(spark: SparkSession, d: str) -> DataFrame:
    return topology.halfedges(tables.part_torus(spark, d).faces)


@query("mesh_summary", _TORUS + f"SELECT (SELECT count(*) FROM vert) AS n_vertices, (SELECT count(*) FROM edge) AS n_edges, count(*) AS n_faces, (SELECT count(*) FROM vert) - (SELECT count(*) FROM edge) + count(*) AS euler, {_r('sum(sqrt(nx * nx + ny * ny + nz * nz) * 0.5)')} AS area, (SELECT {_r('sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2)')} FROM vert) AS diameter FROM norm")
def mesh_summary(spark, d):
    return topology.summary(tables.part_torus(spark, d)).select("n_vertices", "n_edges", "n_faces", "euler", r6("area").alias("area"), r6("diameter").alias("diameter"))


@query("edge_table", _TORUS + "SELECT e, v0 AS tail, v1 AS head FROM edge")
def edge_table(spark, d):
    return topology.edges(_half(spark, d)).select("e", F.col("v0").alias("tail"), F.col("v1").alias("head"))


@query("halfedge_table", _TORUS + "SELECT a.h, 3 * a.f + (a.k + 1) % 3 AS nxt, 3 * a.f + (a.k + 2) % 3 AS prv, b.h AS flip, e FROM half a JOIN half b ON a.tail = b.head AND a.head = b.tail JOIN edge ON lo = least(a.tail, a.head) AND hi = greatest(a.tail, a.head)")
def halfedge_table(spark, d):
    half = _half(spark, d)
    return topology.paired(half, topology.edges(half)).select("h", "nxt", "prv", "flip", "e")


@query("face_table", _TORUS + "SELECT f, c AS a, a AS b, b AS c FROM face")
def face_table(spark, d):
    return topology.rotated_faces(tables.part_torus(spark, d).faces).select("f", "a", "b", "c")


@query("vertex_halfedge", _TORUS + "SELECT tail AS v, max(h) AS h FROM half GROUP BY tail")
def vertex_halfedge(spark, d):
    return topology.vertex_halfedge(_half(spark, d)).select("v", "h")


@query("vertex_degree", _TORUS + "SELECT tail AS v, count(*) AS degree FROM half GROUP BY tail")
def vertex_degree(spark, d):
    return topology.degrees(_half(spark, d)).select("v", "degree")


@query("edge_lengths", _TORUS + f"SELECT e, {_r('l')} AS length FROM edge JOIN ang USING (h)")
def edge_lengths(spark, d):
    return measures.edge_lengths(tables.part_torus(spark, d)).select("e", r6("length").alias("length"))


@query("edge_length_stats", _TORUS + f"SELECT count(*) AS n, {_r('min(l)')} AS shortest, {_r('max(l)')} AS longest, {_r('avg(l)')} AS mean FROM edge JOIN ang USING (h)")
def edge_length_stats(spark, d):
    return measures.edge_lengths(tables.part_torus(spark, d)).agg(F.count(F.lit(1)).alias("n"), r6(F.min("length")).alias("shortest"), r6(F.max("length")).alias("longest"), r6(F.avg("length")).alias("mean"))


@query("face_normals_areas", _TORUS + f"SELECT f, {_r('nx / nn')} AS nx, {_r('ny / nn')} AS ny, {_r('nz / nn')} AS nz, {_r('nn * 0.5')} AS area, {_r('(ax + bx + cx) / 3')} AS cx, {_r('(ay + by_ + cy) / 3')} AS cy, {_r('(az + bz + cz) / 3')} AS cz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nn FROM norm)")
def face_normals_areas(spark, d):
    m = measures.face_measures(tables.part_torus(spark, d))
    return m.select("f", *(r6(c).alias(c) for c in ("nx", "ny", "nz", "area", "cx", "cy", "cz")))


@query("corner_angles", _TORUS + f"SELECT f, k, tail AS v, {_r('angle')} AS angle FROM ang")
def corner_angles(spark, d):
    return measures.corner_angles(tables.part_torus(spark, d)).select("f", "k", "v", r6("angle").alias("angle"))


@query("angle_defect", _TORUS + f"SELECT tail AS v, {_r('2 * pi() - sum(angle)')} AS defect FROM ang GROUP BY tail")
def angle_defect(spark, d):
    return measures.angle_defects(tables.part_torus(spark, d)).select("v", r6("defect").alias("defect"))


@query("gauss_bonnet", _TORUS + f"SELECT {_r('sum(defect)')} AS total FROM (SELECT 2 * pi() - sum(angle) AS defect FROM ang GROUP BY tail)")
def gauss_bonnet(spark, d):
    return measures.angle_defects(tables.part_torus(spark, d)).agg(r6(F.sum("defect")).alias("total"))


@query("vertex_normals", _TORUS + f", s AS (SELECT tail AS v, sum(nx * angle) AS x, sum(ny * angle) AS y, sum(nz * angle) AS z FROM ang JOIN norm USING (f) GROUP BY tail) SELECT v, {_r('x / sqrt(x * x + y * y + z * z)')} AS nx, {_r('y / sqrt(x * x + y * y + z * z)')} AS ny, {_r('z / sqrt(x * x + y * y + z * z)')} AS nz FROM s")
def vertex_normals(spark, d):
    return measures.vertex_normals(tables.part_torus(spark, d)).select("v", *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


_WEIGHT = ", w AS (SELECT e, {} AS w FROM ang JOIN edge ON edge.lo = least(tail, head) AND edge.hi = greatest(tail, head) GROUP BY e) SELECT e, round(CASE WHEN w < 0 THEN 0.01 ELSE w END, 6) + 0.0 AS weight FROM w"


def _weights(kind: str):
    return lambda spark, d: measures.edge_weights(tables.part_torus(spark, d), kind).select("e", r6("weight").alias("weight"))


query("cotan_weights", _TORUS + _WEIGHT.format("sum(1 / tan(angle_opp))"))(_weights("coTan"))
query("mean_value_weights", _TORUS + _WEIGHT.format("sum(tan((CASE WHEN tail = v0 THEN angle ELSE angle_head END) / 2)) / max(l)"))(_weights("MeanValue"))
query("authalic_weights", _TORUS + _WEIGHT.format("sum(1 / tan(CASE WHEN tail = v0 THEN angle_head ELSE angle END)) / max(l) ** 2"))(_weights("Authalic"))


@query("uniform_laplacian_coo", _TORUS + "SELECT tail AS row, head AS col, 1.0::DOUBLE AS val FROM half UNION ALL SELECT tail, tail, -count(*)::DOUBLE FROM half GROUP BY tail")
def uniform_laplacian_coo(spark, d):
    return measures.laplacian(measures.edge_weights(tables.part_torus(spark, d), "Uniform")).select("row", "col", "val")


@query("incidence_face_edge", _TORUS + "SELECT f AS row, e AS col, CASE WHEN tail < head THEN 1 ELSE -1 END AS val FROM half JOIN edge ON lo = least(tail, head) AND hi = greatest(tail, head)")
def incidence_face_edge(spark, d):
    return measures.incidence(tables.part_torus(spark, d))[0].select("row", "col", "val")


@query("incidence_vertex_edge", _TORUS + "SELECT lo AS row, e AS col, -1 AS val FROM edge UNION ALL SELECT hi, e, 1 FROM edge")
def incidence_vertex_edge(spark, d):
    return measures.incidence(tables.part_torus(spark, d))[1].select("row", "col", "val")


@query("subdivision_vertices", _TORUS + f", s AS (SELECT (SELECT count(*) FROM vert) AS nv, (SELECT count(*) FROM edge) AS ne) SELECT v, {_r('x')} AS x, {_r('y')} AS y, {_r('z')} AS z FROM vert UNION ALL SELECT nv + e, {_r('(tx + hx) / 2')}, {_r('(ty + hy) / 2')}, {_r('(tz + hz) / 2')} FROM edge JOIN ang USING (h), s UNION ALL SELECT nv + ne + f, {_r('(ax + bx + cx) / 3')}, {_r('(ay + by_ + cy) / 3')}, {_r('(az + bz + cz) / 3')} FROM tri, s")
def subdivision_vertices(spark, d):
    return topology.subdivide(tables.part_torus(spark, d)).vertices.select("v", *(r6(c).alias(c) for c in "xyz"))


@query("subdivision_faces", _TORUS + ", s AS (SELECT (SELECT count(*) FROM vert) AS nv, (SELECT count(*) FROM edge) AS ne), t AS (SELECT 6 * f + 2 * ((k + 1) % 3) AS g, tail, head, nv + e AS w, nv + ne + f AS d FROM half JOIN edge ON edge.lo = least(tail, head) AND edge.hi = greatest(tail, head), s) SELECT g AS f, tail AS a, w AS b, d AS c FROM t UNION ALL SELECT g + 1, w, head, d FROM t")
def subdivision_faces(spark, d):
    return topology.subdivide(tables.part_torus(spark, d)).faces.select("f", "a", "b", "c")


@query("normalize_area", _TORUS + f", m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, (SELECT sqrt(1 / sum(sqrt(nx * nx + ny * ny + nz * nz) * 0.5)) FROM norm) AS k FROM vert) SELECT v, {_r('(x - mx) * k')} AS x, {_r('(y - my) * k')} AS y, {_r('(z - mz) * k')} AS z FROM vert, m")
def normalize_area(spark, d):
    return topology.normalize_area(tables.part_torus(spark, d)).vertices.select("v", *(r6(c).alias(c) for c in "xyz"))


@query("normalize_radius", _TORUS + f", m AS (SELECT v, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z FROM vert), n AS (SELECT max(sqrt(x * x + y * y + z * z)) AS r FROM m) SELECT v, {_r('x / r')} AS x, {_r('y / r')} AS y, {_r('z / r')} AS z FROM m, n")
def normalize_radius(spark, d):
    return topology.normalize_radius(tables.part_torus(spark, d)).vertices.select("v", *(r6(c).alias(c) for c in "xyz"))


def _punctured(spark, d) -> topology.Mesh:
    """The part torus without the faces around vertices that a multiple of 7 numbers: holes, and isolated vertices."""
    mesh = tables.part_torus(spark, d)
    return topology.Mesh(mesh.vertices, mesh.faces.where("a % 7 <> 0 and b % 7 <> 0 and c % 7 <> 0"))


_PUNCTURED = _TORUS + ", pf AS (SELECT * FROM face WHERE a % 7 <> 0 AND b % 7 <> 0 AND c % 7 <> 0), ph AS (SELECT 3 * f AS h, a AS tail, b AS head FROM pf UNION ALL SELECT 3 * f + 1, b, c FROM pf UNION ALL SELECT 3 * f + 2, c, a FROM pf)"


@query("isolated_vertices", _PUNCTURED + " SELECT v FROM vert WHERE v NOT IN (SELECT tail FROM ph)")
def isolated_vertices(spark, d):
    return topology.isolated_vertices(_punctured(spark, d)).select("v")


@query("remove_isolated_faces", _PUNCTURED + ", u AS (SELECT tail AS v, row_number() OVER (ORDER BY min(h)) - 1 AS n FROM ph GROUP BY tail) SELECT f, x.n AS a, y.n AS b, z.n AS c FROM pf JOIN u x ON x.v = a JOIN u y ON y.v = b JOIN u z ON z.v = c")
def remove_isolated_faces(spark, d):
    return topology.remove_isolated(_punctured(spark, d)).faces.select("f", "a", "b", "c")


@query("boundary_halfedges", _PUNCTURED + " SELECT h, tail, head FROM ph p WHERE NOT EXISTS (SELECT 1 FROM ph q WHERE q.tail = p.head AND q.head = p.tail)")
def boundary_halfedges(spark, d):
    return topology.boundary(topology.halfedges(_punctured(spark, d).faces)).select("h", "tail", "head")


@query("edge_face_counts", _PUNCTURED + " SELECT n_faces, count(*) AS n FROM (SELECT count(*) AS n_faces FROM ph GROUP BY least(tail, head), greatest(tail, head)) GROUP BY n_faces")
def edge_face_counts(spark, d):
    return topology.edges(topology.halfedges(_punctured(spark, d).faces)).groupBy("n_faces").agg(F.count(F.lit(1)).alias("n"))


@query("misdirected_edges", _TORUS + ", t AS (SELECT f, a, CASE WHEN f % 11 = 0 THEN c ELSE b END AS b, CASE WHEN f % 11 = 0 THEN b ELSE c END AS c FROM face), x AS (SELECT a AS tail, b AS head FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t) SELECT tail, head, count(*) AS n FROM x GROUP BY tail, head HAVING count(*) > 1")
def misdirected_edges(spark, d):
    turn = F.col("f") % 11 == 0
    faces = tables.part_torus(spark, d).faces.select("mesh_id", "f", "a", F.when(turn, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("b")).otherwise(F.col("c")).alias("c"))
    return topology.misdirected_edges(topology.halfedges(faces)).select("tail", "head", "n")


def _broken(spark, d) -> DataFrame:
    """Edges of the torus without those at four rings: as many components as there are runs of rings."""
    size = spark.read.parquet(f"{d}/part.parquet").agg(F.floor(F.count(F.lit(1)) / 20).alias("n"))
    e = topology.edges(_half(spark, d)).crossJoin(F.broadcast(size))
    cut = lambda c: (F.floor(F.col(c) / 20) * 4) % F.col("n") < 4
    return e.where(~cut("v0") & ~cut("v1")).select("mesh_id", F.col("v0").alias("a"), F.col("v1").alias("b"))


@query("connected_components", _TORUS + ", k AS (SELECT v, CASE WHEN v // 20 * 4 % n < 4 THEN NULL ELSE v // 20 * 4 // n END AS part FROM grid) SELECT v AS node, min(v) OVER (PARTITION BY part) AS root FROM k WHERE part IS NOT NULL")
def connected_components(spark, d):
    return graph.components(_broken(spark, d)).select("node", "root")


@query("vertex_fans", _TORUS + "SELECT v, 1::BIGINT AS fans FROM vert")
def vertex_fans(spark, d):
    return topology.vertex_fans(_half(spark, d), graph.components).select("v", "fans")


@query("bfs_levels", "WITH RECURSIVE " + _TORUS.removeprefix("WITH ").rstrip() + ", lev(v, level) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT head, level + 1 FROM lev JOIN half ON tail = v WHERE level < 200 AND level < (SELECT n FROM size)) SELECT v AS node, min(level) AS level FROM lev GROUP BY v")
def bfs_levels(spark, d):
    e = topology.edges(_half(spark, d)).select("mesh_id", F.col("v0").alias("a"), F.col("v1").alias("b"))
    return graph.bfs_levels(e, spark.range(1).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("node"))).select("node", "level")


@query("dijkstra_distance", "WITH RECURSIVE " + _TORUS.removeprefix("WITH ").rstrip() + ", step AS MATERIALIZED (SELECT tail, head, l FROM ang), far(v, d) USING KEY (v) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT n.v, n.d FROM (SELECT head AS v, min(far.d + l) AS d FROM far JOIN step ON tail = far.v GROUP BY head) n LEFT JOIN recurring.far o ON o.v = n.v WHERE o.d IS NULL OR n.d < o.d - 1e-12) SELECT v AS node, round(d, 6) + 0.0 AS distance FROM far")
def dijkstra_distance(spark, d):
    e = measures.edge_lengths(tables.part_torus(spark, d)).select("mesh_id", F.col("v0").alias("a"), F.col("v1").alias("b"), "length")
    return graph.distances(e, spark.range(1).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("node"))).select("node", r6("distance").alias("distance"))


@query("planar_locate", f"WITH {_POINTS}, {_LOCATED} SELECT point_id, f, {_r('l0')} AS l0, {_r('l1')} AS l1, {_r('l2')} AS l2 FROM loc")
def planar_locate(spark, d):
    return locate.planar(tables.uv_points(spark, d), tables.unit_grid(spark, GRID)).select("point_id", "f", *(r6(f"l{k}").alias(f"l{k}") for k in range(3)))


@query("line_locate", f"WITH {_LINE_POINTS}, {_LOCATED} SELECT point_id, f, {_r('l0')} AS l0, {_r('l1')} AS l1, {_r('l2')} AS l2 FROM loc")
def line_locate(spark, d):
    """A point for each line of each order, so that the work grows with the table."""
    return locate.planar(tables.line_points(spark, d), tables.unit_grid(spark, GRID)).select("point_id", "f", *(r6(f"l{k}").alias(f"l{k}") for k in range(3)))


@query("bary_to_point", _TORUS + f", {_POINTS}, q AS (SELECT point_id, floor(u * n)::BIGINT AS i, floor(w * 20)::BIGINT AS j, u * n - floor(u * n) AS s, w * 20 - floor(w * 20) AS t FROM pts, size), l AS (SELECT point_id, 2 * (i * 20 + j) + (s < t)::BIGINT AS f, CASE WHEN s >= t THEN 1 - s ELSE 1 - t END AS l0, CASE WHEN s >= t THEN s - t ELSE s END AS l1, CASE WHEN s >= t THEN t ELSE t - s END AS l2 FROM q) SELECT point_id, {_r('l0 * ax + l1 * bx + l2 * cx')} AS x, {_r('l0 * ay + l1 * by_ + l2 * cy')} AS y, {_r('l0 * az + l1 * bz + l2 * cz')} AS z FROM l JOIN tri USING (f)")
def bary_to_point(spark, d):
    located = locate.planar(tables.uv_points(spark, d), tables.torus_uv(spark, d))
    return locate.to_points(located, topology.with_corners(tables.part_torus(spark, d))).select("point_id", *(r6(c).alias(c) for c in "xyz"))


def _ico_sql() -> str:
    vertices, faces = tables.icosahedron()
    v = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, x, y, z in vertices)
    return f"WITH iv AS (SELECT * FROM (VALUES {v}) AS t(v, x, y, z)), fc AS (SELECT * FROM (VALUES {', '.join(map(str, faces))}) AS t(f, a, b, c)), tri AS (SELECT f, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz FROM fc JOIN iv p ON p.v = a JOIN iv q ON q.v = b JOIN iv s ON s.v = c), "


@query("sphere_locate", _ico_sql() + f"""pt AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
w AS (SELECT point_id, f, x * (by_ * cz - bz * cy) - y * (bx * cz - bz * cx) + z * (bx * cy - by_ * cx) AS w0, ax * (y * cz - z * cy) - ay * (x * cz - z * cx) + az * (x * cy - y * cx) AS w1, ax * (by_ * z - bz * y) - ay * (bx * z - bz * x) + az * (bx * y - by_ * x) AS w2 FROM pt, tri),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(least(w0, w1, w2) / (w0 + w1 + w2), 12) DESC, f) AS k FROM w WHERE w0 + w1 + w2 > 0)
SELECT point_id, f::BIGINT AS f, {_r('w0 / (w0 + w1 + w2)')} AS l0, {_r('w1 / (w0 + w1 + w2)')} AS l1, {_r('w2 / (w0 + w1 + w2)')} AS l2 FROM r WHERE k = 1""")
def sphere_locate(spark, d):
    return locate.sphere(tables.directions(spark, d), topology.with_corners(tables.icosahedron_mesh(spark))).select("point_id", "f", *(r6(f"l{k}").alias(f"l{k}") for k in range(3)))


def _lattice(spark: SparkSession) -> DataFrame:
    n = GRID + 1
    return spark.range(n * n).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("v"), (F.floor(F.col("id") / n) / F.lit(float(GRID))).alias("u"), (F.col("id") % n / F.lit(float(GRID))).alias("w"))


@query("nearest_vertex", f"WITH {_POINTS} SELECT point_id, (round(u * {GRID}) * {GRID + 1} + round(w * {GRID}))::BIGINT AS v, {_r(f'sqrt((u - round(u * {GRID}) / {GRID}.0::DOUBLE) ** 2 + (w - round(w * {GRID}) / {GRID}.0::DOUBLE) ** 2)')} AS distance FROM pts")
def nearest_vertex(spark, d):
    return locate.nearest_vertices(tables.uv_points(spark, d), _lattice(spark), GRID).select("point_id", "v", r6("distance").alias("distance"))


@query("line_nearest_vertex", f"WITH {_LINE_POINTS} SELECT point_id, (round(u * {GRID}) * {GRID + 1} + round(w * {GRID}))::BIGINT AS v, {_r(f'sqrt((u - round(u * {GRID}) / {GRID}.0::DOUBLE) ** 2 + (w - round(w * {GRID}) / {GRID}.0::DOUBLE) ** 2)')} AS distance FROM pts")
def line_nearest_vertex(spark, d):
    return locate.nearest_vertices(tables.line_points(spark, d), _lattice(spark), GRID).select("point_id", "v", r6("distance").alias("distance"))


@query("line_tiles", f"WITH {_LINE_POINTS}, t AS (SELECT * FROM (VALUES (-1), (0), (1)) AS x(tu), (VALUES (-1), (0), (1)) AS y(tw)) SELECT 3 * (tu + 1) + tw + 1 AS tile, point_id AS v, {_r('u + tu')} AS u, {_r('w + tw')} AS w FROM pts, t")
def line_tiles(spark, d):
    return locate.tiles(tables.line_points(spark, d).withColumnRenamed("point_id", "v")).select("tile", "v", r6("u").alias("u"), r6("w").alias("w"))


@query("f3_tiles", f"WITH {_POINTS}, t AS (SELECT * FROM (VALUES (-1), (0), (1)) AS x(tu), (VALUES (-1), (0), (1)) AS y(tw)) SELECT 3 * (tu + 1) + tw + 1 AS tile, point_id AS v, {_r('u + tu')} AS u, {_r('w + tw')} AS w FROM pts, t")
def f3_tiles(spark, d):
    return locate.tiles(tables.uv_points(spark, d).withColumnRenamed("point_id", "v")).select("tile", "v", r6("u").alias("u"), r6("w").alias("w"))


@query("uv_measures", _TORUS + f", {_UV}, m AS (SELECT abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * 0.5 AS area, (ax + bx + cx) / 3 AS u, (ay + by_ + cy) / 3 AS w FROM uvtri) SELECT {_r('sum(area)')} AS area_uv, {_r('avg(u)')} AS mean_u, {_r('avg(w)')} AS mean_w, {_r('var_pop(u) * count(*)')} AS suu, {_r('covar_pop(u, w) * count(*)')} AS suw, {_r('var_pop(w) * count(*)')} AS sww FROM m")
def uv_measures(spark, d):
    return measures.uv_measures(tables.torus_uv(spark, d)).select(*(r6(c).alias(c) for c in ("area_uv", "mean_u", "mean_w", "suu", "suw", "sww")))


@query("uv_least_height", f"WITH {_POINTS}, t AS (SELECT range AS turn FROM range(36)), y AS (SELECT turn, max(u * sin(turn * pi() / 36) + w * cos(turn * pi() / 36)) - min(u * sin(turn * pi() / 36) + w * cos(turn * pi() / 36)) AS height FROM pts, t GROUP BY turn) SELECT turn::INT AS turn, {_r('height')} AS height FROM y ORDER BY round(height, 9), turn LIMIT 1")
def uv_least_height(spark, d):
    return measures.least_height_turn(tables.uv_points(spark, d)).select("turn", r6("height").alias("height"))


@query("path_lengths", f"WITH p AS (SELECT o_custkey AS path_id, o_orderkey AS seq, o_totalprice / 1000 AS x, (o_orderkey % 97)::DOUBLE AS y FROM orders), s AS (SELECT path_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS l FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, count(*) AS n_points, {_r('coalesce(sum(l), 0)')} AS length FROM s GROUP BY path_id")
def path_lengths(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    points = o.select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return measures.path_lengths(points).select("path_id", "n_points", r6("length").alias("length"))


@query("stereographic_project", f"WITH {_POINTS}, q AS (SELECT point_id, 8 * u - 4 AS a, 8 * w - 4 AS b FROM pts) SELECT point_id, {_r('2 * a / (1 + a * a + b * b)')} AS x, {_r('2 * b / (1 + a * a + b * b)')} AS y, {_r('(1 - a * a - b * b) / (1 + a * a + b * b)')} AS z FROM q")
def stereographic_project(spark, d):
    p = g.inverse_stereographic(8 * F.col("u") - 4, 8 * F.col("w") - 4)
    return tables.uv_points(spark, d).select("point_id", p.alias("p")).select("point_id", *(r6(f"p.{c}").alias(c) for c in "xyz"))


@query("surface_point_kind", f"WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, (l_quantity % 3) / 2 AS a, (l_linenumber % 2) * (1 - (l_quantity % 3) / 2) AS b FROM lineitem) SELECT o, n, a, b, CASE WHEN greatest(a, b, 1 - a - b) >= 1 - 1e-12 THEN 'vertex' WHEN least(a, b, 1 - a - b) <= 1e-12 THEN 'edge' ELSE 'face' END AS kind FROM l")
def surface_point_kind(spark, d):
    a = F.col("l_quantity") % 3 / 2
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), a.alias("a"), (F.col("l_linenumber") % 2 * (1 - a)).alias("b")).distinct()
    return rows.select("o", "n", "a", "b", g.surface_point_kind("a", "b", 1 - F.col("a") - F.col("b")).alias("kind"))


@query("spline_evaluate", f"WITH p AS (SELECT o_custkey AS c, o_orderkey AS k, lag(o_totalprice / pi()) OVER w AS p0, o_totalprice / pi() AS p1, lead(o_totalprice / pi()) OVER w AS p2, lead(o_totalprice / pi(), 2) OVER w AS p3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT c, k, round(0.5 * (2 * p1 + (p2 - p0) * 0.25 + (2 * p0 - 5 * p1 + 4 * p2 - p3) * 0.0625 + (3 * p1 - p0 - 3 * p2 + p3) * 0.015625), 4) + 0.0 AS y FROM p WHERE p0 IS NOT NULL AND p3 IS NOT NULL")
def spline_evaluate(spark, d):
    from pyspark.sql.window import Window as W

    w, y = W.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_totalprice") / F.pi()
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.lag(y).over(w).alias("p0"), y.alias("p1"), F.lead(y).over(w).alias("p2"), F.lead(y, 2).over(w).alias("p3"))
    return o.where("p0 is not null and p3 is not null").select("c", "k", (F.round(g.catmull_rom("p0", "p1", "p2", "p3", F.lit(0.25)), 4) + F.lit(0.0)).alias("y"))


@query("obj_round_trip", _TORUS + "SELECT f, a, b, c FROM face")
def obj_round_trip(spark, d):
    lines = obj.obj_lines(tables.part_torus(spark, d)).select("mesh_id", (F.col("part") * F.lit(1 << 40) + F.col("n")).alias("line"), "value")
    return obj.parse(lines).faces.select("f", "a", "b", "c")


_SPHERE = """WITH size AS (SELECT count(*) // 20 AS n FROM part),
grid AS (SELECT p_partkey AS v, p_partkey // 20 AS i, p_partkey % 20 AS j, p_partkey // 20 * 20 + (p_partkey % 20 + 1) % 20 AS r, n FROM part, size WHERE p_partkey // 20 < n),
face AS (SELECT v AS a, v + 20 AS b, r + 20 AS c FROM grid WHERE i < n - 1 UNION ALL SELECT v, r + 20, r FROM grid WHERE i < n - 1 UNION ALL SELECT 20 * n, v, r FROM grid WHERE i = 0 UNION ALL SELECT 20 * n + 1, r, v FROM grid WHERE i = n - 1),
deg AS (SELECT v, count(*) AS degree FROM (SELECT a AS v FROM face UNION ALL SELECT b FROM face UNION ALL SELECT c FROM face) GROUP BY v)
"""


@query("sphere_summary", _SPHERE + "SELECT (SELECT count(*) FROM deg) AS n_vertices, (SELECT count(*) FROM face) * 3 // 2 AS n_edges, (SELECT count(*) FROM face) AS n_faces, 2::BIGINT AS euler")
def sphere_summary(spark, d):
    return topology.summary(tables.part_sphere(spark, d)).select("n_vertices", "n_edges", "n_faces", "euler")


@query("sphere_poles", _SPHERE + "SELECT 0 AS choice, min(v) AS pole FROM deg UNION ALL SELECT 1, min(v) FROM deg WHERE degree = (SELECT max(degree) FROM deg) UNION ALL SELECT 2, min(v) FROM deg WHERE degree = (SELECT min(degree) FROM deg)")
def sphere_poles(spark, d):
    mesh = tables.part_sphere(spark, d)
    one, two, three = (embedding.poles(mesh, k).select(F.lit(k).alias("choice"), "pole") for k in range(3))
    return one.unionByName(two).unionByName(three)


@query("boundary_rings", _SPHERE + "SELECT i * 20 AS ring, 20::BIGINT AS n, CASE WHEN i = 0 THEN (20 - j) % 20 ELSE j END AS pos, v FROM grid WHERE i IN (0, n - 1)")
def boundary_rings(spark, d):
    half = topology.halfedges(tables.part_sphere(spark, d).faces)
    grid = half.where(f"f < (select 2 * {tables.COLUMNS} * floor(count(*) / {tables.COLUMNS}) from parquet.`{d}/part.parquet`)")
    return embedding.boundary_rings(grid).select("ring", "n", "pos", "v")


@query("tree_cotree_leftovers", _TORUS + "SELECT 2 - ((SELECT count(*) FROM vert) - (SELECT count(*) FROM edge) + (SELECT count(*) FROM face)) AS n_leftovers")
def tree_cotree_leftovers(spark, d):
    return homology.tree_cotree(tables.part_torus(spark, d)).rest.agg(F.count(F.lit(1)).alias("n_leftovers"))


@query("homology_loops")
def homology_loops(spark, d):
    return homology.loops(homology.tree_cotree(tables.part_torus(spark, d))).select("generator", "e", "val")


@query("closed_one_forms")
def closed_one_forms(spark, d):
    return homology.closed_forms(homology.tree_cotree(tables.part_torus(spark, d))).select("generator", "e", "val")


@query("harmonic_one_forms")
def harmonic_one_forms(spark, d):
    return homology.harmonic_forms(homology.tree_cotree(tables.part_torus(spark, d))).select("generator", "e", r6("val").alias("val"))


@query("disk_embedding")
def disk_embedding(spark, d):
    """The part sphere without its first vertex's faces, in the unit disk."""
    mesh = tables.part_sphere(spark, d)
    return embedding.disk(topology.Mesh(mesh.vertices, mesh.faces.where("a <> 0 and b <> 0 and c <> 0"))).select("v", r6("u").alias("u"), r6("w").alias("w"))


@query("sphere_embedding")
def sphere_embedding(spark, d):
    return embedding.sphere(tables.part_sphere(spark, d), "Uniform").select("v", *(r6(c).alias(c) for c in "xyz"))
