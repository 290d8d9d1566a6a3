"""Meshes and points that Spark derives from given tables.

part torus: part keys 0, 1, ... stand on a grid of 20 columns around a torus whose tube is as thick as the part's size says;
two faces a cell. unit grid: the unit square in n by n cells, each parted by its diagonal. Points come from line items and
embeddings.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions import geometry as g
from facetflow.operators.topology import Mesh

COLUMNS = 20


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all shuffle partitions: a small file is read by one task or two, which would make all faces and text of a large mesh."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def part_torus(spark: SparkSession, sf_dir: str) -> Mesh:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"), "p_size")
    rows = part.agg(F.floor(F.count(F.lit(1)) / COLUMNS).alias("n"))  # one row
    grid = _dealt(part, "v").crossJoin(F.broadcast(rows)).withColumn("i", F.floor(F.col("v") / COLUMNS)).withColumn("j", F.col("v") % COLUMNS).where("i < n")
    r, phi, theta = 1 + F.col("p_size") / F.lit(100.0), 2 * F.pi() * F.col("i") / F.col("n"), 2 * F.pi() * F.col("j") / COLUMNS
    ring = 4 + r * F.cos(theta)
    vertices = grid.select(F.lit(0).cast("long").alias("mesh_id"), "v", (ring * F.cos(phi)).alias("x"), (ring * F.sin(phi)).alias("y"), (r * F.sin(theta)).alias("z"))
    right = (F.col("i") + 1) % F.col("n") * COLUMNS
    up = (F.col("j") + 1) % COLUMNS
    corner, across = right + up, F.col("i") * COLUMNS + up
    two = F.array(F.struct((2 * F.col("v")).alias("f"), F.col("v").alias("a"), (right + F.col("j")).alias("b"), corner.alias("c")), F.struct((2 * F.col("v") + 1).alias("f"), F.col("v").alias("a"), corner.alias("b"), across.alias("c")))
    return Mesh(vertices, grid.select(F.lit(0).cast("long").alias("mesh_id"), F.explode(two).alias("s")).select("mesh_id", "s.*"))


def part_sphere(spark: SparkSession, sf_dir: str) -> Mesh:
    """Part keys in rings from north to south, as far from the centre as the part's size says, and two poles (the last two ids)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"), "p_size")
    rows = part.agg(F.floor(F.count(F.lit(1)) / COLUMNS).alias("n"))  # one row
    grid = _dealt(part, "v").crossJoin(F.broadcast(rows)).withColumn("i", F.floor(F.col("v") / COLUMNS)).withColumn("j", F.col("v") % COLUMNS).where("i < n")
    r, theta, phi = 1 + F.col("p_size") / F.lit(100.0), F.pi() * (F.col("i") + 1) / (F.col("n") + 1), 2 * F.pi() * F.col("j") / COLUMNS
    mesh_id, zero = F.lit(0).cast("long").alias("mesh_id"), F.lit(0.0)
    around = grid.select(mesh_id, "v", (r * F.sin(theta) * F.cos(phi)).alias("x"), (r * F.sin(theta) * F.sin(phi)).alias("y"), (r * F.cos(theta)).alias("z"))
    north, south = COLUMNS * F.col("n"), COLUMNS * F.col("n") + 1
    pole = rows.select(F.explode(F.array(F.struct(north.alias("v"), F.lit(1.0).alias("z")), F.struct(south.alias("v"), F.lit(-1.0).alias("z")))).alias("s")).select(mesh_id, "s.v", zero.alias("x"), zero.alias("y"), "s.z")
    v, right = F.col("v"), F.col("i") * COLUMNS + (F.col("j") + 1) % COLUMNS
    face = lambda f, a, b, c: F.struct(f.alias("f"), a.alias("a"), b.alias("b"), c.alias("c"))
    band = F.when(F.col("i") < F.col("n") - 1, F.array(face(2 * v, v, v + COLUMNS, right + COLUMNS), face(2 * v + 1, v, right + COLUMNS, right)))
    top = F.when(F.col("i") == 0, F.array(face(2 * north + F.col("j"), north, v, right)))
    low = F.when(F.col("i") == F.col("n") - 1, F.array(face(2 * north + COLUMNS + F.col("j"), south, right, v)))
    none = F.array().cast("array<struct<f:bigint,a:bigint,b:bigint,c:bigint>>")
    faces = F.concat(*(F.coalesce(x, none) for x in (band, top, low)))
    return Mesh(around.unionByName(pole), grid.select(mesh_id, F.explode(faces).alias("s")).select("mesh_id", "s.*"))


def torus_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, f, ua, ub, uc): the part torus's faces in the unit square, corners of the last cells at 1."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"))
    rows = part.agg(F.floor(F.count(F.lit(1)) / COLUMNS).alias("n"))
    grid = part.crossJoin(F.broadcast(rows)).withColumn("i", F.floor(F.col("v") / COLUMNS)).withColumn("j", F.col("v") % COLUMNS).where("i < n")
    at = lambda a, b: g.point((F.col("i") + a) / F.col("n"), (F.col("j") + b) / COLUMNS)
    two = F.array(F.struct((2 * F.col("v")).alias("f"), at(0, 0).alias("ua"), at(1, 0).alias("ub"), at(1, 1).alias("uc")), F.struct((2 * F.col("v") + 1).alias("f"), at(0, 0).alias("ua"), at(1, 1).alias("ub"), at(0, 1).alias("uc")))
    return grid.select(F.lit(0).cast("long").alias("mesh_id"), F.explode(two).alias("s")).select("mesh_id", "s.*")


def uv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, mesh_id, u, w): distinct places in the unit square from line items; none lies on a line of an odd grid."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = (7 * F.col("l_orderkey") + F.col("l_partkey")) % 997, F.col("l_orderkey") % 991
    rows = line.select(a.alias("a"), b.alias("b")).distinct()
    return rows.select((F.col("a") * 1000 + F.col("b")).alias("point_id"), F.lit(0).cast("long").alias("mesh_id"), ((4 * F.col("a") + 1) / F.lit(3988.0)).alias("u"), ((4 * F.col("b") + 1) / F.lit(3964.0)).alias("w"))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, mesh_id, u, w): a place in the unit square for each line of each order; none lies on a line of an odd grid."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(F.max((7 * F.col("l_orderkey") + F.col("l_partkey")) % 997).alias("a"))
    b = F.col("l_orderkey") % 991
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), F.lit(0).cast("long").alias("mesh_id"), ((4 * F.col("a") + 1) / F.lit(3988.0)).alias("u"), ((4 * b + 1) / F.lit(3964.0)).alias("w"))


def unit_grid(spark: SparkSession, n: int) -> DataFrame:
    """(mesh_id, f, ua, ub, uc)."""
    cell = spark.range(n * n).select(F.col("id"), F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    at = lambda a, b: g.point((F.col("i") + a) / F.lit(float(n)), (F.col("j") + b) / F.lit(float(n)))
    two = F.array(F.struct((2 * F.col("id")).alias("f"), at(0, 0).alias("ua"), at(1, 0).alias("ub"), at(1, 1).alias("uc")), F.struct((2 * F.col("id") + 1).alias("f"), at(0, 0).alias("ua"), at(1, 1).alias("ub"), at(0, 1).alias("uc")))
    return cell.select(F.lit(0).cast("long").alias("mesh_id"), F.explode(two).alias("s")).select("mesh_id", "s.*")


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, mesh_id, x, y, z) from the first three components of embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("point_id"), F.lit(0).cast("long").alias("mesh_id"), *(F.element_at("embedding", k + 1).cast("double").alias(c) for k, c in enumerate("xyz")))


def icosahedron() -> tuple[list[tuple], list[tuple]]:
    """Vertices (v, x, y, z) and faces (f, a, b, c), turned outward, by rule: (0, +-1, +-golden) and its cyclic shifts."""
    gold = (1 + math.sqrt(5)) / 2
    points = [p for s in (1.0, -1.0) for t in (gold, -gold) for p in ((0.0, s, t), (s, t, 0.0), (t, 0.0, s))]
    near = lambda p, q: abs(math.dist(p, q) - 2) < 1e-9
    faces = []
    for a, b, c in combinations(range(12), 3):
        p, q, r = points[a], points[b], points[c]
        if near(p, q) and near(q, r) and near(p, r):
            det = p[0] * (q[1] * r[2] - q[2] * r[1]) - p[1] * (q[0] * r[2] - q[2] * r[0]) + p[2] * (q[0] * r[1] - q[1] * r[0])
            faces.append((len(faces), a, b, c) if det > 0 else (len(faces), a, c, b))
    return [(v, *p) for v, p in enumerate(points)], faces


def icosahedron_mesh(spark: SparkSession) -> Mesh:
    vertices, faces = icosahedron()
    return Mesh(spark.createDataFrame([(0, *v) for v in vertices], "mesh_id long, v long, x double, y double, z double"), spark.createDataFrame([(0, *f) for f in faces], "mesh_id long, f long, a long, b long, c long"))
