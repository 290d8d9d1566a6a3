"""Wavefront OBJ text as a source and a sink.

Reading: lines ``v x y z`` and ``f i j k ...``, where a corner may be i, i/j or i/j/k and only the first number counts;
other lines are passed over. A negative index counts back from the vertices so far. A face of n corners becomes a fan from
its first. Each file is a mesh; meshes are numbered in the order of the paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.operators.topology import Mesh, rotated_faces
from facetflow.shared import materialize


#: Lines of a bucket: running counts are taken within buckets, and the buckets' sums are added up.
_BUCKET = 1 << 16


def parse(lines: DataFrame) -> Mesh:
    """A mesh from (mesh_id, line, value): lines numbered (with gaps, if need be) in their file's order."""
    word = F.split(F.trim("value"), r"\s+")
    rows = lines.select("mesh_id", "line", word.alias("w")).withColumn("tag", F.element_at("w", 1)).where("tag in ('v', 'f')")
    is_v = (F.col("tag") == "v").cast("long")
    n_triangles = F.when(F.col("tag") == "f", F.greatest(F.size("w") - 3, F.lit(0))).otherwise(0).cast("long")
    # written once: the sums of buckets, vertices and faces each need the words of all lines
    rows = materialize(rows.select("mesh_id", "line", "w", "tag", is_v.alias("is_v"), n_triangles.alias("triangles"), F.floor(F.col("line") / _BUCKET).alias("bucket")), "words")
    # vertices up to and triangles before each line: sums of whole buckets, and running sums within one
    ahead = W.partitionBy("mesh_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("mesh_id", "bucket").agg(F.sum("is_v").alias("v"), F.sum("triangles").alias("f"))
    whole = whole.select("mesh_id", "bucket", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in "vf"))
    within = W.partitionBy("mesh_id", "bucket").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum("is_v").over(within)).withColumn("first", F.sum("triangles").over(within) - F.col("triangles"))
    rows = rows.join(whole, ["mesh_id", "bucket"]).withColumn("so_far", F.col("so_far") + F.col("v_before")).withColumn("first", F.col("first") + F.col("f_before"))
    vertices = rows.where("tag = 'v'").select("mesh_id", (F.col("so_far") - 1).alias("v"), *(F.get("w", F.lit(k + 1)).cast("double").alias(c) for k, c in enumerate("xyz"))).fillna(0.0, ["z"])
    index = lambda t: F.split_part(t, F.lit("/"), F.lit(1)).cast("long")
    corner = F.transform(F.slice("w", 2, F.size("w") - 1), lambda t: F.when(index(t) < 0, F.col("so_far") + index(t)).otherwise(index(t) - 1))
    polygons = rows.where("tag = 'f'").select("mesh_id", "first", corner.alias("c")).where("size(c) >= 3")
    fan = F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda k: F.struct(k.alias("k"), F.get("c", F.lit(0)).alias("a"), F.get("c", k).alias("b"), F.get("c", k + 1).alias("c"))))
    triangles = polygons.select("mesh_id", "first", fan.alias("s")).select("mesh_id", (F.col("first") + F.col("s.k") - 1).alias("f"), "s.a", "s.b", "s.c")
    return Mesh(vertices, triangles)


def diagonals(lines: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi): the edges that :func:`parse` draws through polygons of more than three corners; they may not be cut."""
    mesh = parse(lines)
    size = lines.select("mesh_id", "line", F.split(F.trim("value"), r"\s+").alias("w")).where("w[0] = 'f'")
    many = size.where("size(w) > 4")
    if many.limit(1).count() == 0:
        return mesh.faces.select("mesh_id", F.col("a").alias("lo"), F.col("b").alias("hi")).limit(0)
    # a fan's triangles share their first corner; a diagonal is the third side of one and the first of the next
    one, two = mesh.faces.alias("x"), mesh.faces.alias("y")
    next_one = (F.col("x.mesh_id") == F.col("y.mesh_id")) & (F.col("x.f") + 1 == F.col("y.f")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.c") == F.col("y.b"))
    inside = polygon_of(lines)
    pairs = one.join(two, next_one).select(F.col("x.mesh_id").alias("mesh_id"), F.col("x.f").alias("f"), F.col("y.f").alias("g"), F.least("x.a", "x.c").alias("lo"), F.greatest("x.a", "x.c").alias("hi"))
    both = pairs.join(inside.select("mesh_id", "f", F.col("polygon").alias("p")), ["mesh_id", "f"]).join(inside.select("mesh_id", F.col("f").alias("g"), F.col("polygon").alias("q")), ["mesh_id", "g"])
    return both.where("p = q").select("mesh_id", "lo", "hi")


def polygon_of(lines: DataFrame) -> DataFrame:
    """(mesh_id, f, polygon): the line of the polygon that each face of :func:`parse` is a part of."""
    word = F.split(F.trim("value"), r"\s+")
    rows = lines.select("mesh_id", "line", word.alias("w")).where("w[0] = 'f' and size(w) > 3").select("mesh_id", "line", (F.size("w") - 3).cast("long").alias("n"), F.floor(F.col("line") / _BUCKET).alias("bucket"))
    ahead = W.partitionBy("mesh_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("mesh_id", "bucket").agg(F.sum("n").alias("f")).select("mesh_id", "bucket", F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("before"))
    within = W.partitionBy("mesh_id", "bucket").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    first = F.sum("n").over(within) - F.col("n")
    placed = rows.withColumn("first", first).join(whole, ["mesh_id", "bucket"])
    return placed.select("mesh_id", F.explode(F.sequence(F.col("first") + F.col("before"), F.col("first") + F.col("before") + F.col("n") - 1)).alias("f"), F.col("line").alias("polygon"))


def read_lines(spark: SparkSession, path: str, mesh_id: int) -> DataFrame:
    """(mesh_id, line, value) of a file, or of a folder's parts in the order of their names; a file is read in splits.

    A line's number puts its split's rank before its place in it.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    # monotonic within a split, whatever split comes first; a row for each split is ranked
    split = text.groupBy("file", "start").agg(F.min("id").alias("least"))
    ranked = split.withColumn("rank", F.row_number().over(W.orderBy("file", "start")) - 1)
    line = F.col("rank") * F.lit(1 << 33) + F.col("id") - F.col("least")
    return text.join(F.broadcast(ranked), ["file", "start"]).select(F.lit(mesh_id).cast("long").alias("mesh_id"), line.alias("line"), "value")


def read_obj(spark: SparkSession, paths: list[str]) -> Mesh:
    """One mesh for each path: an .obj file, or a folder that :func:`write_obj` made."""
    for p in paths:
        name = p.rstrip("/").rsplit("/", 1)[-1].lower()
        if not (name.endswith(".obj") or name.startswith("mesh_id=")):
            raise ValueError(f"Unable to open file {p}: not an .obj file")
    out = read_lines(spark, paths[0], 0)
    for mesh_id, p in enumerate(paths[1:], 1):
        out = out.unionByName(read_lines(spark, p, mesh_id))
    return parse(out)


def from_arrays(spark: SparkSession, vertices, faces) -> Mesh:
    """A mesh from rows of two or three coordinates and rows of three indices."""
    v = [(0, i, float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0) for i, p in enumerate(vertices)]
    f = [(0, i, *map(int, t)) for i, t in enumerate(faces)]
    if any(not 0 <= k < len(v) for t in f for k in t[2:]):
        raise ValueError("Invalid face indices")
    return Mesh(spark.createDataFrame(v, "mesh_id long, v long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, f long, a long, b long, c long"))


def stream_number(x) -> Column:
    """A number as a C++ stream writes it by default: six digits, without the zeros behind them, and an exponent of two digits."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    bare = lambda t: F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))  # noqa: E731  t has a point

    def written(e: Column) -> Column:
        power = F.split_part(e, F.lit("e"), F.lit(2)).cast("int")
        digits = F.translate(F.split_part(e, F.lit("e"), F.lit(1)), "-.", "")
        large = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        plain = bare(F.when(power >= 0, large).otherwise(small))
        exponent = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.lit("e"), F.split_part(e, F.lit("e"), F.lit(2)))
        sign = F.when(F.startswith(e, F.lit("-")), "-").otherwise("")
        return F.concat(sign, F.when(F.translate(digits, "0", "") == "", "0").when((power < -4) | (power >= 6), exponent).otherwise(plain))

    # the name of a lambda stands for a value, a column for an expression that Spark would write out, and format, wherever it is used
    return F.get(F.transform(F.array(F.format_string("%.5e", x)), written), F.lit(0))


def _turned(faces: DataFrame, rotate: bool) -> DataFrame:
    return rotated_faces(faces) if rotate else faces


def obj_lines(mesh: Mesh, number: str = "stream", rotate: bool = False) -> DataFrame:
    """(mesh_id, part, n, value): the lines of an OBJ file, vertices (part 0) before faces (part 1), indices from 1.

    number: "stream" as :func:`stream_number` writes, "exact" with all digits that a double needs, or a format as %.6f. With
    ``rotate`` a face starts at the corner that its last halfedge leaves.
    """
    text = {"stream": stream_number, "exact": lambda c: F.col(c).cast("string")}.get(number, lambda c: F.format_string(number, c))
    v = mesh.vertices.select("mesh_id", F.lit(0).alias("part"), F.col("v").alias("n"), F.concat_ws(" ", F.lit("v"), *(text(c) for c in "xyz")).alias("value"))
    f = _turned(mesh.faces, rotate).select("mesh_id", F.lit(1).alias("part"), F.col("f").alias("n"), F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    return v.unionByName(f)


def uv_lines(uv: DataFrame, faces: DataFrame, copies: DataFrame) -> DataFrame:
    """(mesh_id, part, n, value): lines "vt u w", and faces of corners index/reference, both from 0; -1 refers to none."""
    t = uv.select("mesh_id", F.lit(0).alias("part"), F.col("v").alias("n"), F.concat_ws(" ", F.lit("vt"), stream_number("u"), stream_number("w")).alias("value"))
    rows = rotated_faces(faces)
    for c in "abc":
        rows = rows.join(copies.select("mesh_id", F.col("v").alias(c), F.col("ref").alias(f"ref_{c}")), ["mesh_id", c], "left")
    corner = [F.concat_ws("/", F.col(c).cast("string"), F.coalesce(f"ref_{c}", F.lit(-1)).cast("string")) for c in "abc"]
    return t.unionByName(rows.select("mesh_id", F.lit(1).alias("part"), F.col("f").alias("n"), F.concat_ws(" ", F.lit("f"), *corner).alias("value")))


def both_lines(mesh: Mesh, uv: DataFrame, uv_faces: DataFrame, only_uv: bool = False) -> DataFrame:
    """(mesh_id, part, n, value): positions, uv places (mesh_id, v, u, w) and faces of corners vertex/place, from 1, with six decimals.

    uv_faces (mesh_id, f, a, b, c) has the faces' places. With ``only_uv`` the places stand as flat vertices.
    """
    pair = uv.select("mesh_id", F.lit(1).alias("part"), F.col("v").alias("n"), F.format_string("v %.6f %.6f 0.0" if only_uv else "vt %.6f %.6f", "u", "w").alias("value"))
    p = mesh.vertices.select("mesh_id", F.lit(0).alias("part"), F.col("v").alias("n"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("value"))
    rows = mesh.faces.join(uv_faces.select("mesh_id", "f", *(F.col(c).alias(f"u{c}") for c in "abc")), ["mesh_id", "f"])
    corner = [(F.col(f"u{c}") + 1).cast("string") if only_uv else F.concat_ws("/", (F.col(c) + 1).cast("string"), (F.col(f"u{c}") + 1).cast("string")) for c in "abc"]
    f = rows.select("mesh_id", F.lit(2).alias("part"), F.col("f").alias("n"), F.concat_ws(" ", F.lit("f"), *corner).alias("value"))
    return pair.unionByName(f) if only_uv else p.unionByName(pair).unionByName(f)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (mesh_id, part, n, value) as a folder of text, whose parts follow each other in the order of their names.

    A path that ends in .obj is the folder of a single mesh; else each mesh has its own under ``path``, mesh_id=<id>.
    """
    ordered = lines.repartitionByRange("mesh_id", "part", "n").sortWithinPartitions("mesh_id", "part", "n").select("mesh_id", "value")
    if path.lower().endswith(".obj"):
        ordered.select("value").write.text(path)
    else:
        ordered.write.partitionBy("mesh_id").text(path)


def write_obj(mesh: Mesh, path: str, number: str = "%.6f") -> None:
    """Write OBJ text that :func:`read_obj` reads back; see :func:`write_lines` for the folders."""
    write_lines(obj_lines(mesh, number), path)
