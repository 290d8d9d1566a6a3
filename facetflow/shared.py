"""Tables in the folder that all machines share, names that clash with no column, and joins that deal hot keys out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on this machine (tests), a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives the loss of executors.

    A reread table carries no constraints from the plan that made it. A checkpoint keeps them, and where a table is joined
    with itself round after round their number, and the planning time, would double and more each time.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as keep it apart from all columns of the tables, in any case."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(many: DataFrame, few: DataFrame, on: list[str], by: Column, how: str = "inner", counted: DataFrame | None = None, least: int = 0) -> DataFrame:
    """``many`` joined with ``few`` on the columns ``on``, where a few keys may hold a large share of ``many``'s rows.

    A sketch of fixed size finds the keys of ``counted`` (by default ``many``) that hold more rows than half a shuffle
    partition should. Their rows are dealt over as many parts as they would fill partitions, by a hash of ``by``, and
    ``few``'s rows of these keys are repeated for each part. So the result is that of the plain join (inner, left,
    left_semi or left_anti), and the repeats come to a few times the number of partitions at most. A table of fewer than ``least``
    rows is joined plainly.
    """
    if least and (many if counted is None else counted).limit(least).count() < least:
        return many.join(few, on, how)
    spark, key = many.sparkSession, F.xxhash64(*on)
    wide = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = (many if counted is None else counted).agg(F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {min(2 * wide, 4000)}, {min(max(1000, 32 * wide), 900_000)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    share = got["n"] / wide
    hot = [(x["item"], -int(-2 * x["count"] // share)) for x in got["top"] or [] if x["item"] is not None and x["count"] > max(share / 2, 100)]
    if not hot:
        return many.join(few, on, how)
    h, parts, salt = fresh("h", many, few), fresh("parts", many, few), fresh("salt", many, few)
    table = F.broadcast(spark.createDataFrame(hot, f"{h} long, {parts} int"))  # a row for each hot key: twice the partitions at most
    left = many.withColumn(h, key).join(table, h, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)), F.lit(0))).drop(h, parts)
    right = few.withColumn(h, key).join(table, h, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(h, parts)
    return left.join(right.withColumn(salt, F.col(salt).cast("long")), [*on, salt], how).drop(salt)


def sent_by_key(df: DataFrame) -> DataFrame:
    """``df``, which a join never broadcasts: a table that grows with its mesh, keyed by its nodes, and whose few bytes on disk, on
    which Spark would decide, say little of its rows in memory.
    """
    return df.hint("merge")


#: Rows of a table of one row a mesh that are broadcast.
FEW = 100_000


def beside(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``many`` with the rows of ``few``, which has a row or some for each key, where one key may hold most of ``many``.

    ``few`` is counted: it is broadcast if it has at most FEW rows, else hot keys are dealt out. It is written once for that.
    """
    small = few if hasattr(few, "_shared_path") else materialize(few, "beside")
    if small.count() <= FEW:
        return many.join(F.broadcast(small), on)
    return spread(many, small, on, F.xxhash64(*(F.col(f"`{c}`") for c in many.columns)))
