"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents stand in a fixed shuffled order and may be gone through ``cap`` times. A copy's virtual finish
time is the number of its source's words up to and with it, divided by the source's target; so at any time each source
has given the same share of its target. All copies are taken in the order of that time, up to the total budget.

Nothing is sorted in one piece. Running sums within a source are put together from sums of (source, bucket) groups, whose
number grows with the rows, so a source with a third of all rows is dealt out. The copies are range-sorted by finish time
over all partitions; the sums of the ranges tell which of them holds the cut, and only that range's running sum is taken
to find the first copy beyond the budget, a threshold that each row is held against.

Defined cases: null text or text without words has size 0 and is never taken; null sources form one source, the last in
order; repeated rows are documents of their own; an empty table gives an empty result; where all sizes are 0, all targets
are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes; a target stops at
    ``cap`` times its source's size, and the excess is shared anew by weight. That is a water level: with the sources in
    the order of cap * size / weight, those below the level have their cap, the others level * weight.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("ratio", (-F.col("left_weight")).alias("rest"), "level"))).over(everything)["level"])
        .select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, per_bucket: int = 1 << 16, whole_rows: bool = False) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, taken), one per row of ``docs``.

    With ``whole_rows`` a struct ``kept`` holds all columns of the row.
    """
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept")] if whole_rows else []
    also = ["kept"] if whole_rows else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"), *kept)
    base = materialize(base, "mix-sizes")
    rows = base.count()
    buckets = max(64, -(-rows // per_bucket))
    base = base.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))

    targets = source_targets(base, weights, cap).alias("t")
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).alias("s")
    offsets = sums.join(targets, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "before", "source_size", "target").alias("o")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queue = base.withColumn("run", F.sum("size").over(within)).alias("b").join(offsets, F.col("b.source").eqNullSafe(F.col("o.source")) & (F.col("b.bucket") == F.col("o.bucket")))
    queue = materialize(queue.select("doc_id", "size", "b.source", "source_size", "target", "key", (F.col("before") + F.col("run")).alias("cum"), *also), "mix-queue")

    def finish(r: Column | int) -> Column:
        return (F.col("source_size") * r + F.col("cum")) / F.col("target")

    order = ["finish", "key", "doc_id", "r"]
    copies = queue.where("size > 0 and target > 0").select("size", "key", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("r"), "source_size", "cum", "target")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cap * rows >> 20))
    # written with the number of its range: bounds come from a sample and are drawn once
    copies = materialize(copies.select("size", "key", "doc_id", "r", finish(F.col("r")).alias("finish")).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-copies")
    budget = queue.agg(F.sum("size").cast("double").alias("budget"))
    by_range = copies.groupBy("range").agg(F.sum("size").alias("sum")).withColumn("to", F.sum("sum").over(W.orderBy("range")))
    # the first range that goes beyond the budget holds the cut; with none, all is taken
    cut = by_range.join(F.broadcast(budget)).where("to > budget").agg(F.min_by(F.struct("range", (F.col("to") - F.col("sum")).alias("before"), "budget"), "range").alias("c")).where("c is not null").select(F.col("c.range").alias("cut"), "c.before", "c.budget")
    inside = copies.join(F.broadcast(cut), F.col("range") == F.col("cut")).withColumn("to", F.col("before") + F.sum("size").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    threshold = inside.where(F.col("to") > F.col("budget")).agg(F.min(F.struct(*order)).alias("stop"))

    def taken(r: int) -> Column:
        here = F.struct(finish(r).alias("finish"), F.col("key"), F.col("doc_id"), F.lit(r).alias("r"))
        return F.when(F.col("stop").isNull() | (here < F.col("stop")), F.col("size")).otherwise(F.lit(0))

    whole = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((taken(r) for r in range(1, cap)), taken(0))).otherwise(F.lit(0)).cast("long")
    return queue.join(F.broadcast(threshold)).select("doc_id", "size", "source", "source_size", "target", whole.alias("taken"), *also)


#: The same mix for DuckDB: the query's rows as one running sum over all copies.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS weight FROM base GROUP BY source
), r AS (
  SELECT *, source_size * 3 AS most, (source_size * 3)::DOUBLE / weight AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS own_level
  FROM r WINDOW w AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= own_level THEN most::DOUBLE
         ELSE (SELECT own_level FROM l WHERE ratio > own_level ORDER BY ratio, source IS NULL, source LIMIT 1) * weight END AS target FROM l
), q AS (
  SELECT b.*, t.source_size, t.target, sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT doc_id, size, key, cum, source, r, (source_size * r + cum)::DOUBLE / target AS finish
  FROM q, (VALUES (0), (1), (2)) AS v(r) WHERE size > 0 AND target > 0
), d AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, r ROWS UNBOUNDED PRECEDING) AS upto FROM c
), k AS (
  SELECT source, cum, doc_id, sum(size) AS taken FROM d WHERE upto <= (SELECT sum(size) FROM base) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.cum = k.cum AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.size > 0
"""
