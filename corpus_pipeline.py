"""A corpus pipeline: quality, near copies, repeated passages, source weights, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each stage's table to the shared folder and reads
it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm import linededup, mixing, packing, quality, simhash
from facetflow.llm.common import fold, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, labels, learn=fold("id", 5) != 0, whole_rows=True)
    return scored.where("predicted = 1").select(*(F.col(f"kept.`{c}`").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; one that has nothing left goes."""
    cut = linededup.remove_repeats(docs)
    left = cut.where((F.col("removed_words") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_words") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that each source has its target share."""
    mixed = mixing.mix(docs, whole_rows=True).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size")).cast("int")
    return mixed.select(F.explode(F.sequence(F.lit(1), times)), "kept").select(*(F.col(f"kept.`{c}`").alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Stages 1 and 2 have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
