"""The queries of this subpackage: each applies an operator to the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm import alignment, ann, bpe, exactdedup, linededup, media, mixing, negatives, packing, quality, simhash, toxicity, warc
from facetflow.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels"), learn=fold("id", 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(_table(spark, sf_dir, "documents"))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, _table(spark, sf_dir, "labels"), learn=fold("id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def neighbour_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(_table(spark, sf_dir, "documents"))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(_table(spark, sf_dir, "documents"))


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label_col=negatives.turned_label())


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity_query,
    "op2_token_counts": token_count_query,
    "op3_warc": warc_query,
    "op4_quality": quality_query,
    "op5_neighbours": neighbour_query,
    "op6_simhash": simhash_query,
    "op7_packing": packing_query,
    "op8_mixing": mixing_query,
    "op9_media": media_query,
    "op10_substring_dedup": line_dedup_query,
    "op11_exact_dedup": exact_dedup_query,
    "op12_hard_negatives": negatives_query,
    "op13_alignment": alignment_query,
}

ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.ORACLE, "op11_exact_dedup": exactdedup.ORACLE, "op12_hard_negatives": negatives.ORACLE}
