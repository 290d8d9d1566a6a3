"""Removal of repeated passages by hashing units of lines.

A unit is a sentence or a line, whichever ends first: text up to and with a full stop, an exclamation or question mark or a
line end. Units are normalised (lower case, white space as one space) and hashed to 128 bits; digests are grouped over
all documents. The occurrence that ranks first stays: the document with the smallest id (nulls last, ties by a hash of the
text), and in it the first place. Others are repeats. Repeats that follow each other make up a passage, and a
passage of at least ``min_words`` words goes, by default any; units of fewer than ``least`` words are not hashed and go with a passage
that surrounds them. A passage that starts or ends inside a sentence loses its whole sentences; the parts of sentences at its ends stay. Offsets of what goes are in characters of the original.

No group is gathered anywhere: the least and the greatest rank of a digest are aggregated map-side first, and units meet
their digest's row in a join that deals common digests out; only documents' own repeats are put in order, in windows of one document each.

Defined cases: null text stays null; rows of the same id and text are one document and have the same result; an empty
table gives an empty result; a column named removed_spans or removed_words is replaced.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from facetflow.llm.common import fresh, materialize, spread, texts

_UNIT = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")

LEAST = 4
MIN_WORDS = LEAST


def units(text: str, least: int = LEAST) -> list[tuple[int, int, int, int, bytes]]:
    """(start, end, first word, behind the last word, digest) of each unit of at least ``least`` words."""
    out, at = [], 0
    for m in _UNIT.finditer(text):
        words = m.group().lower().split()
        if words:
            if len(words) >= least:
                out.append((m.start(), m.end(), at, at + len(words), xxhash.xxh3_128_digest(" ".join(words).encode())))
            at += len(words)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """Rows (id, key, spans, words) for documents with passages to remove; key is xxhash64 of the text."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("key", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("n", "start", "end", "word", "word_end")), T.StructField("digest", T.BinaryType()), T.StructField("again", T.BooleanType())])

    def run(batches):
        for pdf, xs in texts(batches):
            row, cols = [], [[] for _ in range(7)]
            for i, x in enumerate(xs):
                seen = set()
                for n, (a, b, w, v, d) in enumerate(units(x, least)):
                    row.append(i)
                    for c, value in zip(cols, (n, a, b, w, v, d, d in seen)):
                        c.append(value)
                    seen.add(d)
            out = pdf[["id", "key"]].iloc[row].reset_index(drop=True)
            yield out.assign(**dict(zip(("n", "start", "end", "word", "word_end", "digest", "again"), cols))) if row else out.assign(n=0, start=0, end=0, word=0, word_end=0, digest=b"", again=False)

    # written once: the texts are cut into units a single time
    found = materialize(rows.mapInPandas(run, schema).withColumn("id", F.col("id").cast(kind)), "units")
    rank = F.struct(F.col("id").isNull().alias("null"), "id", "key")
    firsts = found.where("not again").select("digest", rank.alias("rank")).groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first <> last or (first.null and last.null and first.key <> last.key)").select("digest", "first")
    # the unit of a common line may stand in a large share of all documents
    own = found.where("not again")
    other = spread(own, firsts, ["digest"], F.xxhash64("id", "key")).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))))
    columns = ["id", "key", "n", "start", "end", "word", "word_end"]
    repeats = other.select(columns).unionByName(found.where("again").select(columns)).distinct()
    run_of = F.col("n") - F.row_number().over(W.partitionBy("id", "key").orderBy("n"))
    passages = repeats.withColumn("run", run_of).groupBy("id", "key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word_end") - F.min("word")).alias("words")).where(F.col("words") >= min_words)
    return passages.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum("words").alias("words"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """``docs`` without the repeated passages, with removed_spans (start, end in the original) and removed_words."""
    spans = repeated_spans(docs, id_col, text_col, min_words, least).alias("s")
    plain = docs.drop("removed_spans", "removed_words")
    key = fresh("key", plain)
    d = plain.withColumn(key, F.xxhash64(F.col(text_col))).alias("d")
    joined = d.join(spans, F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.id")) & (F.col(f"d.{key}") == F.col("s.key")), "left")
    text = F.col(f"d.`{text_col}`")
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.concat(F.array(F.lit(0)), F.transform("s.spans", lambda x: x["end"]))
    stop = F.concat(F.transform("s.spans", lambda x: x["start"]), F.array(F.length(text)))
    left = F.array_join(F.zip_with(begin, stop, lambda a, b: F.substring(text, a + 1, b - a)), "")
    new = F.when(F.col("s.spans").isNull(), text).otherwise(left)
    return joined.select(
        *(new.alias(text_col) if c == text_col else F.col(f"d.`{c}`") for c in plain.columns), F.coalesce(F.col("s.spans"), none).alias("removed_spans"), F.coalesce(F.col("s.words"), F.lit(0)).cast("long").alias("removed_words")
    )
