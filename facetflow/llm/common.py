"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.shared import drop_shared, fresh, materialize, shared_path, spread  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def texts(batches: Iterator[pd.DataFrame], col: str = "text") -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """Each batch with its texts, null as empty."""
    for pdf in batches:
        yield pdf, ["" if x is None or x != x else x for x in pdf[col].tolist()]


#: Characters of all texts of a sample, and of one of them: a longer text is no example to learn from.
SAMPLE_CHARS, EXAMPLE_CHARS = 1 << 26, 1 << 20


def examples(rows: DataFrame, some: DataFrame, chars: int = SAMPLE_CHARS, longest: int = EXAMPLE_CHARS) -> DataFrame:
    """Rows (h, id, label, text), one at most for each row (h, id, label) of ``some``, which is bounded; ``rows``: (id, text).

    Of an id's texts it is the one with the least hash, however many rows have that id. The first in the order of
    ``some``'s columns stay, up to ``chars`` characters in all.
    """
    hashed = rows.withColumn("k", F.xxhash64("text")).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    one = hashed.where(F.col("size") <= longest).groupBy("id").agg(F.min(F.struct("k", "size")).alias("one"))
    sized = one.join(F.broadcast(some), "id").select(*some.columns, "one.*")
    # one window over the bounded rows
    within = sized.withColumn("sum", F.sum("size").over(W.orderBy(*some.columns))).where(F.col("sum") <= chars).drop("sum", "size")
    return hashed.join(F.broadcast(within), ["id", "k"]).dropDuplicates(["id", "k", "label"]).select(*some.columns, "text")


# --- a bounded filter of repeated digests -----------------------------------------------------------------------------

#: log2 of the filter's bits: 2^23 bits are 1 MB, at any size of the input.
FILTER_BITS = 23


def repeat_filter(digests: DataFrame, col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2**bits bits with the bits set of all digests (long column ``col``) that occur more than once.

    The map has a fixed size whatever the input holds. A digest whose bit is unset is unique; one whose bit is set may
    be unique all the same, and has to be settled by a join. More repeats only send more rows to that join.
    """
    slot = F.pmod(F.col(col), F.lit(1 << bits))
    words = (
        digests.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.shiftright(slot, 6).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.toPandas()
    out[got["word"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_filter(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which of the digests (int64) may be repeated."""
    slot = np.asarray(digests, dtype=np.int64).view(np.uint64) & np.uint64(bitmap.size * 64 - 1)
    return ((bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


# --- connected components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (longs a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn, until nothing changes; each step is grouped minima and one join, in which
    the neighbours of a hub are dealt out. Empty edges give an empty table; loops and repeats are harmless.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        # large-star: each larger neighbour of u goes to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread(both.where("v > u"), least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: each smaller neighbour of u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_shared(now)
        now = new
        if (tuple(got)) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(got)
    raise RuntimeError(f"components: no end after {max_rounds} rounds")
