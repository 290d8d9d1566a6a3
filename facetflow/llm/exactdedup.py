"""Exact duplicates by an exchange of Golomb-coded fingerprints, then a comparison of bytes.

A text is normalised (A-Z to lower case), and its fingerprint is the top bits of a 64-bit hash: ``spare`` bits more than
the rows need to be counted, so that codes are short and few texts agree by chance. The hash space falls into ranges,
each with an owner.

Send: a sender takes up to ``run`` rows of its partition, and sends each owner the sorted distinct fingerprints of its
range, gaps Golomb-coded. Those that it holds more than once it marks for itself.
Reply: an owner decodes what it got, and sends back to each sender a bitmap of the fingerprints that others sent too. A
text that a third of all rows repeat is one fingerprint in each message, so no owner gets more than its share.
Verify: fingerprints that are marked or whose bit is set are suspects. Only suspects' texts are shuffled; they are grouped by
fingerprint and text, so by their bytes, after each task has merged its own copies. Of these groups, those of several rows are
duplicates; texts that only share a fingerprint fall apart.

Rows find their group by the SHA-256 of the normalised text.

Defined cases: null text counts as empty; null ids rank below all others, and a group without any other keeps a null id; of
rows with the same text and id exactly one is kept; an empty table gives an empty result; further columns are carried
only if asked for, as a struct, so names cannot clash.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import drop_shared, materialize, spread

#: Bits of a fingerprint beyond those that count the rows: one text in 2 ** SPARE is a suspect by chance.
SPARE = 10
#: Rows of a message, and fingerprints of an owner, in the mean.
RUN = 1 << 18
#: Suspect fingerprints that are broadcast, at 8 bytes each; more of them are joined by a shuffle.
MOST = 1 << 20


# --- Golomb codes -----------------------------------------------------------------------------------------------------


def encode(values: np.ndarray, base: int, shift: int) -> bytes:
    """Sorted distinct values of at least ``base``: gaps as quotients by 2 ** shift in unary, then all remainders."""
    gap = np.diff(values, prepend=base - 1) - 1
    ends = np.cumsum((gap >> shift) + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    rest = (gap[:, None] >> np.arange(shift)) & 1
    return np.packbits(np.concatenate([unary, rest.astype(np.uint8).ravel()])).tobytes()


def decode(code: bytes, n: int, base: int, shift: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    rest = bits[at : at + n * shift].reshape(n, shift).astype(np.int64)
    gap = (quotient << shift) + (rest << np.arange(shift)).sum(axis=1)
    return np.cumsum(gap + 1) + base - 1


def golomb_shift(n: int, span: int) -> int:
    """The parameter that suits n values of a range of ``span``, as a power of two."""
    return max(0, int(np.log2(max(1.0, 0.69 * span / max(1, n)))))


def bitmap(which: np.ndarray) -> bytes:
    return np.packbits(which).tobytes()


def from_bitmap(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool)


class Ranges:
    """The hash space of ``bits`` bits in ``owners`` ranges."""

    def __init__(self, bits: int, owners: int):
        self.width = -(-(1 << bits) // owners)

    def owner(self, slots: np.ndarray) -> np.ndarray:
        return slots // self.width

    def base(self, owner: int) -> int:
        return int(owner) * self.width


# --- the exchange -----------------------------------------------------------------------------------------------------


def messages(slots: DataFrame, ranges: Ranges, run: int) -> DataFrame:
    """(sender, owner, n, shift, code, own): a row for each message; ``own`` is the bitmap of what the sender holds twice."""

    def send(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            owner = ranges.owner(value)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rows = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(value)]):
                shift = golomb_shift(b - a, ranges.width)
                rows.append((task << 32 | number, int(owner[a]), b - a, shift, encode(value[a:b], ranges.base(owner[a]), shift), bitmap(times[a:b] > 1)))
            return pd.DataFrame(rows, columns=["sender", "owner", "n", "shift", "code", "own"])

        for pdf in batches:
            if len(pdf):
                held.append(pdf["slot"].to_numpy(dtype=np.int64))
                size += len(pdf)
            if size >= run:
                yield out()
                number, held, size = number + 1, [], 0
        if size:
            yield out()

    return slots.mapInPandas(send, "sender long, owner long, n int, shift int, code binary, own binary")


def replies(sent: DataFrame, ranges: Ranges) -> DataFrame:
    """(sender, owner, bits): which fingerprints of a message another one has too."""

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        base = ranges.base(pdf["owner"].iloc[0])
        got = [decode(c, n, base, s) for c, n, s in zip(pdf["code"], pdf["n"], pdf["shift"])]
        value, times = np.unique(np.concatenate(got), return_counts=True)
        repeated = value[times > 1]
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bits": [bitmap(np.isin(x, repeated, assume_unique=True)) for x in got]})

    return sent.groupBy("owner").applyInPandas(reply, "sender long, owner long, bits binary")


def suspects(slots: DataFrame, bits: int, owners: int, run: int = RUN) -> DataFrame:
    """(slot): the distinct fingerprints that occur more than once in (slot)."""
    ranges = Ranges(bits, owners)
    sent = materialize(messages(slots, ranges, run), "messages")

    def resolve(batches):
        for pdf in batches:
            out = [np.zeros(0, np.int64)]
            for code, n, shift, owner, own, back in zip(*(pdf[c] for c in ("code", "n", "shift", "owner", "own", "bits"))):
                out.append(decode(code, n, ranges.base(owner), shift)[from_bitmap(own, n) | from_bitmap(back, n)])
            yield pd.DataFrame({"slot": np.concatenate(out)})

    found = materialize(sent.join(replies(sent, ranges), ["sender", "owner"]).mapInPandas(resolve, "slot long").distinct(), "suspects")
    drop_shared(sent)
    return found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False, spare: int = SPARE, run: int = RUN, most: int = MOST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``: the row with the largest id is kept.

    ``whole_rows`` adds the struct ``row`` of all columns, so that ``where("kept").select("row.*")`` is ``docs`` without copies.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    print_of = F.xxhash64(text)
    signed = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), print_of.alias("print"), F.sha2(text, 256).alias("sha"), *own), "signed")
    n = signed.count()
    bits = min(62, max(1, n.bit_length()) + spare)
    slot = lambda x: F.shiftrightunsigned(x, 64 - bits).alias("slot")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // run))
    found = suspects(signed.select(slot(F.col("print"))), bits, owners, run)
    few = found.count() <= most

    def of_suspects(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(found), "slot", "left_semi") if few else spread(rows, found, ["slot"], F.monotonically_increasing_id(), "left_semi")

    same = of_suspects(docs.select(slot(print_of), text.alias("text"), F.col(id_col).alias("doc_id"))).groupBy("slot", "text").agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep_id")).where("size > 1")
    # of several rows with the id that stays one is taken
    first = of_suspects(signed.select(slot(F.col("print")), "sha", "doc_id", "rid")).groupBy("sha").agg(F.coalesce(F.max_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"))
    groups = materialize(same.select(F.sha2("text", 256).alias("sha"), "size", "keep_id").join(first, "sha"), "groups")
    joined = spread(signed, groups, ["sha"], F.col("rid"), "left")
    grouped = F.col("size").isNotNull()
    return joined.select(
        "doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if whole_rows else []),
    )


ORACLE = f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)"""
