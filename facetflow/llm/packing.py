"""Best-fit packing of token pieces into sequences, by linear grouping.

The plan is made from the histogram of piece lengths, a table of at most ``capacity`` rows at any size of the input:

1. pieces longer than ``capacity * small`` are put in order and parted into groups of equal cardinality; each length is
   rounded up to the longest of its group;
2. a linear programme over the few sizes picks how often each configuration (a multiset of sizes that fits) is used, by
   column generation; counts are rounded down;
3. actual documents take the configurations' places: the longest up to a place's size, and for the last place of a sequence the
   longest that fits what is really left; a configuration whose documents leave more than a few places free stops there;
4. what is left over, and all small pieces, go best-fit, longest first, into the tightest sequence that has room.

The plan is a list of runs: pieces of one length with ranks from a to b go to sequences s, s+1, ... at an offset. Pieces get
their ranks from counts by (length, bucket), so a length that a third of the pieces share is dealt out too, and a
join with the runs (bounded by the histogram) places each piece.

Defined cases: null text counts as empty; an empty text is its end mark alone (length 1); only documents of more than
``capacity`` ids are cut, the first piece taking the remainder; repeated rows are documents of their own; an empty table
gives an empty result; runs of any length of blanks, line ends or letters are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetflow.llm.bpe import PATTERN, byte_symbols, checked, counter, vocabulary_path
from facetflow.llm.common import materialize, texts

CAPACITY = 2048
END = b"\0\0\0\0"

#: Runs of white space that the encoder's pattern is not tried on: it backtracks over them.
_BLANKS = regex.compile(r"\s{1000,}")


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit bytes, for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        self.path = path
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.special = {k: int(v).to_bytes(4, "little") for k, v in special.items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def part(self, text: str) -> bytes:
        return self.encode(text, allowed_special=set(), disallowed_special=()).astype("<u4").tobytes()

    def plain(self, text: str) -> bytes:
        try:
            return self.part(text)
        except ValueError:  # too long a run of white space for the pattern's stack
            return self.with_blanks(text)

    def with_blanks(self, text: str) -> bytes:
        """Long runs of white space apart: such a run is one piece, but for its last character where a visible one follows."""
        out, at = [], 0
        for m in _BLANKS.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out += [self.part(text[at : m.start()]), np.array(counter(self.path).symbols(text[m.start() : stop]), dtype="<u4").tobytes()]
            at = stop
        return b"".join([*out, self.part(text[at:])])

    def __call__(self, text: str) -> bytes:
        if self.mark is None or not self.mark.search(text):
            return self.plain(text)
        return b"".join(self.special.get(x) or self.plain(x) for x in self.mark.split(text))


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(path)


# --- the plan ---------------------------------------------------------------------------------------------------------


def group_lengths(items: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) pairs, longest first, parted into at most ``groups`` runs of equal cardinality."""
    total = sum(n for _, n in items)
    share = max(1, -(-total // groups))
    out, room = [[]], share
    for length, n in items:
        while n:
            if room == 0:
                out.append([])
                room = share
            k = min(n, room)
            out[-1].append((length, k))
            n, room = n - k, room - k
    return [g for g in out if g]


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and has the highest value: one size more in each round, for all rooms at once."""
    room = np.arange(capacity + 1)
    back = room - sizes[:, None]
    fits, back = back >= 0, np.maximum(back, 0)
    best, rounds = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        got = np.where(fits, best[back] + values[:, None], 0.0)
        j = got.argmax(0)
        more = got[j, room] > best + 1e-12
        if not more.any():
            break
        best = np.where(more, got[j, room], best)
        rounds.append(np.where(more, j, -1))
    use, c = np.zeros(len(sizes)), capacity
    for j in reversed(rounds):
        if j[c] >= 0:
            use[j[c]] += 1
            c -= int(sizes[j[c]])
    return best[capacity], use


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down, from the linear programme: within ``gap`` of its least sum."""
    m = len(sizes)
    columns = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    amount, bound = inverse @ need, 0.0
    for _ in range(most):
        price = np.maximum(inverse.sum(0), 0)
        value, use = best_configuration(sizes, price, capacity)
        bound = max(bound, float(price @ need) / max(value, 1.0))
        if value <= 1 + 1e-7 or amount.sum() <= bound * (1 + gap):
            break
        turn = inverse @ use
        ratio = np.where(turn > 1e-9, amount / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = use
        row = inverse[out] / turn[out]
        inverse = inverse - np.outer(turn, row)
        inverse[out] = row
        amount = np.maximum(inverse @ need, 0)
    return [(columns[i].astype(int), int(amount[i] + 1e-7)) for i in range(m) if int(amount[i] + 1e-7) > 0]


@lru_cache(maxsize=8)
def programme(large: tuple[tuple[int, int], ...], capacity: int, groups: int) -> list[tuple[list[int], int]]:
    """(sizes, how often) of each configuration of large pieces (length, count; longest first), the loosest first."""
    if not large:
        return []
    need: dict[int, int] = defaultdict(int)
    for g in group_lengths(list(large), groups):
        need[g[0][0]] += sum(n for _, n in g)
    sizes = np.array(sorted(need, reverse=True))
    made = configurations(sizes, np.array([need[s] for s in sizes.tolist()], dtype=float), capacity)
    made.sort(key=lambda c: float(c[0] @ sizes))
    return [([int(s) for s, k in zip(sizes, use) for _ in range(k)], times) for use, times in made]


@dataclass
class Plan:
    """Runs (length, rank_from, rank_to, sequence_from, per_sequence, offset) and what they come to.

    The piece of that length with rank r goes to sequence sequence_from + (r - rank_from) // per_sequence, at
    offset + (r - rank_from) % per_sequence * length.
    """

    runs: list[tuple[int, int, int, int, int, int]]
    sequences: int
    large: int
    by_configuration: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, loose: int = 16, small: float = 0.125) -> Plan:
    """A plan for pieces of the histogram's lengths. A configuration's sequences are used where its documents leave at most ``loose`` places free."""
    runs, rank, n_bins, placed = [], defaultdict(int), 0, 0
    room = defaultdict(list)  # free tokens -> [(first sequence, how many)]
    filled = 0  # the bits of room's keys

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, rank[length], rank[length] + n, first, per, offset))
        rank[length] += n

    def free(left: int, first: int, n: int) -> None:
        nonlocal filled
        if left > 0 and n > 0:
            room[left].append((first, n))
            filled |= 1 << left

    if histogram.get(capacity):
        put(capacity, histogram[capacity], 0, 1, 0)
        n_bins = histogram[capacity]
    rest = {x: n for x, n in histogram.items() if x < capacity}
    large = tuple(sorted(((x, n) for x, n in rest.items() if x > capacity * small), reverse=True))
    have = sum(1 << x for x, _ in large)

    def documents(sizes: list[int]) -> tuple[list[int], int]:
        """Actual lengths for a configuration's places: the longest up to the size, for the last the longest that fits."""
        got, used, left = [], defaultdict(int), capacity
        for i, size in enumerate(sizes):
            some = have & ((1 << (left if 0 < i == len(sizes) - 1 else min(size, left)) + 1) - 1)
            while some and rest[x := some.bit_length() - 1] <= used[x]:
                some &= ~(1 << x)
            if some:
                used[x] += 1
                got.append(x)
                left -= x
        return got, min((rest[x] // n for x, n in used.items() if n), default=0)

    for sizes, times in programme(large, capacity, groups):
        while times:
            got, n = documents(sizes)
            n = min(n, times)
            if not n or (len(sizes) > 1 and capacity - sum(got) > loose):
                break
            offset = 0
            for x in got:
                put(x, n, n_bins, 1, offset)
                offset, placed = offset + x, placed + n
                rest[x] -= n
                if not rest[x]:
                    have &= ~(1 << x)
            free(capacity - offset, n_bins, n)
            n_bins, times = n_bins + n, times - n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = filled >> length
            if fits:
                left = length + (fits & -fits).bit_length() - 1
                first, own = room[left].pop()
                if not room[left]:
                    filled &= ~(1 << left)
            else:
                left, first, own = capacity, n_bins, max(1, n // (capacity // length))
                n_bins += own
            per = min(left // length, n)
            k = min(own, n // per)
            put(length, per * k, first, per, capacity - left)
            n -= per * k
            free(left - per * length, first, k)
            free(left, first + k, own - k)
    return Plan(runs, n_bins, sum(n for _, n in large), placed)


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences over how loose a configuration may be; of equals the one that uses most of them."""
    return min((plan(histogram, capacity, loose=x) for x in (64, 16, 4)), key=lambda p: (p.sequences, -p.by_configuration))


# --- the operator -----------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids with the end mark, cut where too long."""
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        encode = ids(vocabulary_path(vocabulary))
        for pdf, xs in texts(batches):
            out = []
            for key, data in zip(pdf["doc_id"].tolist(), (encode(x) + END for x in xs)):
                n = len(data) // 4
                at, to = 0, n - (n - 1) // capacity * capacity
                for k in range((n - 1) // capacity + 1):
                    out.append((key, k, at, to - at, zlib.crc32(data[4 * at : 4 * to])))
                    at, to = to, to + capacity
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", per_bucket: int = 1 << 18) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = spark.createDataFrame(pd.DataFrame(best_plan(histogram, capacity).runs, columns=["length", "rank_from", "rank_to", "sequence_from", "per_sequence", "offset_from"], dtype="int64"), "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, offset_from long")
    # as many buckets as keep those of the commonest length at about ``per_bucket`` pieces
    buckets = max(16, -(-max(histogram.values(), default=0) // per_bucket))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).drop("n")
    within = W.partitionBy("length", "bucket").orderBy("ids_crc32", "doc_id", "piece")
    ranked = made.withColumn("own", F.row_number().over(within) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    # the runs are made from a histogram of ``capacity`` rows, whatever the input holds
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")
    placed = r.join(t, (F.col("r.length") == F.col("t.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "r.length", "ids_crc32", (F.col("sequence_from") + F.floor(step / F.col("per_sequence"))).cast("long").alias("sequence_id"), (F.col("offset_from") + step % F.col("per_sequence") * F.col("r.length")).alias("offset")
    )
