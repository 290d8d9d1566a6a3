"""SimHash near-duplicate groups by bit-sliced comparison.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Distinct fingerprints link at
``radius`` or fewer differing bits; a group is a connected component of links.

Candidates: the 64 bits are parted into radius + m blocks. Two fingerprints within the radius agree in at least m blocks,
so they share the key of at least one choice of m blocks; no link is lost. Rows are dealt by key. Two fingerprints of
one key can only differ in the other blocks' bits, which bounds a key's group whatever the input; copies do not
count, since a fingerprint comes once.

Comparison: the fingerprints of a task stand in the order of their keys, with bit b of all of them in plane b. For
small groups the planes are held against themselves shifted by 1, 2, ... places; in large groups each fingerprint is held
against the group's planes. Differing bits are added up by carry-save adders into vertical counters, 64 comparisons a
word, and words all of whose comparisons are beyond the radius are abandoned on the way. A task keeps only links that
join two of its trees, so a group of n gives n - 1 links, not n squared.

Defined cases: null text counts as empty; a text without words has fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; repeated rows are documents of their own; null ids are never a component's smallest id,
unless it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from facetflow.llm.common import components, drop_shared, fresh, materialize, spread, texts

#: Groups up to this size are compared by shifted planes.
SMALL = 24


def shingles(text: str, n: int) -> list[bytes]:
    """Space-joined n-word shingles, A-Z lower-cased; words part at ASCII white space."""
    words = text.encode().lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(n)))]


def fingerprint(text: str, n: int = 3, distinct: bool = False, seed: int = 42) -> int:
    return all_fingerprints(text, n, distinct, 1, seed)[0]


def all_fingerprints(text: str, n: int, distinct: bool, how_many: int, seed: int = 42) -> list[int]:
    """Fingerprints from the shingles' hashes and, after the first, from hashes mixed anew."""
    units = shingles(text, n)
    if distinct:
        units = list(set(units))
    if not units:
        return [0] * how_many
    hashes = np.fromiter(map(lambda s: xxhash.xxh64_intdigest(s, seed), units), dtype="<u8", count=len(units))
    out = []
    for k in range(how_many):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(units), 1 << 16):
            ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(units), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, keys: list[str], text_col: str, words: int, distinct: bool, how_many: int = 1) -> DataFrame:
    """The columns ``keys``, and fp, fp1, ..., signed longs."""
    names = ["fp", *(f"fp{k}" for k in range(1, how_many))]

    def run(batches):
        for pdf, xs in texts(batches, "__text"):
            fps = np.array([all_fingerprints(x, words, distinct, how_many) for x in xs], dtype=np.uint64).reshape(-1, how_many)
            yield pdf[keys].assign(**{c: np.ascontiguousarray(fps[:, k]).view(np.int64) for k, c in enumerate(names)})

    # ids go as text: a pandas column of longs with a null among them would lose digits
    rows = docs.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(text_col).cast("string").alias("__text"))
    made = rows.mapInPandas(run, T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in names)]))
    return made.select(*(F.col(k).cast(docs.schema[k].dataType).alias(k) for k in keys), *names)


# --- bit-sliced comparison --------------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Counters:
    """Vertical counters: carry-save sums of bits, in ``bits`` planes and one for overflow."""

    def __init__(self, shape, radius: int):
        self.radius, self.width = radius, max(2, (radius + 1).bit_length())
        self.planes = [np.zeros(shape, dtype=np.uint64) for _ in range(self.width)]
        self.over = np.zeros(shape, dtype=np.uint64)

    def _add(self, x: np.ndarray, at: int) -> None:
        for k in range(at, self.width):
            carry = self.planes[k] & x
            self.planes[k] ^= x
            x = carry
        self.over |= x

    def add3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Three planes at once: a full adder gives their sum and their carry."""
        half = a ^ b
        self._add(half ^ c, 0)
        self._add((a & b) | (half & c), 1)

    def add1(self, a: np.ndarray) -> None:
        self._add(a, 0)

    def beyond(self) -> np.ndarray:
        """The comparisons with more differing bits than the radius."""
        more, same = self.over.copy(), ~self.over
        for k in reversed(range(self.width)):
            if self.radius >> k & 1:
                same &= self.planes[k]
            else:
                more |= same & self.planes[k]
                same &= ~self.planes[k]
        return more

    def keep(self, which: np.ndarray) -> None:
        self.planes = [p[which] for p in self.planes]
        self.over = self.over[which]


def near(diff, shape, radius: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and lanes within the radius. diff(b, which): plane b of the differences of the words ``which``."""
    which, counters = np.arange(shape), Counters(shape, radius)
    for b in range(0, 63, 3):
        counters.add3(diff(b, which), diff(b + 1, which), diff(b + 2, which))
        if b % 12 == 9:  # abandon words that are all beyond
            stay = (live & ~counters.beyond()) != 0
            if not stay.any():
                return which[:0], live[:0]
            if stay.mean() < 0.7:
                which, live = which[stay], live[stay]
                counters.keep(stay)
    counters.add1(diff(63, which))
    return which, live & ~counters.beyond()


def lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of set bits: (word, lane)."""
    some = np.flatnonzero(words)
    bits = np.unpackbits(np.ascontiguousarray(words[some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, lane = np.nonzero(bits)
    return some[w], lane


class Forest:
    """Trees over a task's fingerprints, to keep only links that join two of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            new = root[a] != root[b]
            a, b = a[new], b[new]
            if not len(a):
                return
            # hook each higher root under one lower root, then flatten
            high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            _, first = np.unique(high, return_index=True)
            self.kept += zip(a[first].tolist(), b[first].tolist())
            root[high[first]] = low[first]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def links(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links between fingerprints of the same key (keys sorted), as places in the arrays."""
    n = len(fps)
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, dtype=int)
    size = np.diff(np.r_[begin, n])
    forest = Forest(n)
    group = np.repeat(np.arange(len(begin)), size)
    small = np.flatnonzero((size[group] > 1) & (size[group] <= SMALL))
    if len(small):
        f, g = fps[small], group[small]
        own = planes(f)
        for lag in range(1, min(SMALL, int(size[size <= SMALL].max()))):
            same = np.flatnonzero(g[lag:] == g[:-lag])
            if not len(same):
                break
            if len(same) < len(f) // 8:  # few are left: set them side by side
                left, right, live = planes(f[same]), planes(f[same + lag]), same
            else:
                left, right, live = own, planes(f[lag:]), np.arange(len(f) - lag)
            ok = np.zeros(-(-len(live) // 64) * 64, dtype=np.uint8)
            ok[: len(live)] = g[live] == g[live + lag]
            ok = np.packbits(ok, bitorder="little").view("<u8")
            w, got = near(lambda b, k, x=left, y=right: x[b][k] ^ y[b][k], len(ok), radius, ok)
            i, lane = lanes(got)
            at = live[w[i] * 64 + lane]
            forest.link(small[at], small[at + lag])
    for s, m in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
        f = fps[s : s + m]
        own = planes(f)
        wide = own.shape[1]
        full = np.packbits(np.r_[np.ones(m, np.uint8), np.zeros(wide * 64 - m, np.uint8)], bitorder="little").view("<u8")
        step = max(1, (1 << 17) // wide)
        for q in range(0, m, step):
            asked = f[q : q + step]
            # a row of words for each fingerprint asked about, flat
            bits = [np.where(asked >> np.uint64(b) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)) for b in range(64)]
            w, got = near(lambda b, k, bits=bits: own[b][k % wide] ^ bits[b][k // wide], len(asked) * wide, radius, np.tile(full, len(asked)))
            i, lane = lanes(got)
            a, c = q + w[i] // wide, w[i] % wide * 64 + lane
            forest.link(s + a[a < c], s + c[a < c])
    return forest.kept


def choices(radius: int, agree: int) -> list[tuple[int, ...]]:
    """For each choice of ``agree`` of radius + agree blocks of the 64 bits, the mask of its bits."""
    edges = np.linspace(0, 64, radius + agree + 1).round().astype(int)
    block = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in c) for c in combinations(range(radius + agree), agree)]


def near_links(fps: DataFrame, radius: int, agree: int) -> DataFrame:
    """Rows (a, b): links that keep the components of all links between distinct fingerprints (s, fp) of the same s."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in choices(radius, agree)]

    def keyed(batches):
        for pdf in batches:
            s, fp = pdf["s"].to_numpy(), pdf["fp"].to_numpy()
            for t, m in enumerate(masks):
                yield pd.DataFrame({"t": (s * len(masks) + t).astype(np.int32), "key": fp & np.int64(m), "fp": fp})

    def compare(batches):
        # a task has whole keys; what it holds are 20 bytes a row
        got = [(p["t"].to_numpy(), p["key"].to_numpy(), p["fp"].to_numpy()) for p in batches]
        if not got:
            return
        t, key, fp = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((fp, key, t))
        t, key, fp = t[order], key[order], fp[order]
        change = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])] if len(t) else np.zeros(0, bool)
        pairs = links(np.cumsum(change), fp.view(np.uint64), radius)
        if pairs:
            a, b = np.array(pairs).T
            yield pd.DataFrame({"a": fp[a], "b": fp[b]})

    rows = fps.select("s", "fp").mapInPandas(keyed, "t int, key long, fp long")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "t", "key").mapInPandas(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, keys: list[str], text_col: str = "text", words: int = 3, radius: int = 2, agree: int = 4, distinct: bool = False, how_many: int = 1) -> DataFrame:
    """The columns ``keys``, fp, and first, one row per row of ``docs``.

    With ``how_many`` fingerprints of a text, two texts link if any of them do.

    first is the least (is the first key null, *keys) of the row's group, as a struct.
    """
    made = materialize(fingerprints(docs, keys, text_col, words, distinct, how_many), "fingerprints")
    names = ["fp", *(f"fp{k}" for k in range(1, how_many))]
    rank = F.struct(F.col(keys[0]).isNull().alias("null"), *keys)
    single = materialize(made.groupBy(*names).agg(F.min(rank).alias("low")), "distinct-fingerprints")
    nodes = single.select(F.explode(F.array(*(F.struct(F.lit(k).alias("s"), F.col(c).alias("fp")) for k, c in enumerate(names)))).alias("n")).select("n.*").distinct()
    edges = near_links(nodes, radius, agree)
    if how_many > 1:  # a text's further fingerprints that have links, or several first ones, lead to its first
        edges = materialize(edges, "near-links")
        linked = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct()
        for c in names[1:]:
            shared = single.groupBy(F.col(c).alias("n")).agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("n")
            edges = edges.unionByName(single.join(linked.union(shared).distinct(), F.col(c) == F.col("n"), "left_semi").select(F.col("fp").alias("a"), F.col(c).alias("b")))
    roots = components(edges)
    labelled = materialize(single.groupBy("fp").agg(F.min("low").alias("low")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    lowest = labelled.groupBy("root").agg(F.min("low").alias("first"))
    # many fingerprints may have one root, and many rows one fingerprint
    firsts = spread(labelled, lowest, ["root"], F.col("fp")).select("fp", "first")
    return spread(made, firsts, ["fp"], F.xxhash64(*keys)).select(*keys, "fp", "first")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, agree: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of ``docs``: component_id is the smallest id of the row's group."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return near_groups(rows, ["doc_id"], "text", words, radius, agree).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


# --- near copies ------------------------------------------------------------------------------------------------------

#: MinHash keys of a text: two of similarity j share one with probability 1 - (1 - j ** ROWS) ** BANDS, 0.9993 at 0.8.
BANDS, ROWS = 24, 6
#: Nodes of a bucket that are held against the others: one in the first round, and so many times as many in each round that follows.
GROWTH = 16
#: Nodes that a tile holds others against, and the number of others that a tile has in the mean.
TILE, TILE_ROWS = 16, 2048
_A, _B = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def band_keys(units: list[bytes]) -> list[int]:
    """A key for each band of the least hashes of distinct shingles, as signed longs; none without a shingle."""
    if not units:
        return []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, units), dtype=np.uint64, count=len(units))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[i : i + (1 << 12)] * _A + _B).min(1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def signatures(plain: DataFrame, words: int, how_many: int) -> DataFrame:
    """The columns i and k of ``plain`` (i, k, text), a digest d of the words, the fingerprints of distinct shingles, and their band keys."""
    names = ["fp", *(f"fp{k}" for k in range(1, how_many))]

    def run(batches):
        for pdf, xs in texts(batches):
            fps = np.array([all_fingerprints(x, words, True, how_many) for x in xs], dtype=np.uint64).reshape(-1, how_many)
            out = pdf[["i", "k"]].assign(d=[xxhash.xxh3_128_digest(b" ".join(x.encode().lower().split())) for x in xs])
            yield out.assign(**{c: np.ascontiguousarray(fps[:, k]).view(np.int64) for k, c in enumerate(names)}, bands=[band_keys(list(set(shingles(x, words)))) for x in xs])

    rows = plain.select(F.col("i").cast("string").alias("i"), "k", "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("d", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in names), T.StructField("bands", T.ArrayType(T.LongType()))])
    return rows.mapInPandas(run, schema).withColumn("i", F.col("i").cast(plain.schema["i"].dataType))


class Tile:
    """Up to some texts, and which of others are copies of them: common shingles are counted for all at once."""

    def __init__(self, words: int, similarity: float):
        self.words, self.similarity = words, similarity
        self.ids: list[bytes] = []
        self.sets: list[set[bytes]] = []
        self.table = None

    def hold(self, ids: list[bytes], texts: list[str]) -> None:
        self.ids += ids
        self.sets += [set(shingles(x or "", self.words)) for x in texts]

    def _index(self) -> None:
        """The hashes of all shingles in order, where each one's holders begin, and the holders."""
        flat = np.array([(xxhash.xxh64_intdigest(u), i) for i, s in enumerate(self.sets) for u in s], dtype=np.uint64).reshape(-1, 2)
        flat = flat[np.argsort(flat[:, 0], kind="stable")]
        begin = np.flatnonzero(np.r_[True, flat[1:, 0] != flat[:-1, 0]]) if len(flat) else np.zeros(0, dtype=int)
        self.table = flat[begin, 0], np.r_[begin, len(flat)], flat[:, 1].astype(np.int64)
        self.sizes = np.array([len(s) for s in self.sets])

    def copies(self, ids: list[bytes], texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(id, held id): pairs at the similarity or above, by the shingles themselves."""
        if self.table is None:
            self._index()
        hashes, begin, holders = self.table
        out = []
        for d, x in zip(ids, texts):
            own = set(shingles(x or "", self.words))
            common = np.zeros(len(self.ids), dtype=np.int64)
            if own and len(hashes):
                mine = np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own))
                at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                at = at[hashes[at] == mine]
                many = begin[at + 1] - begin[at]
                end = np.cumsum(many)
                common = np.bincount(holders[np.repeat(begin[at] - (end - many), many) + np.arange(end[-1] if len(end) else 0)], minlength=len(self.ids))
            for i in np.flatnonzero(common >= self.similarity * (len(own) + self.sizes - common)):
                if self.ids[i] != d:
                    b = self.sets[i]
                    if (not own and not b) or len(own & b) >= self.similarity * len(own | b):
                        out.append((d, self.ids[i]))
        return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 6, agree: int = 3, how_many: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Documents of the same words are one node, led by the smallest id. Nodes meet in buckets: one for each of their ``how_many`` fingerprints of
    distinct ``words``-word shingles, one for each link of fingerprints within ``radius`` bits, and one for each MinHash key. In rounds, all nodes
    of a bucket are held against its first one, then its first GROWTH, and so on, so a bucket of n nodes takes some log n rounds. A node that was held against all before it in its buckets, and has a Jaccard
    similarity of at least ``similarity`` to none, stays; those with that similarity to it go; both leave their buckets, until
    no bucket has two nodes. So each document that goes has a copy
    that stays, and two that stay are no near copies if they share a bucket. Rows of the same id and text are one document:
    they stay or go together.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, how_many))]
    plain = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("text"))
    low = F.min(F.struct(F.col("i").isNull().alias("null"), "i", "k")).alias("low")
    nodes = materialize(signatures(plain, words, how_many).groupBy("d").agg(low, *(F.first(c).alias(c) for c in (*names, "bands"))), "near-nodes")
    m = F.struct("low.null", "low.i", "d").alias("m")
    own = F.array(*(F.struct(F.lit(-1 - k).alias("s"), F.col(c).alias("key")) for k, c in enumerate(names)))
    entry = nodes.select(F.explode(F.concat(own, F.transform("bands", lambda x, k: F.struct(k.alias("s"), x.alias("key"))))).alias("b"), m).select("b.s", "b.key", "m")
    # fingerprints that link have a bucket for the first nodes of both
    holders = materialize(entry.where("s < 0").groupBy("s", "key").agg(F.min("m").alias("m")), "near-fingerprints")
    edges = near_links(holders.select((-1 - F.col("s")).cast("int").alias("s"), F.col("key").alias("fp")), radius, agree)
    ends = edges.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp")).join(holders.select(F.col("key").alias("fp"), "m"), "fp")
    entry = entry.unionByName(ends.select(F.lit(-1 - how_many).alias("s"), "key", "m").distinct())

    def crowded(entries: DataFrame, name: str) -> DataFrame:
        """Entries of buckets with two nodes or more; a bucket may hold a large share of all."""
        several = entries.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "key")
        return materialize(spread(entries, several, ["s", "key"], F.col("m.d"), "left_semi"), name)

    written = materialize(entry, "near-entries")
    now = crowded(written, "near-buckets")
    drop_shared(written)
    mine = nodes.join(now.select(F.col("m.d").alias("d")).distinct(), "d", "left_semi").select("d", F.col("low.i").alias("i"), F.col("low.k").alias("k"))
    p, q = plain.alias("p"), mine.alias("q")
    with_text = materialize(p.join(q, F.col("p.i").eqNullSafe(F.col("q.i")) & (F.col("p.k") == F.col("q.k"))).select("d", "text").dropDuplicates(["d"]), "near-texts")

    def verify(batches):
        last, b = None, set()
        for pdf in batches:
            same = np.zeros(len(pdf), dtype=bool)
            for n, (x, y) in enumerate(zip(pdf["text"], pdf["first_text"])):
                if y != last:
                    last, b = y, set(shingles(y or "", words))
                a = set(shingles(x or "", words))
                same[n] = (not a and not b) or len(a & b) >= similarity * len(a | b)
            yield pdf.loc[same, ["d", "fd"]]

    ranks = nodes.select("d", m)

    def compared(front: DataFrame) -> DataFrame:
        """Pairs (d, fd) of copies: each node of ``now`` behind a first node of its bucket, where a bucket has one such."""
        pairs = materialize(spread(now, front.withColumnRenamed("m", "f"), ["s", "key"], F.col("m.d")).where("m > f").select(F.col("m.d").alias("d"), F.col("f.d").alias("fd")).distinct(), "near-candidates")
        # a first node's text meets those of all nodes behind it, dealt out where they are many
        t, f = with_text, with_text.select(F.col("d").alias("fd"), F.col("text").alias("first_text"))
        found = materialize(spread(pairs.join(t, "d"), f, ["fd"], F.col("d"), counted=pairs).mapInPandas(verify, "d binary, fd binary"), "near-pairs")
        drop_shared(pairs)
        return found

    def tiled(front: DataFrame) -> DataFrame:
        """The same where buckets have many first nodes: they go in tiles of TILE, and no pair that is unlike is ever a row.

        A first node is in one tile, that of the largest of its buckets, where the others of the tile are with it. A node asks
        each tile of its buckets once, however many of them it shares with it; those that ask one tile are dealt out.
        """
        home = front.groupBy("m").agg(F.max(F.struct("size", "s", "key", F.floor((F.col("n") - 1) / TILE).alias("g"))).alias("h")).select("m", F.xxhash64("h.s", "h.key", "h.g").alias("tile"))
        home = materialize(home, "near-tiles")
        tiles = front.join(home, "m").select("s", "key", "tile").distinct()
        asks = materialize(spread(now, tiles, ["s", "key"], F.col("m.d")).select("tile", F.col("m.d").alias("d")).distinct(), "near-asks")
        parts = asks.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("parts"))
        held = home.select("tile", F.col("m.d").alias("d")).join(parts, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "d")
        asking = spread(asks, parts, ["tile"], F.col("d")).select("tile", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "d")
        rows = held.unionByName(asking).join(with_text, "d")
        wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = rows.repartition(wide, "tile", "part").sortWithinPartitions("tile", "part", "kind").mapInPandas(meet, "d binary, fd binary").distinct()
        found = met.join(ranks, "d").join(ranks.withColumnsRenamed({"d": "fd", "m": "f"}), "fd").where("m > f").select("d", "fd")
        found = materialize(found, "near-pairs")
        drop_shared(home, asks)
        return found

    def meet(batches):
        key, tile = None, None
        for pdf in batches:
            for at, some in pdf.groupby(["tile", "part", "kind"], sort=True):
                if at[:2] != key:
                    key, tile = at[:2], Tile(words, similarity)
                if at[2] == 0:
                    tile.hold(some["d"].tolist(), some["text"].tolist())
                else:
                    found = tile.copies(some["d"].tolist(), some["text"].tolist())
                    if found:
                        yield pd.DataFrame(found, columns=["d", "fd"])

    lost, most = None, 1
    while not now.isEmpty():
        # the first ``most`` of each bucket: one in the first round, which ends large groups
        bucket = W.partitionBy("s", "key")
        front = materialize(now.withColumn("n", F.row_number().over(bucket.orderBy("m"))).withColumn("size", F.count(F.lit(1)).over(bucket)).where(F.col("n") <= most), "near-front")
        found = compared(front.drop("n", "size")) if most == 1 else tiled(front)
        behind = now.join(front, ["s", "key", "m"], "left_anti").select(F.col("m.d").alias("d"))
        stays = materialize(front.select(F.col("m.d").alias("d")).distinct().join(behind.unionByName(found.select("d")).distinct(), "d", "left_anti"), "near-first")
        gone = materialize(spread(found, stays.select(F.col("d").alias("fd")), ["fd"], F.col("d"), "left_semi").select("d").distinct(), "near-gone")
        lost = gone if lost is None else lost.unionByName(gone)
        rest = materialize(now.join(stays.unionByName(gone), F.col("m.d") == F.col("d"), "left_anti"), "near-rest")
        drop_shared(now, front, found)
        now = crowded(rest, "near-buckets")
        drop_shared(rest, stays)
        most *= GROWTH
    kept = nodes if lost is None else nodes.join(lost, "d", "left_anti")
    i, k = fresh("i", docs), fresh("k", docs)
    g = kept.select(F.col("low.i").alias(i), F.col("low.k").alias(k)).alias("g")
    rows = docs.withColumn(k, F.xxhash64(F.col(text_col))).alias("r")
    return rows.join(g, F.col(f"r.`{id_col}`").eqNullSafe(F.col(f"g.{i}")) & (F.col(f"r.{k}") == F.col(f"g.{k}")), "left_semi").select(*(F.col(f"r.`{c}`") for c in docs.columns))
