"""Alignment of two tokenizers' tokens by a galloping intersection of their ends.

A text, with a space before it, is cut into tokens by a byte-level vocabulary (A) and a piece vocabulary (B). Both lists of ends
rise. The shorter one drives: for each of its ends the longer list is searched from the last place on, first in doubling steps
and then by halving. The ends that both have cut the tokens into groups. The ranks of a token's start and end among
the other list's ends give the range of tokens that overlap it; each such pair is a link.

Words repeat. At a single space between two visible characters both tokenizers always end a token (B holds no piece with a
space behind another character, which is checked), so texts fall into chunks there, and a chunk's tokens are found and
aligned once and kept in a store of bounded size. New chunks of a batch are tokenized and aligned together, as one text.

A document's distinct links are written once, with the number of times it holds each; documents are counted by link, and
the counts joined back: by a broadcast while there are at most ``most`` links in all, else by a shuffle that deals common
links out.

Defined cases: a text that is null or empty, or whose tokens' bytes differ from its own (such as one that holds U+2581), has no
tokens: zeros and ''. Repeated rows are documents of their own. Strings of special tokens are plain text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from facetflow.llm import bpe
from facetflow.llm.common import materialize, spread

#: Chunks that a worker keeps; characters of texts, and of new chunks, that are handled at a time.
KEPT, PART, SEGMENT = 300_000, 8 << 20, 1 << 16
#: Links with their counts that are broadcast.
MOST = 4_000_000

_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """The places in both rising lists of what they have in common."""
    mine, theirs, at, n = [], [], 0, len(long)
    for i, x in enumerate(short):
        probe, step = at, 1
        while probe < n and long[probe] < x:  # doubling steps
            at, probe = probe + 1, probe + step
            step *= 2
        at = bisect_left(long, x, at, min(probe, n))
        if at == n:
            break
        if long[at] == x:
            mine.append(i)
            theirs.append(at)
            at += 1
    return mine, theirs


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    if len(a) <= len(b):
        return gallop(a, b)
    theirs, mine = gallop(b, a)
    return mine, theirs


class Tokenizers:
    """Both vocabularies, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = bpe.checked(json.load(f))
        back = {c: b for b, c in enumerate(bpe.byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        made = [spec["model"]["vocab"]["".join(p if isinstance(p, list) else p.split(" "))] for p in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("a vocabulary whose ids do not rise with the ranks of its merges")
        self.a = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.bytes_a[i] = x
        sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a vocabulary with pieces that hold a space behind another character")
        self.b = lambda text: sp.encode(text, num_threads=1)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.shift = len(self.bytes_b).bit_length()
        self.bits = self.shift + len(self.bytes_a).bit_length()

    def both(self, text: str) -> tuple[list[int], list[int]] | None:
        """The tokens of space + text; None where their bytes are not its own."""
        whole = b" " + text.encode()
        a, b = self.a(" " + text), self.b(text)
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return a, b


class Store:
    """What chunks' tokens come to, by chunk: their numbers, the text of their groups, their links."""

    COLUMNS = ("fine", "a", "b", "groups", "first", "last")

    def __init__(self, tokenizers: Tokenizers, most: int = KEPT):
        self.tokenizers, self.most = tokenizers, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.parts: list[np.ndarray] = []
        self.link_parts: list[np.ndarray] = []
        self.columns, self.links, self.n_links = np.zeros((len(self.COLUMNS), 0), np.int64), np.zeros(0, np.int64), 0

    def add(self, chunks: list[str]) -> None:
        """New chunks; those without white space at their ends are aligned together, as one text."""
        segment, size = [], 0
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace() or "▁" in c:
                self._align([c])
                continue
            segment.append(c)
            size += len(c)
            if size >= SEGMENT:
                self._align(segment)
                segment, size = [], 0
        if segment:
            self._align(segment)
        if self.parts:
            self.columns = np.concatenate([self.columns, *self.parts], axis=1)
            self.links = np.concatenate([self.links, *self.link_parts])
            self.parts, self.link_parts = [], []

    def _align(self, segment: list[str]) -> None:
        tk, n = self.tokenizers, len(segment)
        tokens = tk.both(" ".join(segment))
        if tokens is None and n > 1:
            for c in segment:
                self._align([c])
            return
        rows = np.zeros((len(self.COLUMNS), n), dtype=np.int64)
        texts = [""] * n
        if tokens is not None:
            ids_a, ids_b = tokens
            a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
            end_a, end_b = np.cumsum(tk.size_a[a]), np.cumsum(tk.size_b[b])
            at_a, at_b = common_ends(end_a.tolist(), end_b.tolist())
            # the tokens of B that overlap each of A: from the rank of its start to that of its end
            low = np.searchsorted(end_b, end_a - tk.size_a[a], "right")
            many = np.searchsorted(end_b, end_a, "left") - low + 1
            link_end = np.cumsum(many)
            other = np.repeat(low - (link_end - many), many) + np.arange(link_end[-1] if len(many) else 0)
            self.link_parts.append(np.repeat(a, many) << tk.shift | b[other])
            name_a, name_b = list(map(str, ids_a)), list(map(str, ids_b))
            groups, i, j = [], 0, 0
            for x, y in zip(at_a, at_b):
                groups.append(",".join(name_a[i : x + 1]) + "|" + ",".join(name_b[j : y + 1]))
                i, j = x + 1, y + 1
            # where each chunk ends among the tokens, the groups and the links
            stop = np.cumsum([len(c.encode()) + 1 for c in segment])
            to_a, to_b, to_g = (np.searchsorted(x, stop, "right") for x in (end_a, end_b, end_a[at_a]))
            to_link = self.n_links + link_end[to_a - 1]
            rows[0] = 1
            for k, x in enumerate((to_a, to_b, to_g)):
                rows[k + 1] = np.diff(x, prepend=0)
            rows[4], rows[5] = np.r_[self.n_links, to_link[:-1]], to_link
            self.n_links += int(link_end[-1])
            cut = [0, *to_g.tolist()]
            texts = [";".join(groups[x:y]) for x, y in zip(cut, cut[1:])]
        self.parts.append(rows)
        for c, x in zip(segment, texts):
            self.place[c] = len(self.text)
            self.text.append(x)

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where the distinct chunks stand; when too many are held, all others go first."""
        new = [c for c in chunks if c not in self.place]
        if new and len(self.text) + len(new) > self.most:
            self.clear()
            new = chunks
        self.add(new)
        return np.fromiter(map(self.place.__getitem__, chunks), dtype=np.int64, count=len(chunks))


@lru_cache(maxsize=2)
def store(path_a: str, path_b: str) -> Store:
    return Store(Tokenizers(path_a, path_b))


def _cut_between(text: str) -> list[str]:
    """``text`` cut at each single space between two visible characters; those spaces are left out."""
    first, *rest = _BETWEEN.split(text)
    return [first, *(x[1:] for x in rest)]


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts (none empty) in chunks: the chunks' codes, each text's first place among them (and the end), the distinct chunks."""
    odd = [x[0].isspace() or x[-1].isspace() or bpe.unsafe(x) for x in texts]
    if not any(odd):
        return bpe.cut(texts)
    lists = [_cut_between(x) if o else x.split(" ") for x, o in zip(texts, odd)]
    codes = pa.array([c for some in lists for c in some], pa.large_string()).dictionary_encode()
    return codes.indices.to_numpy(), np.cumsum([0, *map(len, lists)]), codes.dictionary.to_pylist()


FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(s: Store, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[np.ndarray], list[np.ndarray]]:
    """Of texts (none empty): the numbers (FIELDS), the digests of their groups, their distinct links, how often they hold each."""
    codes, starts, distinct = cut(texts)
    place = s.places(distinct)
    column = dict(zip(s.COLUMNS, s.columns[:, place]))
    n_links = column["last"] - column["first"]
    fine = np.minimum.reduceat(column["fine"][codes], starts[:-1]) > 0
    numbers = [np.where(fine, np.add.reduceat(x[codes], starts[:-1]), 0) for x in (column["a"], column["b"], column["groups"], n_links)]
    names = np.array([s.text[p] for p in place.tolist()], dtype=object)
    digests, keys, times = [], [], []
    for i, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        own = codes[x:y]
        if not fine[i]:
            digests.append("")
            keys.append(np.zeros(0, np.int64))
            times.append(np.zeros(0, np.int64))
            continue
        digests.append(hashlib.sha256(";".join(names[own].tolist()).encode()).hexdigest())
        chunk, often = np.unique(own, return_counts=True)
        many = n_links[chunk]
        end = np.cumsum(many)
        at = np.repeat(column["first"][chunk] - (end - many), many) + np.arange(end[-1])
        key, back = np.unique(s.links[at], return_inverse=True)
        keys.append(key)
        times.append(np.bincount(back, weights=np.repeat(often, many), minlength=len(key)).astype(np.int64))
    return numbers, digests, keys, times


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model", most: int = MOST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType
    numbers = [T.StructField(c, T.LongType()) for c in FIELDS]
    schema = T.StructType([T.StructField("doc_id", kind), *numbers, T.StructField("groups_sha256", T.StringType()), T.StructField("held", T.ArrayType(T.LongType()))])
    paths = lambda: (bpe.vocabulary_path(vocabulary_a), bpe.vocabulary_path(vocabulary_b))
    both = Tokenizers(*paths())
    shift_b, room = both.shift, 63 - both.bits  # a held link: its ids and, in the lowest bits, how often

    def run(batches):
        s = store(*paths())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            none = np.flatnonzero(size == 0)
            parts = [np.zeros(0, np.int64)] if len(none) else []
            full = np.flatnonzero(size > 0)
            if len(full):
                parts += [x for x in np.split(full, np.flatnonzero(np.diff(np.cumsum(size[full]) // PART)) + 1) if len(x)]
            for rows in parts:
                if len(rows):
                    counts, digests, keys, times = aligned(s, texts.take(pa.array(rows)).to_pylist())
                else:
                    rows = none
                    counts, digests, keys, times = [np.zeros(len(rows), np.int64)] * 4, [""] * len(rows), [], []
                sizes = [len(k) for k in keys] or [0] * len(rows)
                flat = np.concatenate([np.zeros(0, np.int64), *(k << room | t for k, t in zip(keys, times))])
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *map(pa.array, counts), pa.array(digests, pa.string()), held], names=schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "links")
    one = made.select("rid", F.explode("held").alias("x")).select("rid", F.shiftright("x", room).alias("link"), F.col("x").bitwiseAND((1 << room) - 1).alias("times"))
    counted = one.groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(W.partitionBy(F.shiftright("link", shift_b)))  # a row for each token of B beside one of A
    counts = materialize(counted.withColumn("best", (F.col("n") == top).cast("long")), "link-counts")
    joined = one.join(F.broadcast(counts), "link") if counts.count() <= most else spread(one, counts, ["link"], F.col("rid"))
    sums = joined.groupBy("rid").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return made.drop("held").join(sums, "rid", "left").select("doc_id", *FIELDS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
