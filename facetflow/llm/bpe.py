"""Byte-pair token counts by a heap and a linked list.

A text is cut into the pieces that the tokenizer's pattern gives. A piece starts as its bytes, one symbol each, in a
doubly linked list; the heap holds the rank of each adjacent pair that can merge. The lowest rank is popped (leftmost on
ties), its two symbols become one, and the new neighbours are pushed; a stale entry is skipped. The number of tokens is
the number of initial symbols less the number of merges; no identifiers come out.

Words repeat, so counts are kept by chunk: a text is first cut before each single space between two visible
characters. Such a place always parts two pieces of the pattern, so a chunk's count does not hang on its neighbours.

Defined cases: null text counts as empty; an empty text has 0 tokens; the strings of special tokens inside a text are one
token each, as the library has it by default; texts are never cut short.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import texts

#: The pattern that parts a text before any merge (a fixed value of the vocabulary file's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Chunks that a worker keeps in each of two generations.
KEPT = 600_000

_ODD = re.compile(r"[^\S \n]")
_UNSAFE = re.compile(r" \s|\s ")
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def vocabulary_path(name: str) -> str:
    """``name`` if it is a path, else the file of that name among the public tokenizers of the machine that asks."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def unsafe(text: str) -> bool:
    """Whether some white space stands next to a space, so that cutting at each space could cut inside a piece."""
    return "  " in text or " \n" in text or "\n " in text or (_ODD.search(text) is not None and _UNSAFE.search(text) is not None)


def chunks(text: str) -> list[str]:
    """``text`` cut at each single space that stands between two visible characters; those spaces are left out."""
    if unsafe(text):
        first, *rest = _BETWEEN.split(text)
        return [first, *(x[1:] for x in rest)]
    return text.split(" ")


def cut(tails: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at every space: the chunks' codes, each text's first place among them (and the end), the distinct chunks."""
    lists = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
    codes = lists.flatten().dictionary_encode()
    return codes.indices.to_numpy(), lists.offsets.to_numpy(), codes.dictionary.to_pylist()


class Kept:
    """What ``make`` gives for each chunk, with the results for short chunks kept.

    Two generations: when the young one is full it becomes the old one, so memory has a bound and frequent chunks stay.
    """

    def __init__(self, make, most: int = KEPT):
        self.make, self.most = make, most
        self.young: dict = {}
        self.old: dict = {}

    def miss(self, chunk: str):
        x = self.young.get(chunk)
        if x is None:
            x = self.old.get(chunk)
            if x is None:
                x = self.make(" " + chunk)
            if len(chunk) < 48:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[chunk] = x
        return x

    def all(self, rest: list[str]) -> list:
        """For chunks that follow a space."""
        miss = self.miss
        return [miss(c) if x is None else x for c, x in zip(rest, map(self.young.get, rest))]

    def text(self, text: str) -> list:
        first, *rest = chunks(text)
        return [self.make(first), *self.all(rest)]


def parts(xs: list[str], mb: int = 32):
    """Lists of texts of some MB each."""
    some, size = [], 0
    for x in xs:
        some.append(x)
        size += len(x)
        if size > mb << 20:
            yield some
            some, size = [], 0
    if some:
        yield some


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [names[b] for b in range(256)]


def checked(spec: dict) -> dict:
    """The content of a vocabulary file, if it is of the kind that PATTERN and the merges here reproduce."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    model = spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
    flags = [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or not plain or odd or flags:
        raise ValueError(f"a vocabulary of another kind than plain byte-level BPE: {model.get('type')}, {spec.get('normalizer')}, {before}, {odd}, {flags}")
    return spec


def pair_key(left: int, right: int) -> int:
    return left << 20 | right


class Counter:
    """Counts tokens for one vocabulary file (.json of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for c in byte_symbols()]
        #: (left, right) in one number -> (rank, what they become) in one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(pair_key(vocab[a], vocab[b]), rank << 20 | vocab[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.kept = Kept(self.chunk_count)

    def merge_count(self, symbols: list[int]) -> int:
        """How many merges a list of symbols undergoes; what a merge takes up is -1 in it afterwards."""
        find, n = self.merges.get, len(symbols)
        heap = [v >> 20 << 40 | i for i, v in enumerate(map(find, map(pair_key, symbols, symbols[1:]))) if v is not None]
        if not heap:
            return 0
        heapify(heap)
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j >= n:
                continue
            v = find(left << 20 | symbols[j])
            if v is None or v >> 20 != entry >> 40:
                continue
            symbols[i] = new = v & 0xFFFFF
            symbols[j] = -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                v = find(new << 20 | symbols[k])
                if v is not None:
                    heappush(heap, v >> 20 << 40 | i)
            h = before[i]
            if h >= 0:
                v = find(symbols[h] << 20 | new)
                if v is not None:
                    heappush(heap, v >> 20 << 40 | h)
        return done

    def symbols(self, piece: str) -> list[int]:
        """What a piece's symbols become."""
        symbols = [self.first[b] for b in piece.encode()]
        self.merge_count(symbols)
        return [s for s in symbols if s >= 0]

    def chunk_count(self, chunk: str) -> int:
        total, first = 0, self.first
        for piece in self.pieces(chunk):
            symbols = [first[b] for b in piece.encode()]
            total += len(symbols) - self.merge_count(symbols)
        return total

    def plain(self, text: str) -> int:
        return sum(self.kept.text(text)) if text else 0

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def counts(self, xs: list[str]) -> np.ndarray:
        out, whole, tails = np.zeros(len(xs), dtype=np.int64), [], []
        for i, x in enumerate(xs):
            if " " not in x or unsafe(x) or (self.special is not None and self.special.search(x)):
                out[i] = self.count(x)
            else:
                head, _, tail = x.partition(" ")
                out[i] = self.chunk_count(head)
                whole.append(i)
                tails.append(tail)
        if whole:
            codes, starts, distinct = cut(tails)
            n = np.array(self.kept.all(distinct), dtype=np.int64)[codes]
            out[whole] += np.add.reduceat(n, starts[:-1])
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of ``docs``."""

    def run(batches):
        c = counter(vocabulary_path(vocabulary))
        for pdf, xs in texts(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(x.encode()) for x in xs], "n_tokens": np.concatenate([c.counts(p) for p in parts(xs)] or [np.zeros(0, np.int64)])})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumn("over_limit", F.col("n_tokens") > limit)
