"""Text quality by naive Bayes support vectors (NBSVM).

A text becomes the set of its n-grams, as indicators: word unigrams and bigrams, and one- to three-grams of word shapes. A
shape is a word with runs of letters as one letter, runs of digits as one digit, other characters as they are in runs of
one, and "=" where the word is that before; so a table, a stutter or a row of marks shows whatever the words are.
Indicators are hashed to ``2 ** bits`` places and scaled by the log-count ratio of the classes; on that a linear hinge-loss
model is fitted by dual coordinate descent, interpolated with its mean weight, and its margin is turned into a
probability by logistic calibration on rows that the fit has not seen.

Fitted on a bounded sample: at most ``sample`` labelled rows, those with the smallest hash of their id, one text of each id. All rows
are scored, over whole texts.

Defined cases: null text counts as empty; an empty text has only the bias and a score like any other; rows without a label
are scored only; an id with several labels counts with each; with no labelled row, or labels of one class, the score is the share
of label 1 (0.5 with none).
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import EXAMPLE_CHARS, SAMPLE_CHARS, examples

BITS, SAMPLE = 18, 12_000
_MIX = np.uint32(0x9E3779B1)


def shape(word: str) -> str:
    if word[:-1].isalpha():
        return "a" + word[-1]
    return "".join(k for k, _ in groupby("a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def hashed(x: str) -> int:
    return xxhash.xxh32_intdigest(x)


PLAIN, AGAIN = hashed("\0a"), hashed("\0=")


def joined(*hashes: np.ndarray) -> np.ndarray:
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint32(15))) * _MIX + h
    return out ^ (out >> np.uint32(16))


def places(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct hashed places of a text's n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    w = np.fromiter(map(hashed, words), dtype=np.uint32, count=len(words))
    s = np.fromiter((PLAIN if x.isalpha() else hashed("\0" + shape(x)) for x in words), dtype=np.uint32, count=len(words))
    s[1:][w[1:] == w[:-1]] = AGAIN
    grams = np.concatenate([w, joined(w[:-1], w[1:]), s, joined(s[:-1], s[1:]), joined(s[:-2], s[1:-1], s[2:])])
    return np.unique(grams & np.uint32((1 << bits) - 1)).astype(np.int32)


class Model:
    """weights over places, bias, and the line that turns a margin into log-odds."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, bits: int = BITS):
        self.weights, self.bias, self.slope, self.offset, self.bits = weights.astype(np.float32), bias, slope, offset, bits

    def margin(self, x: np.ndarray) -> float:
        # over the square root of the number of indicators: long texts have no louder voice
        return float(self.weights[x].sum(dtype=np.float64)) / math.sqrt(len(x) + 1) + self.bias

    def score(self, text: str) -> float:
        z = self.slope * self.margin(places(text, self.bits)) + self.offset
        return 1 / (1 + math.exp(-min(max(z, -60.0), 60.0)))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, y in zip(rows, labels):
        (p if y else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, c: float, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss model, by dual coordinate descent in random order."""
    w, b, y = np.zeros(size), 0.0, np.where(labels, 1.0, -1.0)
    cost = c * np.where(labels, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    a, norm = np.zeros(len(rows)), np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + b) - 1
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                moved = max(moved, abs(step))
                w[x] += step * v
                b += step
                a[i] = new
        if moved < 1e-4:
            break
    return w, b


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic line through margins, by damped Newton steps, with a weak pull to slope 1."""
    t, at = labels.astype(float), np.array([1.0, 0.0])
    pull = np.array([0.1, 0.1])

    def loss(x: np.ndarray) -> float:
        z = x[0] * margins + x[1]
        return float(np.logaddexp(0, z).sum() - t @ z + 0.5 * (pull * (x - [1.0, 0.0]) ** 2).sum())

    now = loss(at)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -40, 40)))
        h = p * (1 - p)
        gradient = np.array([(p - t) @ margins, (p - t).sum()]) + pull * (at - [1.0, 0.0])
        step = np.linalg.solve(np.array([[h @ margins**2, h @ margins], [h @ margins, h.sum()]]) + np.diag(pull), gradient)
        while (new := loss(at - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        at, gain, now = at - step, now - new, new
        if gain < 1e-9:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(sample: list[str], labels: np.ndarray, bits: int = BITS, c: float = 0.1, mix: float = 0.75) -> Model:
    size, labels = 1 << bits, np.asarray(labels, dtype=bool)
    if len(labels) == 0 or labels.all() or not labels.any():
        p = labels.mean() if len(labels) else 0.5
        return Model(np.zeros(size), 0.0, 1.0, math.log((p + 1e-6) / (1 - p + 1e-6)), bits)
    rows = [places(x, bits) for x in sample]
    aside = np.arange(len(rows)) % 5 == 4  # rows for the calibration

    def one(which: np.ndarray) -> Model:
        some = [rows[i] for i in which]
        ratio = log_count_ratio(some, labels[which], size)
        values = [ratio[x] / math.sqrt(len(x) + 1) for x in some]
        w, b = dual_descent(some, values, labels[which], size, c)
        seen = w != 0
        if seen.any():  # towards the mean weight, which is naive Bayes
            w[seen] = (1 - mix) * np.abs(w[seen]).mean() + mix * w[seen]
        return Model(w * ratio, b, 1.0, 0.0, bits)

    held = np.flatnonzero(aside)
    if labels[held].all() or not labels[held].any() or labels[~aside].all() or not labels[~aside].any():
        model = one(np.arange(len(rows)))
        margins = np.array([model.margin(x) for x in rows])
        model.slope, model.offset = calibrate(margins, labels)
        return model
    part = one(np.flatnonzero(~aside))
    slope, offset = calibrate(np.array([part.margin(rows[i]) for i in held]), labels[held])
    part.slope, part.offset = slope, offset
    return part


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str, text_col: str, sample: int, chars: int = SAMPLE_CHARS, longest: int = EXAMPLE_CHARS) -> pd.DataFrame:
    """At most ``sample`` rows (text, label): the labelled rows for which ``learn`` holds with the smallest hashes.

    They have ``chars`` characters at most, and none has more than ``longest``.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null and id is not null").where(learn)
    some = known.select(F.xxhash64("id", F.lit(17)).alias("h"), "id", "label").orderBy("h", "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return examples(rows, some, chars, longest).select("h", "id", "label", F.coalesce("text", F.lit("")).alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS, threshold: float = 0.3, whole_rows: bool = False, chars: int = SAMPLE_CHARS, longest: int = EXAMPLE_CHARS) -> DataFrame:
    """Rows (doc_id, score, predicted), one per row of ``docs``. ``learn``: a condition on the column id of labelled rows.

    The model is fitted on at most ``sample`` labelled rows of at most ``chars`` characters in all, none of more than ``longest``.
    With ``whole_rows`` a struct ``kept`` holds all columns of the row.
    """
    spark = docs.sparkSession
    train = training_rows(docs, labels, learn, label_col, id_col, text_col, sample, chars, longest)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "label", "text"])
        m = fit(pdf["text"].tolist(), pdf["label"].to_numpy() == 1, bits)
        some = np.flatnonzero(m.weights).astype("<i4")
        return pd.DataFrame({"place": [some.tobytes()], "weight": [m.weights[some].astype("<f4").tobytes()], "line": [[m.bias, m.slope, m.offset]]})

    # the bounded sample is fitted in one task; the driver only passes the weights on
    got = train.groupBy(F.lit(1).alias("one")).applyInPandas(fitted, "place binary, weight binary, line array<double>").first()
    if got is None:
        model = fit([], np.zeros(0), bits)
    else:
        w = np.zeros(1 << bits, dtype=np.float32)
        w[np.frombuffer(got["place"], "<i4")] = np.frombuffer(got["weight"], "<f4")
        model = Model(w, *got["line"], bits)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t or "") for t in x], dtype=np.float64)

    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept")] if whole_rows else []
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col).cast("string")).alias("score"), *kept)
    return rows.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *(["kept"] if whole_rows else []))
