"""Hard negatives by angular triangle filtering.

Vectors are scaled to whole numbers. Each row is stored with its norm and its angles to a few reference directions. For an anchor
a, a row y and a reference r the angle between a and y is at least |angle(a, r) - angle(y, r)|, and at most the sum of both or
what the sum lacks of a full turn. So for each reference the cosine of a and y lies in an interval, and the product with both
norms, widened by more than all rounding, bounds their score. Only rows whose interval, over all references, overlaps a window of scores
that can still change the result are scored, in whole numbers.

Positives: the window is all that is not below the anchor's k-th best score so far. Negatives: an anchor has a window for each
positive, from ``low`` to ``high`` percent of its score, and its lower end rises to the k-th best score found in it.

Anchors go in blocks of ``block``, rows in slices that are dealt out evenly whatever they hold; each block meets each slice in
one task, which holds the block and what it has found, and sees the slice row batch by row batch. So a task's memory has a bound,
no anchor, label or vector gathers rows in one task, and each task gives ``k`` rows a window at most to the last merge.
References are the principal directions of a bounded sample; every row is stored.

Defined cases: rows take no part whose id, label or vector is null, whose vector holds null or non-finite components or is of
another length than most; of an id's rows the one with the least label and vector counts; ties go to the smaller id; fewer
candidates give what there is; a window of a score below 0 is empty; scores beyond a long are given as the largest or smallest
one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import drop_shared, materialize

#: Reference directions, and the rows of the sample that they come from.
REFERENCES, SAMPLE = 8, 4096
#: Anchors of a block, and the rows that a slice has at least in the mean.
BLOCK, SLICE = 8192, 2048
#: Share of the product of norms by which bounds are widened.
SLACK = 1e-7
LONG = 2**63 - 1


def participants(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v): rows that take part, one an id, of any length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, v).alias("v")).where("id is not null and label is not null and v is not null")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0.0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1))


def principal(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n unit directions in which a sample's rows vary most."""
    size = norms(x)
    x = x[size > 0] / size[size > 0, None]
    _, vectors = np.linalg.eigh(x.T @ x) if len(x) else (None, np.eye(x.shape[1]))
    return np.ascontiguousarray(vectors[:, ::-1][:, :n].T)


def angles(x: np.ndarray, size: np.ndarray, references: np.ndarray) -> np.ndarray:
    """(rows, references)."""
    return np.arccos(np.clip((x / np.where(size > 0, size, 1.0)[:, None]) @ references.T, -1.0, 1.0))


def bounds(size: float, angle: np.ndarray, sizes: np.ndarray, cosines: np.ndarray, sines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that rows can have with an anchor; cosines and sines of their angles: (references, rows)."""
    x, y = np.cos(angle)[:, None] * cosines, np.sin(angle)[:, None] * sines
    both = size * sizes
    slack = SLACK * both + 1
    return both * (x - y).max(axis=0, initial=-1.0) - slack, both * (x + y).min(axis=0, initial=1.0) + slack


class Block:
    """The anchors of a task, their windows, and the best of each window so far."""

    def __init__(self, k: int, same: bool, kind: str, exact: bool):
        self.k, self.same, self.kind, self.exact = k, same, kind, exact
        self.id, self.label, self.size, self.angle, self.data, self.windows = [], [], [], [], [], []
        self.ready = False

    def anchors(self, pdf: pd.DataFrame) -> None:
        self.id += pdf["id"].tolist()
        self.label += pdf["label"].tolist()
        self.size += pdf["size"].tolist()
        self.angle += [np.frombuffer(x) for x in pdf["angles"]]
        self.data += [self._whole(np.frombuffer(x, dtype=self.kind)) for x in pdf["data"]]
        self.windows += [[(int(x), int(y)) for x, y in zip(w[::2], w[1::2])] or [(-np.inf, np.inf)] for w in pdf["windows"]]

    def _whole(self, x: np.ndarray) -> np.ndarray:
        return x if self.exact else np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)

    def rows(self, pdf: pd.DataFrame) -> None:
        if not self.ready:  # all anchors are there
            self.best = [[[] for _ in w] for w in self.windows]
            self.ready = True
        ids, labels, sizes = (pdf[c].to_numpy() for c in ("id", "label", "size"))
        order = np.lexsort((ids, labels))
        ids, labels, sizes = ids[order], labels[order], sizes[order]
        angle = np.array([np.frombuffer(x) for x in pdf["angles"]]).reshape(len(pdf), -1)[order].T
        cosines, sines = np.cos(angle), np.sin(angle)
        data = self._whole(np.frombuffer(b"".join(pdf["data"]), dtype=self.kind).reshape(len(pdf), -1)[order])
        for i, label in enumerate(self.label):
            a, b = np.searchsorted(labels, (label, label + 1))
            if self.same:
                some, at = slice(a, b), np.arange(a, b)
            else:
                some, at = slice(None), np.arange(len(ids))
            if not len(at):
                continue
            least, most = bounds(self.size[i], self.angle[i], sizes[some], cosines[:, some], sines[:, some])
            live = np.zeros(len(at), dtype=bool)
            ends = []
            for (low, high), found in zip(self.windows[i], self.best[i]):
                low = max(low, -found[-1][0]) if len(found) == self.k else low
                ends.append((low, high))
                if low <= high:
                    live |= ~((most < low) | (least > high))
            if not self.same:
                live[a:b] = False
            at = at[live]
            if not len(at):
                continue
            score = data[at] @ self.data[i]
            for (low, high), found in zip(ends, self.best[i]):
                hit = np.flatnonzero((score >= low) & (score <= high) & (ids[at] != self.id[i])) if low <= high else ()
                if len(hit) > 4 * self.k and self.exact:
                    least_kept = -np.partition(-score[hit], self.k - 1)[self.k - 1]
                    hit = hit[score[hit] >= least_kept]
                if len(hit):
                    found += [(-int(score[j]), int(ids[at[j]])) for j in hit]
                    found.sort()
                    del found[self.k :]

    def result(self) -> pd.DataFrame:
        rows = [(a, w, i, max(-LONG - 1, min(LONG, -s))) for a, best in zip(self.id, self.best if self.ready else []) for w, found in enumerate(best) for s, i in found]
        return pd.DataFrame(rows, columns=["anchor_id", "window", "other_id", "score"])


def best_in_windows(stored: DataFrame, anchors: DataFrame, n: int, n_anchors: int, k: int, same: bool, kind: str, exact: bool, block: int, slice_rows: int) -> DataFrame:
    """(anchor_id, window, best): the k best of the rows ``stored`` in each window of ``anchors``, as an array of (s, other_id), s minus the score.

    ``anchors`` are rows of ``stored`` with ``windows``, an array of the windows' ends (empty: one of all scores).
    """
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_anchors // block))
    slices = max(1, min(-(-n // slice_rows), -(-4 * parts // blocks)))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # rows are dealt by the hash of their place, so evenly, whatever they hold
    dealt = lambda m: F.pmod(F.xxhash64("rid"), F.lit(m)).cast("int")
    columns = ["id", "label", "size", "angles", "data"]
    a = anchors.select(dealt(blocks).alias("block"), numbers(slices).alias("slice"), F.lit(0).alias("kind"), *columns, "windows")
    r = stored.select(numbers(blocks).alias("block"), dealt(slices).alias("slice"), F.lit(1).alias("kind"), *columns, F.array().cast("array<long>").alias("windows"))

    def meet(batches):
        key, now = None, None
        for pdf in batches:
            for (b, s, t), some in pdf.groupby(["block", "slice", "kind"], sort=True):
                if (b, s) != key:
                    if now is not None:
                        yield now.result()
                    key, now = (b, s), Block(k, same, kind, exact)
                now.rows(some) if t else now.anchors(some)
        if now is not None:
            yield now.result()

    sent = a.unionByName(r).repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    found = sent.mapInPandas(meet, "anchor_id long, window int, other_id long, score long")
    # k rows from each slice at most
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "other_id"))), 1, k)
    return found.groupBy("anchor_id", "window").agg(best.alias("best"))


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", every: int = 50, scale: int = 256, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, references: int = REFERENCES, sample: int = SAMPLE, block: int = BLOCK, slice_rows: int = SLICE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = materialize(participants(vectors, id_col, label, vector_col).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("id") % every == 0, 1)).alias("anchors"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if common is None or not common["anchors"]:
        return empty
    rows = rows.where(F.size("v") == common["n"])
    most = float(np.floor(scale * (common["most"] or 0.0)) + 1)
    # every sum of products, in any order, is below this; scores are exact in floats of so many bits, else in Python's whole numbers
    reach = most * most * common["n"]
    kind, exact = ("<f4", True) if reach < 2**24 else ("<f8", reach < 2**53)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # at most ``sample`` rows
    whole = lambda xs: np.floor(scale * np.array(xs, dtype=np.float64).reshape(len(xs), common["n"]))
    directions = principal(whole([x["v"] for x in some]), references)

    def store(batches):
        for pdf in batches:
            x = whole(pdf["v"].tolist())
            size = norms(x)
            yield pdf[["id", "label", "rid"]].assign(size=size, angles=[r.tobytes() for r in angles(x, size, directions)], data=[r.tobytes() for r in x.astype(kind)])

    stored = materialize(rows.mapInPandas(store, "id long, label long, rid long, size double, angles binary, data binary"), "angles")
    anchors = stored.where(F.col("id") % every == 0)
    options = {"n": common["count"], "n_anchors": common["anchors"], "kind": kind, "exact": exact, "block": block, "slice_rows": slice_rows}
    whole_range = anchors.withColumn("windows", F.array().cast("array<long>"))
    near = best_in_windows(stored, whole_range, k=positives, same=True, **options)
    score = (-F.col("b.s")).cast("long")
    positive = materialize(near.select("anchor_id", F.posexplode("best").alias("at", "b")).select("anchor_id", "at", F.col("b.other_id").alias("positive_id"), score.alias("positive_score")), "positives")
    drop_shared(rows)
    # whole percents of a score, without overflow
    wide = F.col("positive_score").cast("decimal(24,0)")
    ends = F.array(F.ceil(wide * low / 100).cast("long"), F.floor(wide * high / 100).cast("long"))
    windows = positive.groupBy(F.col("anchor_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", ends.alias("ends")))), lambda x: x["ends"])).alias("windows"))
    hard = best_in_windows(stored, anchors.join(windows, "id"), k=negatives, same=False, **options)
    found = hard.select("anchor_id", F.col("window").alias("at"), F.posexplode("best").alias("place", "b"))
    return found.join(positive, ["anchor_id", "at"]).select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.other_id").alias("negative_id"), "positive_score", score.alias("negative_score"))


def turned_label(id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> Column:
    """The label, with the next one for ids that ``every`` divides."""
    return F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) AS k FROM p WHERE same) WHERE k <= 5),
neg AS (SELECT pos.anchor_id, pos.id AS positive_id, row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY n.s DESC, n.id) AS rank, n.id AS negative_id, pos.s AS positive_score, n.s AS negative_score
FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 50 * pos.s <= 100 * n.s AND 100 * n.s <= 95 * pos.s)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
