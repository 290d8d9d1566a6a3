"""Approximate nearest neighbours by a forest of random-projection trees.

Fit. Each tree parts a bounded sample of vectors (``sample`` rows, those with the smallest hashes) at the median of
their projections on a random direction, down to ``2 ** depth`` leaves; directions and medians are the forest, of fixed size.
Index. Every row goes down every tree and gets one row for each leaf it comes to.
Search. A query's nodes of all trees wait in one shared priority queue by how far the query is on the wrong side of the
splits above them; the ``probes`` leaves that come out first are searched. Candidates of a leaf are compared in
double precision on the original vectors, leaf by leaf as blocks of queries against blocks of rows, and each query's best are
merged over its leaves. Every candidate in a searched leaf is compared: there is no cap on them.

A leaf is dealt out in blocks of about ``block`` rows (by a hash of the id), so one that many equal vectors fall into is
shared by many tasks.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller id; fewer candidates than ``k`` give what there is; an empty table gives an empty result;
rows of the same id and vector count as one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetflow.llm.common import materialize

TREES, DEPTH, PROBES, SAMPLE = 8, 8, 260, 20_000


class Forest:
    """``trees`` complete binary trees; node 1 is a root, node i has children 2 i and 2 i + 1."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, n = trees, depth, 1 << depth
        self.direction = rng.standard_normal((trees, n, sample.shape[1]))
        self.direction /= np.linalg.norm(self.direction, axis=2, keepdims=True)
        self.cut = np.zeros((trees, n))
        for t in range(trees):
            node = np.ones(len(sample), dtype=np.int64)
            for level in range(depth):
                side = np.zeros(len(sample), dtype=np.int64)
                for i in range(1 << level, 2 << level):
                    here = np.flatnonzero(node == i)
                    if len(here):
                        p = sample[here] @ self.direction[t, i]
                        self.cut[t, i] = np.median(p)
                        side[here] = p > self.cut[t, i]
                node = 2 * node + side

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf each row comes to; leaves of tree t have numbers from t * 2 ** depth."""
        out = np.empty((len(x), self.trees), dtype=np.int32)
        for t in range(self.trees):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", x, self.direction[t, node]) > self.cut[t, node])
            out[:, t] = node - (1 << self.depth) + (t << self.depth)
        return out

    def search(self, q: np.ndarray, probes: int) -> list[int]:
        """The first ``probes`` leaves out of the queue that all trees share."""
        size, out = 1 << self.depth, []
        margin = np.einsum("tnd,d->tn", self.direction, q) - self.cut
        heap = [(0.0, t, 1) for t in range(self.trees)]
        while heap and len(out) < probes:
            far, t, node = heapq.heappop(heap)
            while node < size:
                m = margin[t, node]
                near = 2 * node + (m > 0)
                heapq.heappush(heap, (far + m * m, t, int(near ^ 1)))
                node = int(near)
            out.append(node - size + (t << self.depth))
        return out


class Best:
    """The k best candidates so far of each of n queries, by score and then id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray) -> None:
        """Queries ``at`` against candidates, ids rising. The product ranks roughly, exact sums decide."""
        rough = q @ c.T
        rough[qid[:, None] == cid[None, :]] = -np.inf
        m = min(self.k, len(cid))
        some = np.argpartition(-rough, m - 1, axis=1)[:, :m] if m < len(cid) else np.broadcast_to(np.arange(m), (len(q), m)).copy()
        if m < len(cid):
            level = np.take_along_axis(rough, some, 1).min(1) - 1e-9
            for i in np.flatnonzero((rough >= level[:, None]).sum(1) > m):  # more than m may tie
                near = np.flatnonzero(rough[i] >= level[i])
                exact = (c[near] * q[i]).sum(1)
                exact[~np.isfinite(rough[i, near])] = -np.inf
                some[i] = near[np.lexsort((cid[near], -exact))[:m]]
        exact = (c[some] * q[:, None, :]).sum(2)
        exact[~np.isfinite(np.take_along_axis(rough, some, 1))] = -np.inf
        score, ids = np.concatenate([self.score[at], exact], 1), np.concatenate([self.id[at], cid[some]], 1)
        order = np.lexsort((ids, -score), axis=1)
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        twice = np.zeros(ids.shape, dtype=bool)
        twice[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (score[:, 1:] == score[:, :-1])
        order = np.argsort(twice, axis=1, kind="stable")[:, : self.k]
        gone = np.take_along_axis(twice, order, 1)
        self.score[at] = np.where(gone, -np.inf, np.take_along_axis(score, order, 1))
        self.id[at] = np.take_along_axis(ids, order, 1)

    def frame(self, queries: np.ndarray) -> pd.DataFrame:
        have = np.isfinite(self.score)
        return pd.DataFrame({"query_id": np.repeat(queries, have.sum(1)), "vec_id": self.id[have], "score": self.score[have]})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v): vectors of doubles that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), F.when(fine, v).alias("v")).where("id is not null and v is not null").dropDuplicates(["id", "v"])


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, trees: int = TREES, depth: int = DEPTH, probes: int = PROBES, sample: int = SAMPLE, block: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found, by inner product, of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "<f8"
    rows = usable(vectors, id_col, vector_col).select(F.col("id").cast("long").alias("id"), "v")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = materialize(rows.where(F.size("v") == common["n"]), "vectors")
    fit = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], dtype=np.float64)  # at most ``sample`` rows
    # no more leaves than leave some rows in each
    depth = max(1, min(depth, int(np.log2(max(2, len(fit) / 4)))))
    forest = spark.sparkContext.broadcast(Forest(fit, trees, depth))

    def vectors_of(pdf: pd.DataFrame) -> np.ndarray:
        return np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)

    def leaf_counts(batches):
        for pdf in batches:
            leaf, n = np.unique(forest.value.leaves(vectors_of(pdf)), return_counts=True)
            yield pd.DataFrame({"leaf": leaf, "n": n})

    # a leaf's blocks: trees * 2 ** depth numbers at any size of the input
    blocks = np.ones(trees << depth, dtype=np.int64)
    for r in rows.mapInPandas(leaf_counts, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        blocks[r["leaf"]] = -(-r["n"] // block)

    def index(batches):
        for pdf in batches:
            x = vectors_of(pdf)
            leaves, ids, data = forest.value.leaves(x), pdf["id"].to_numpy(), [r.tobytes() for r in x.astype(kind)]
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for t in range(trees):
                yield pd.DataFrame({"leaf": leaves[:, t], "part": (mixed % blocks[leaves[:, t]]).astype(np.int32), "asks": False, "id": ids, "data": data})

    def ask(batches):
        for pdf in batches:
            x = vectors_of(pdf)
            for s in range(0, len(x), 256):
                out = [(leaf, part, i) for i in range(s, min(s + 256, len(x))) for leaf in forest.value.search(x[i], probes) for part in range(blocks[leaf])]
                leaf, part, i = np.array(out, dtype=np.int64).reshape(-1, 3).T
                data = [r.tobytes() for r in x.astype(kind)]
                yield pd.DataFrame({"leaf": leaf.astype(np.int32), "part": part.astype(np.int32), "asks": True, "id": pdf["id"].to_numpy()[i], "data": [data[j] for j in i]})

    def compare(batches):
        # a task has whole blocks, and keeps each query's best over all of them
        got = [tuple(p[c].to_numpy() for c in ("leaf", "part", "asks", "id")) + (np.frombuffer(b"".join(p["data"]), dtype=kind).reshape(len(p), -1),) for p in batches if len(p)]
        if not got:
            return
        leaf, part, asks, ids, data = (np.concatenate(c) for c in zip(*got))
        queries, place = np.unique(ids[asks], return_inverse=True)
        if not len(queries):
            return
        where = np.full(len(ids), -1)
        where[asks] = place
        best = Best(len(queries), k)
        order = np.lexsort((ids, asks, part, leaf))
        change = np.flatnonzero(np.r_[True, (np.diff(leaf[order]) != 0) | (np.diff(part[order]) != 0)])
        for rows_of in np.split(order, change[1:]):
            q, c = rows_of[asks[rows_of]], rows_of[~asks[rows_of]]
            for s in range(0, len(q) if len(c) else 0, 1024):
                best.add(where[q[s : s + 1024]], ids[q[s : s + 1024]], data[q[s : s + 1024]].astype(np.float64), ids[c], data[c].astype(np.float64))
        yield best.frame(queries)

    schema_in = "leaf int, part int, asks boolean, id long, data binary"
    both = rows.mapInPandas(index, schema_in).unionByName(rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).mapInPandas(ask, schema_in))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "leaf", "part").mapInPandas(compare, "query_id long, vec_id long, score double")
    top = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(top.alias("best"))  # k rows from each task at most
    return ranked.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
