"""The registered queries on the given tables, against what their contracts say, computed anew in plain Python."""

import collections
import hashlib
import io
import wave
import zlib

import numpy as np
import xxhash

from facetflow.llm import queries


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_scores_and_their_folds(spark, sf):
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    for f, n, out, bar in ((queries.toxicity_query, 3, 1, 0.7), (queries.quality_query, 5, 0, 0.3)):
        rows = f(spark, sf).collect()
        assert {r.doc_id for r in rows} == docs and len(rows) == len(docs)
        assert all(r.held_out == (fold(r.doc_id, n) == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bar) for r in rows)


def test_held_out_documents_are_told_apart():
    """On rows that no model learned from: toxic ones are found in each language, poor ones as well, and others left alone."""
    from pyspark.sql import SparkSession

    spark, sf = SparkSession.getActiveSession(), "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    for f, name, least, clean, each in ((queries.toxicity_query, "toxic", 0.82, 0.99, 0.6), (queries.quality_query, "quality", 0.97, 0.97, 0.9)):
        hits = collections.defaultdict(list)
        for r in f(spark, sf).where("held_out").collect():
            if r.doc_id in labels and labels[r.doc_id][name] is not None:
                hits[labels[r.doc_id][name], lang[r.doc_id]].append(r.predicted)
        found = [x for (y, _), xs in hits.items() if y == 1 for x in xs]
        wrong = [x for (y, _), xs in hits.items() if y == 0 for x in xs]
        assert np.mean(found) >= least and 1 - np.mean(wrong) >= clean
        assert all(np.mean(xs) >= each for (y, k), xs in hits.items() if y == 1 and len(xs) >= 10), (name, {k: (len(v), np.mean(v)) for k, v in hits.items()})


def test_neighbours_with_production_parameters():
    """Every query of a few thousand vectors against brute force."""
    import duckdb
    from pyspark.sql import SparkSession

    spark, sf = SparkSession.getActiveSession(), "/root/testdata/sf0.1"
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], dtype=np.float64)
    got = collections.defaultdict(dict)
    for r in queries.neighbour_query(spark, sf).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for q in got:
        s = (x * x[ids == q][0]).sum(1)
        best = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        found = [got[q][k][0] for k in range(1, 21)]
        hits += len(set(best) & set(found))
        assert all(abs(got[q][k][1] - s[ids == got[q][k][0]][0]) < 1e-9 for k in range(1, 21))
        assert [-got[q][k][1] for k in range(1, 21)] == sorted(-got[q][k][1] for k in range(1, 21))
    assert hits >= 0.9 * 20 * len(got)


def test_fingerprints_and_components(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {}
    for r in rows:
        words, now = [], ""
        for c in (r.text or "").translate(lower) + " ":
            if c in " \t\n\x0b\x0c\r":
                words += [now] if now else []
                now = ""
            else:
                now += c
        units = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for u in units:
            h = xxhash.xxh64_intdigest(u.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        want[r.doc_id] = sum(1 << b for b in range(64) if 2 * ones[b] > len(units))
    root = {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(want)
    for a in ids:
        for b in ids:
            if b > a and (want[a] ^ want[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.simhash_query(spark, sf).collect()}
    assert got == {i: (f"{want[i]:016x}", find(i)) for i in ids}


def test_media_are_wave_files(spark, sf):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.media_query(spark, sf).collect():
        data = rows[r.doc_id]
        padded = data + b" " * ((-len(data)) % 192 if data else 192)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", "none"))
            w.writeframes(padded)
        stored = file.getvalue()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [b - 128 for b in padded]
        parts = dict(p.split("=") for p in r.feature.split(";"))
        assert abs(float(parts["mean"]) - sum(x) / len(x)) < 1e-3 and abs(float(parts["rms"]) - (sum(v * v for v in x) / len(x)) ** 0.5) < 1e-3
        assert int(parts["cross"]) == sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:])) and len(parts["bands"].split(",")) == 8
