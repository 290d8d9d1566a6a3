"""The pipeline's stages against what they promise, on the smallest tables."""

import collections

import numpy as np

import corpus_pipeline
from facetflow.llm import linededup, simhash


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append(out)
    start, good, single, cut, mixed = ([r.asDict() for r in d.collect()] for d in seen)
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in start} and 0.6 * len(start) < len(good) < len(start)

    # near copies: whatever goes has a copy among those of its stage that stays
    kept = {r["doc_id"] for r in single}
    sets = {r["doc_id"]: set(simhash.shingles(r["text"] or "", 5)) for r in good}
    for r in good:
        if r["doc_id"] not in kept:
            a = sets[r["doc_id"]]
            assert any(len(a & sets[k]) >= 0.8 * len(a | sets[k]) for k in kept)
    texts = [r["text"] for r in single]
    assert len(texts) == len(set(texts))

    # repeated passages: no run of 50 words of whole units is left in two documents
    whole = collections.Counter(u[4] for r in cut for u in {v[4]: v for v in linededup.units(r["text"])}.values() if u[3] - u[2] >= 50)
    assert not whole or max(whole.values()) == 1

    # mixing: copies of a document are whole, three at most
    assert max(collections.Counter(r["doc_id"] for r in mixed).values()) <= 3

    rows = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(r["doc_id"] for r in mixed)
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and np.mean(list(filled.values())) > 1500


def test_run_is_that_of_plain_python(spark, sf):
    """All stages behind the trained classifier, computed anew without Spark: the same pieces with the same ids."""
    import zlib

    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    from facetflow.llm import bpe, mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = sorted((r.doc_id, r.text or "", r.source) for r in corpus_pipeline.keep_good(spark, docs, sf).collect())

    def words(text):
        return [w for w in text.encode().lower().split() if w]

    def five(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept, sets = [], []
    for row in good:  # an earlier document that stays takes its near copies away
        a = five(row[1])
        if not any((not a and not b) or len(a & b) >= 0.8 * len(a | b) for b in sets):
            kept.append(row)
            sets.append(a)

    seen, cut = set(), []
    for i, text, source in kept:
        spans, last = [], None
        for n, (start, end, _, _, digest) in enumerate(linededup.units(text)):
            if digest in seen:
                spans = [*spans[:-1], (spans[-1][0], end)] if last == n - 1 else [*spans, (start, end)]
                last = n
            seen.add(digest)
        for start, end in reversed(spans):
            text = text[:start] + text[end:]
        if not spans or text.strip(" "):
            cut.append((i, text, source))

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(cut, columns=["doc_id", "text", "source"]))
    times = {i: taken // size for i, size, _, _, taken in con.sql(mixing.ORACLE).fetchall() if size}
    library, want = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json")), collections.Counter()
    for i, text, _ in cut:
        x = library.encode(text, add_special_tokens=False).ids + [0]
        at, to = 0, len(x) - (len(x) - 1) // 2048 * 2048
        for k in range((len(x) - 1) // 2048 + 1):
            if times.get(i):
                want[i, k, at, to - at, zlib.crc32(np.array(x[at:to], "<u4").tobytes())] += times[i]
            at, to = to, to + 2048
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and sum(want.values()) > 100
