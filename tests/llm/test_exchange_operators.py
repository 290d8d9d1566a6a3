"""Exact duplicates, hard negatives and token alignment against brute force: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from facetflow.llm import alignment, bpe, exactdedup, negatives, queries

from test_operators import DOCS, docs, empty  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- exact duplicates -------------------------------------------------------------------------------------------------


def test_golomb_codes_give_their_values_back():
    rng = np.random.default_rng(1)
    for n, span in ((0, 10), (1, 1), (1, 1 << 50), (1000, 1000), (3000, 1 << 40), (500, 700)):
        base = int(rng.integers(0, 1 << 40))
        values = np.sort(rng.choice(span, n, replace=False) if span < 1 << 20 else np.unique(rng.integers(0, span, n))) + base
        for shift in {0 if span < 5000 else 20, exactdedup.golomb_shift(len(values), span)}:
            code = exactdedup.encode(values, base, shift)
            assert (exactdedup.decode(code, len(values), base, shift) == values).all()
    # near the least that a set of its size needs: log2(span / n) + 1.5 bits a value
    values = np.sort(rng.choice(1 << 24, 1 << 14, replace=False))
    assert len(exactdedup.encode(values, 0, exactdedup.golomb_shift(len(values), 1 << 24))) * 8 < 11.7 * len(values)


def brute_groups(rows):
    texts = [(r.text or "").translate(LOWER) for r in rows]
    of = collections.defaultdict(list)
    for r, t in zip(rows, texts):
        of[t].append(r.doc_id)
    out = []
    for r, t in zip(rows, texts):
        keep = max((i for i in of[t] if i is not None), default=None)
        out.append((r.doc_id, keep, len(of[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"spare": -4}, {"run": 5}, {"most": 0, "spare": -3, "run": 3}])
def test_exact_groups(spark, docs, options):  # noqa: F811
    more = docs.unionByName(spark.createDataFrame([(200 + i, t, "EN", "s", 1, 0.0, "x") for i, t in enumerate(["Copy Of This", "copy of this", "COPY of this", "copy of thıs", "copy of this "] * 3)] + [(None, "nobody", None, None, None, None, None)] * 2, DOCS)).repartition(5).cache()
    got = exactdedup.exact_groups(more, **options).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == collections.Counter(brute_groups(more.collect()))
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_without_their_copies(spark, docs, empty):  # noqa: F811
    left = exactdedup.exact_groups(docs, whole_rows=True).where("kept").select("row.*")
    assert left.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {(r.text or "").translate(LOWER) for r in docs.collect()}
    assert exactdedup.exact_groups(empty).count() == 0


def test_one_text_on_most_rows(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 > 0, 'THE same', concat('text ', id)) as text").repartition(7)
    got = exactdedup.exact_groups(rows, run=100).collect()
    assert sum(r.kept for r in got) == 1 + 1334 and {r.keep_id for r in got if r.group_size > 1} == {3998} and {r.group_size for r in got} == {1, 2666}


def test_exact_dedup_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.exact_dedup_query(spark, sf).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute_groups(rows)) and all(r.kept == (r.doc_id == r.keep_id) for r in got)


# --- hard negatives ---------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=50, low=50, high=95):
    """rows: (id, label, vector)."""
    one = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    one = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a in sorted(i for i in one if i % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(one[a][1], v)), i) for i, (_, v) in one.items() if i != a)
        for p, pid in [(s, i) for s, i in scored if one[i][0] == one[a][0]][:5]:
            hits = [(s, i) for s, i in scored if one[i][0] != one[a][0] and low * -p <= 100 * -s <= high * -p][:3]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(hits)]
    return sorted(out)


KIND = "vec_id long, label int, embedding array<double>, rid string, data int"


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12))
    rows = [(i, i % 4, (centre[i % 3] + rng.normal(size=12)).round(1).tolist()) for i in range(260)]
    rows += [(i, i % 4, rows[5][2]) for i in range(300, 340)]  # equal vectors: ties
    rows += [(50, 2, rows[50][2]), (50, 1, rows[7][2]), rows[3], rows[3]]  # an id twice, repeated rows
    rows += [(400, None, rows[1][2]), (None, 1, rows[1][2]), (401, 1, None), (402, 1, [1.0] * 11 + [None]), (403, 1, [float("nan")] + [1.0] * 11), (404, 1, [float("inf")] + [1.0] * 11), (405, 1, [0.0] * 12), (450, 2, [0.0] * 12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    want = brute_negatives(rows)
    assert len(want) > 60
    for options in ({}, {"block": 2, "slice_rows": 30}, {"references": 1}):
        assert sorted(map(tuple, negatives.hard_negatives(df, **options).collect())) == want
    # of another length than most
    assert sorted(map(tuple, negatives.hard_negatives(df.unionByName(spark.createDataFrame([(500, 1, [1.0], "x", 1)], KIND))).collect())) == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0 and negatives.hard_negatives(df.where("vec_id = 50")).count() == 0


def test_scores_beyond_floats_are_whole_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.normal(size=3) * 2.0**18 + rng.choice([0.0, 2.0**19], 3)).tolist()) for i in range(120)]
    got = negatives.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND), slice_rows=20)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    huge = spark.createDataFrame([(i, i % 2, [1e300 * (1 + i), 1.0], "x", 1) for i in range(60)], KIND)
    assert {abs(r.positive_score) for r in negatives.hard_negatives(huge).collect()} <= {negatives.LONG, negatives.LONG + 1}


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(size=(200, 6)), np.eye(6), np.zeros((1, 6)), -np.eye(6)]))
    size, refs = negatives.norms(x), negatives.principal(x, 4)
    angle = negatives.angles(x, size, refs)
    assert np.allclose(refs @ refs.T, np.eye(4))
    for i in range(len(x)):
        least, most = negatives.bounds(size[i], angle[i], size, np.cos(angle).T, np.sin(angle).T)
        score = x @ x[i]
        assert (least <= score).all() and (score <= most).all() and (most - least < 2.1 * size[i] * size + 3).all()


def test_hard_negatives_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.negatives_query(spark, sf).collect())) == brute_negatives(rows)


# --- alignment --------------------------------------------------------------------------------------------------------


def test_galloping_finds_what_lists_share():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(200), rng.randint(0, n))) for n in (60, rng.choice([3, 150])))
        mine, theirs = alignment.common_ends(a, b)
        assert [a[i] for i in mine] == [b[j] for j in theirs] == sorted(set(a) & set(b))


def brute_alignment(rows):
    """By the libraries of both files, over whole texts, with every pair of a document's tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(bpe.byte_symbols())}
    made, docs_with = [], collections.Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        ids = (a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = ([bytes(back[c] for c in a.id_to_token(t)) for t in ids[0]], [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids[1]])
        if not text or any(b"".join(p) != whole for p in parts):
            made.append((i, [], [], 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        spans = [list(zip([0, *e], e)) for e in ends]
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (f, g) in zip(ids[1], spans[1]) if max(s, f) < min(e, g)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[t for t, e in zip(ids[k], ends[k]) if low < e <= high] for k in (0, 1)] for low, high in zip([0, *common], common)]
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        made.append((i, *ids, len(groups), links, hashlib.sha256(line.encode()).hexdigest()))
        docs_with.update(set(links))
    best = collections.defaultdict(int)
    for (x, _), n in docs_with.items():
        best[x] = max(best[x], n)
    return [(i, len(x), len(y), g, len(ls), sum(docs_with[p] == best[p[0]] for p in ls), sum(docs_with[p] for p in ls), d) for i, x, y, g, ls, d in made]


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "x\ny", "\tq", "▁", "a ▁b", "<0x41> <s> </s>", "<|endoftext|> <|endoftext|>x", "don't we'll I'VE", "日本語 テキスト　空白", "é́ ü ñ", "👩‍👩‍👧 🏳️‍🌈", "12345 3.14", "\x00\x01 \x7f", "\r\n a", "aaaa" * 700, "a  b", "​ x", "x\x1c y", "ﬁ ½ ´x"]
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("options", [{}, {"most": 0}])
def test_alignment(spark, docs, empty, options):  # noqa: F811
    more = docs.where("doc_id is null or doc_id <> 9007199254740993").unionByName(spark.createDataFrame([(500 + i, t, None, None, None, None, None) for i, t in enumerate(ODD)], DOCS)).repartition(3).cache()
    got = alignment.align(more, **options).collect()
    assert collections.Counter(tuple(r[c] for c in FIELDS) for r in got) == collections.Counter(brute_alignment([(r.doc_id, r.text) for r in more.collect()]))
    assert alignment.align(empty, **options).count() == 0


def test_chunks_are_aligned_as_the_whole_text_is(monkeypatch):
    """Small stores and segments, so that they are cleared and cut within a text."""
    tk = alignment.Tokenizers(bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "SEGMENT", 20)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["alpha", "Beta", " ", " ", " ", "\n", ".", "ü", "7", "▁", "  ", "don't"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for most in (10, 10_000):
        s = alignment.Store(tk, most)
        for i in range(0, len(texts), 40):
            numbers, digests, keys, times = alignment.aligned(s, texts[i : i + 40])
            for k, x in enumerate(texts[i : i + 40]):
                both = tk.both(x)
                assert (numbers[0][k], numbers[1][k]) == (tuple(map(len, both)) if both else (0, 0)) and times[k].sum() == numbers[3][k] and (digests[k] == "") == (both is None)


def test_alignment_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 3000]
    docs_of = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_alignment(rows))
    assert sorted(tuple(r[c] for c in FIELDS) for r in alignment.align(docs_of).collect()) == want
    whole = {r.doc_id: r for r in queries.alignment_query(spark, sf).collect()}
    assert len(whole) == 200 and all((whole[w[0]].n_a, whole[w[0]].n_links, whole[w[0]].groups_sha256) == (w[1], w[4], w[7]) for w in want)
