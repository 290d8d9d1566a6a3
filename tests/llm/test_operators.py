"""Each operator against a brute-force version on small fixtures, with nulls, empty and long texts, ties, repeats, no rows."""

import base64
import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetflow.llm import ann, bpe, common, linededup, media, mixing, packing, quality, simhash, toxicity, warc
from facetflow.llm.common import components, fold, in_filter, repeat_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"


def made_docs(spark):
    """Odd rows: nulls in every column, empty and very long texts, repeats, and columns whose names clash."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rnd = random.Random(4)
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) + "." for _ in range(40)]
    rows = [(i, x, "en", f"s{i % 4}", len(x), 0.5, "x") for i, x in enumerate(prose)]
    rows += [(100, None, None, None, None, None, None), (None, "no id", "en", "s1", 5, 1.0, "x"), (None, None, None, None, None, None, None), (101, "", "en", "s1", 0, 1.0, ""), (102, " \t\n ", "en", None, 4, 1.0, "")]
    rows += [(103, prose[0], "en", "s2", 1, 1.0, "x"), (104, prose[0], "en", "s2", 1, 1.0, "x"), (104, prose[0], "en", "s2", 1, 1.0, "x"), (9007199254740993, "long " * 30_000, "en", "s3", 150_000, 1.0, "x")]
    rows += [(105, "ünï <|endoftext|> 　 x  y\n\n z", "fr", "é", 3, 1.0, "x")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return made_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def counted(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- helpers ----------------------------------------------------------------------------------------------------------


def test_components_are_those_of_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(-60, 60), rnd.randint(-60, 60)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_has_all_repeats(spark):
    bitmap = repeat_filter(spark.createDataFrame([(i,) for i in [1, -1, 2, -1, 5, 5, 1 << 62]], "d long"), "d", bits=16)
    assert in_filter(bitmap, np.array([-1, 5])).all() and not in_filter(bitmap, np.array([1, 2, 1 << 62])).any()


# --- 1, 4: classifiers ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_odd_rows(spark, docs, empty, labels, score):
    out = score(docs, labels, learn=fold("id", 3) != 1)
    assert counted(out, "doc_id") == counted(docs, "doc_id")
    assert out.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert score(empty, labels, learn=F.lit(True)).count() == 0
    assert score(docs, labels.limit(0), learn=F.lit(True)).count() == docs.count()


def test_toxic_words_found_and_clean_texts_left(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(900):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 6 == 0:
            w[rnd.randint(0, 39)] = rnd.choice(["idiot", "scum", "zorgat" + rnd.choice("abcdef")])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, known, learn=fold("id", 3) != 1).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] for i in held if i % 6 == 0]) > 0.9
    assert np.mean([got[i] for i in held if i % 6]) < 0.03


def test_label_model_learns_from_votes_alone():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = [np.where(y, rng.random(4000) < hit, rng.random(4000) < miss) for hit, miss in ((0.8, 0.1), (0.7, 0.05), (0.75, 0.2))]
    votes.append(votes[0])  # a voter that only repeats another
    patterns = collections.Counter(sum(int(v[i]) << j for j, v in enumerate(votes)) for i in range(4000))
    post = toxicity.label_model({p: float(n) for p, n in patterns.items()}, {}, 4)
    assert post[0b1111] > 0.9 and post[0] < 0.1


def test_quality_by_shapes(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 9)))
    rows = []
    for i in range(800):
        w = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            w = [x for x in w[:12] for _ in range(5)] if i % 8 == 0 else [x + "%%%" for x in w]
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(800)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.score_quality(d, known, learn=fold("id", 5) != 0).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == int(i % 4 != 0) for i in held]) > 0.97


def test_dual_descent_meets_the_margin():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    values = [np.ones(len(r)) for r in rows]
    w, b = quality.dual_descent(rows, values, np.array([True, False, True, False]), 3, c=100, rounds=500)
    margins = [(1 if i % 2 == 0 else -1) * (w[r].sum() + b) for i, r in enumerate(rows)]
    assert min(margins) > 0.99


# --- 2, 7: tokens -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))


def odd_texts():
    rnd = random.Random(3)
    letters = "".join(map(chr, [*range(0, 0x250), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x661, 0xBD])) + " " * 60 + "\n" * 20 + "the" * 20
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "aaaa" * 3000, "don't we'll I'M", " " * 5000]
    for k in range(1500):
        x = "".join(rnd.choice(letters) for _ in range(40))
        out.append(x[:10] + "<|endoftext|>" + x[10:] if k % 9 == 0 else x)
    return out


def test_counts_and_ids_are_the_librarys(library):
    xs = odd_texts()
    want = [library.encode(x, add_special_tokens=False).ids for x in xs]
    c, ids = bpe.Counter(bpe.vocabulary_path("byte_bpe_50k.json")), packing.Ids(bpe.vocabulary_path("byte_bpe_50k.json"))
    assert [c.count(x) for x in xs] == c.counts(xs).tolist() == list(map(len, want))
    assert [np.frombuffer(ids(x), "<u4").tolist() for x in xs] == want


def test_token_counts(docs, empty, library):
    got = counted(bpe.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = collections.Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    assert got == want and bpe.token_counts(empty).count() == 0


def test_packing_covers_every_document(docs, empty, library):
    rows = packing.pack(docs).collect()
    ids = lambda x: library.encode(x or "", add_special_tokens=False).ids + [0]
    want = collections.Counter()
    for r in docs.collect():
        x = ids(r.text)
        at, to = 0, len(x) - (len(x) - 1) // 2048 * 2048
        for k in range((len(x) - 1) // 2048 + 1):
            want[r.doc_id, k, at, to - at, zlib.crc32(np.array(x[at:to], "<u4").tobytes())] += 1
            at, to = to, to + 2048
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for x in filled.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def best_fit(histogram):
    """Sequences that plain best-fit, longest first, needs."""
    free = collections.Counter()
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = min((x for x in free if x >= length), default=2048)
            free[room] -= 1
            if free[room] <= 0:
                del free[room]
            if room > length:
                free[room - length] += 1
            yield room == 2048


def whole(plan, histogram):
    placed, filled = collections.Counter(), collections.defaultdict(int)
    for length, a, b, first, per, offset in sorted(plan.runs, key=lambda r: r[5]):
        placed[length] += b - a
        for r in range(a, b):
            s = first + (r - a) // per
            assert filled[s] == offset + (r - a) % per * length
            filled[s] += length
    assert placed == collections.Counter(histogram) and all(x <= 2048 for x in filled.values()) and len(filled) == plan.sequences


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5000}, {1025: 7, 1023: 7}, {700: 30, 600: 31, 500: 5, 3: 100}, {2047: 5, 1: 2}])
def test_plans_are_whole_and_tight(histogram):
    p = packing.best_plan(histogram)
    whole(p, histogram)
    assert p.sequences <= sum(best_fit(histogram)) + 1


def test_configurations_carry_the_large_pieces():
    rng = np.random.default_rng(3)
    lengths = np.minimum(np.maximum(rng.lognormal(6.2, 0.9, 3000).astype(int), 1), 2048)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    for many in ({k: n for k, n in histogram.items()}, {k: 100 * n + k % 7 for k, n in histogram.items()}):
        p = packing.best_plan(many)
        least = -(-sum(k * n for k, n in many.items()) // 2048)
        assert p.by_configuration > 0.5 * p.large and p.sequences <= 1.003 * least + 1
    p = packing.best_plan(histogram)
    whole(p, histogram)
    assert p.sequences <= sum(best_fit(histogram)) + 1


def test_long_blanks_are_encoded_whole(library):
    ids = packing.Ids(bpe.vocabulary_path("byte_bpe_50k.json"))
    for x in ("a" + " " * 5000 + "b  c" + "\n" * 3000 + "d" + " " * 1000, "\u3000" * 2000 + "x", " \n" * 1500):
        assert np.frombuffer(ids.with_blanks(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids
    blanks = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b"]
    c = bpe.Counter(bpe.vocabulary_path("byte_bpe_50k.json"))
    assert [len(ids(x)) // 4 for x in blanks] == [c.count(x) for x in blanks]


def test_other_vocabularies_are_refused(tmp_path):
    with open(bpe.vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Counter(str(path))
        with pytest.raises(ValueError):
            packing.Ids(str(path))


# --- 3, 9: archives and media -----------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>é") for i in range(60)] + [(61, None, None), (62, "a\r\nb", ""), (64, "u", inner), (63, "u", inner), (None, "n", inner), (2**60 + 1, "u", inner + "x"), (65, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string")
    by = collections.defaultdict(list)
    for i, _, h in rows:
        by[(h or "").encode()].append(i)
    want = collections.Counter()
    for data, ids in by.items():
        low = min(i for i in ids if i is not None)
        for i in ids:
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == low else "revisit", None if i == low else low] += 1
    got = counted(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chain_rejects_magic_inside_payloads():
    rec = lambda i, html: (warc.record(i, "u", html, "D", None) + warc.END).encode()
    data = rec(1, rec(9, "in").decode()) + rec(2, "two")
    found = warc.candidates(data)
    keep = warc.reachable(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
    assert len(found) == 3 and [f[3] for f, k in zip(found, keep) if k] == ["<urn:page:1>", "<urn:page:2>"]


def test_media_round_trip(docs, empty):
    want = collections.Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        p = data + b" " * (-len(data) % 192 or (0 if data else 192))
        m = media.wav(p)
        want[r.doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(p)] += 1
    got = counted(media.media_columns(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert got == want and media.media_columns(empty).count() == 0


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    a, b = media.cuts([data, b"inserted" * 20 + data])
    one = {data[x:y] for x, y in zip([0, *a], a)}
    two = {(b"inserted" * 20 + data)[x:y] for x, y in zip([0, *b], b)}
    assert a[-1] == len(data) and max(np.diff([0, *a])) <= media.MOST and len(one & two) > 0.7 * len(one)


# --- 5: neighbours ----------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    x[100:200] = x[100]  # a hot vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [1.0, 2.0]), (1100, [float("inf")] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, depth=3, trees=6, probes=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(score - x[i] @ x[q]) < 1e-9 for i, score in found)
        hits += len({i for i, _ in found} & set(want.tolist()))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.neighbours(df.limit(0)).count() == 0
    few = ann.neighbours(df.where("vec_id in (20, 21, 22)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(20, 1), (20, 2)]


# --- 6: near copies ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_bit_sliced_links_keep_all_components(radius):
    rng = np.random.default_rng(radius)
    for trial in range(12):
        n = int(rng.integers(1, 160))
        fps = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, n)]
        for i in range(n):
            for _ in range(rng.integers(0, 6)):
                fps[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        keys = np.sort(rng.integers(0, max(1, n // (1 if trial % 3 == 0 else 40)), n))
        pairs = [(i, j) for i in range(n) for j in range(i) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= radius]

        def parted(edges, n=n):
            root = list(range(n))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            return [find(i) for i in range(n)]

        got = simhash.links(keys, fps, radius)
        assert all(int(fps[a] ^ fps[b]).bit_count() <= radius and keys[a] == keys[b] for a, b in got)
        assert parted(got) == parted(pairs) and len(got) < n


def test_fingerprint_by_definition():
    import xxhash

    text = "The  quick\tBROWN fox é É jumps the quick brown"
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_near_components_against_brute_force(docs, empty):
    rows = [(r.doc_id, simhash.fingerprint(r.text or "")) for r in docs.collect()]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = collections.Counter((rows[i][0], rows[i][1] - (rows[i][1] >> 63 << 64), low[root[i]]) for i in range(len(rows)))
    assert counted(simhash.near_components(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_components(empty).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, docs, empty):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(150)] for _ in range(10)]
    rows = []
    for b, w in enumerate(base):
        for k in range(6):
            v = list(w)
            if k:
                v[rnd.randint(0, 149)] = word()  # similarity 0.93
            rows.append((b * 100 + k, " ".join(v)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.near_dedup(d).collect()}
    assert {b * 100 for b in range(10)} <= left and len(left) <= 10 + 0.2 * 50  # fingerprints miss some at this similarity
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (103, 104)").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert simhash.near_dedup(empty).count() == 0


# --- 8: mixing --------------------------------------------------------------------------------------------------------


def test_mix_is_that_of_the_sql(docs, empty, sf, spark):
    got = counted(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    pdf = docs.select("doc_id", "text", "source").toPandas()
    pdf["doc_id"] = pd.array([r.doc_id for r in docs.select("doc_id").collect()], dtype="Int64")
    con.register("documents", pdf)
    assert got == collections.Counter(con.sql(mixing.ORACLE).fetchall())
    assert mixing.mix(empty).count() == 0
    assert all(r.taken <= 3 * r.size for r in mixing.mix(docs).collect())


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["d"] == 0 and abs(sum(got.values()) - 1115) < 1e-9
    assert all(got[s] <= 3 * n + 1e-9 for s, n in (("a", 10), ("b", 100), ("c", 1000), (None, 5)))


# --- 10: repeated passages --------------------------------------------------------------------------------------------


def test_repeats_against_brute_force(spark, docs, empty):
    rnd = random.Random(6)
    sentence = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(rnd.randint(2, 14))).capitalize() + rnd.choice([". ", "! ", "\n"])
    passage = "".join(sentence() for _ in range(9))
    rows = []
    for i in range(30):
        x = [sentence() for _ in range(10)]
        if i % 3 == 0:
            x.insert(4, passage.upper() if i == 6 else passage)
        rows.append((200 + i, "".join(x), "en", "s", 1, 1.0, "x"))
    rows.append((250, passage + "In between there is something else. " + passage, "en", "s", 1, 1.0, "x"))
    d = docs.unionByName(spark.createDataFrame(rows, DOCS))
    got = {(r.doc_id, zlib.crc32((r.text or "").encode())): [tuple(s) for s in r.removed_spans] for r in linededup.remove_repeats(d).collect()}
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in d.where("doc_id is not null and text is not null").collect()}, key=lambda r: r[:2])
    dup_ids = [k for k, n in collections.Counter(r[1] for r in order).items() if n > 1]  # ids with several texts: ties by hash
    first = {}
    for k, (_, i, x) in enumerate(order):
        for j, u in enumerate(linededup.units(x)):
            first.setdefault(u[4], (k, j))
    changed = 0
    for k, (_, i, x) in enumerate(order):
        if i in dup_ids:
            continue
        us = linededup.units(x)
        spans, j = [], 0
        while j < len(us):
            e = j
            while e < len(us) and first[us[e][4]] != (k, e):
                e += 1
            if e > j and us[e - 1][3] - us[j][2] >= linededup.MIN_WORDS:
                spans.append((us[j][0], us[e - 1][1]))
            j = max(e, j) + 1
        left = x
        for a, b in reversed(spans):
            left = left[:a] + left[b:]
        assert got[i, zlib.crc32(left.encode())] == spans
        changed += bool(spans)
    assert changed > 5
    assert linededup.remove_repeats(empty).count() == 0
    assert linededup.remove_repeats(d).where("doc_id = 100 and text is null").count() == 1


def test_near_dedup_goes_on_after_the_first_document(spark):
    """Against greedy removal by exact similarity: a chain, edited copies with copies of their own, similarities from 0.8."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for b in range(12):
        w = [word() for _ in range(200)]
        for k in range(8):  # each is edited further than the last: 0.9 to that before it, under 0.8 to the one before that
            rows += [(b * 100 + 10 * k, " ".join(w)), (b * 100 + 10 * k + 1, " ".join(w)), (b * 100 + 10 * k + 2, " ".join(w).upper())]
            for at in rnd.sample(range(200), 2):
                w[at] = word()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets, stay = {i: set(simhash.shingles(x, 5)) for i, x in rows}, []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    assert 24 <= len(stay) < 60
    assert sorted(r.doc_id for r in simhash.near_dedup(d).collect()) == stay


def first_come(texts, similarity=0.8, words=5):
    """Ids that stay if each goes that has a copy before it that stays."""
    sets = {i: set(simhash.shingles(x, words)) for i, x in texts.items()}
    stay = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    return stay


def test_near_dedup_of_a_family_just_below_the_threshold(spark, monkeypatch):
    """Pages of one template with a similarity of 0.766, among them copies of some: all share their buckets, none but copies go."""
    template = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(template + [f"u{i}x{k}" for k in range(30)]) for i in range(240)}
    texts |= {300 + i: texts[200 + i % 40] + " more" for i in range(60)} | {400 + i: texts[7] for i in range(30)}
    want, rounds, first = first_come(texts), [], simhash.Tile
    assert len(want) == 240
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name="table": rounds.append(name) or seen(df, name))
    assert sorted(r.doc_id for r in simhash.near_dedup(d).collect()) == want
    assert rounds.count("near-front") <= 5 and first is simhash.Tile


def test_tiles_count_common_shingles(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.choice([0, 1, 4, 6, 30]))) for _ in range(80)]
    tile = simhash.Tile(3, 0.5)
    tile.hold([str(i).encode() for i in range(9)], texts[:9])
    got = set(tile.copies([str(i).encode() for i in range(80)], texts))
    sets = [set(simhash.shingles(x, 3)) for x in texts]
    assert got == {(str(i).encode(), str(j).encode()) for i in range(80) for j in range(9) if i != j and ((not sets[i] and not sets[j]) or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])))}


def test_near_dedup_is_exact_at_similarity_0_93(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for b in range(10):
        w = [word() for _ in range(150)]
        for k in range(6):
            v = list(w)
            if k:
                v[rnd.randint(0, 149)] = word()
            rows.append((b * 100 + k, " ".join(v)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(d).collect()) == [b * 100 for b in range(10)]


def test_equal_second_fingerprints_link(spark, monkeypatch):
    """Texts whose first fingerprints are far apart and whose second ones are equal, with no other near them."""
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    made = spark.createDataFrame([(1, 0, 77), (2, 0xFFFFF, 77), (3, 0xFFFFF00000, 0xFFFFF0000000)], "doc_id long, fp long, fp1 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made)
    got = {r.doc_id: r["first"].doc_id for r in simhash.near_groups(d, ["doc_id"], radius=6, agree=3, how_many=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_few_labels_among_many_documents_are_all_used(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(3000):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 3 == 0:
            w[rnd.randint(0, 39)] = "zorgat"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, known, learn=F.lit(True), sample=200).collect()}
    assert np.mean([got[i] for i in range(150, 3000) if i % 3 == 0]) > 0.9
    assert np.mean([got[i] for i in range(150, 3000) if i % 3]) < 0.03


def test_sample_has_one_text_of_an_id(spark):
    d = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other"), (3, "x" * 90), (4, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    got = quality.training_rows(d, known, F.lit(True), "quality", "doc_id", "text", 3).collect()
    assert len(got) == 3 and len({r.id for r in got}) == 3
    some = known.select(F.lit(0).alias("h"), F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    left = common.examples(d.withColumnRenamed("doc_id", "id"), some, chars=20, longest=80).collect()
    assert {r.id for r in left} == {1, 2, 4} and len(left) == 3 and sum(len(r.text or "") for r in left) <= 20


def test_short_repeated_units_go(spark):
    d = spark.createDataFrame([(1, "All rights are reserved here. One own line of this text."), (2, "Another first line of words. All rights are reserved here. Bye now.")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_words) for r in linededup.remove_repeats(d).collect()}
    assert got[1] == ("All rights are reserved here. One own line of this text.", 0)
    assert got[2] == ("Another first line of words. Bye now.", 5)


def test_hot_keys_and_clashing_names_change_nothing(spark):
    rows = [(7 if i % 3 else i, i, "x") for i in range(6000)]
    many = spark.createDataFrame(rows, "k long, i long, salt string")
    few = spark.createDataFrame([(k, k * 2, "y") for k in range(0, 6000, 2)] + [(7, 14, "z")], "k long, twice long, parts string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = common.spread(many, few, ["k"], F.col("i"), how)
        assert counted(got, *got.columns) == counted(many.join(few, ["k"], how), *got.columns)


def test_columns_with_the_names_that_operators_use_survive(spark):
    text = " ".join(f"w{i}" for i in range(40)) + "."
    docs = spark.createDataFrame([(1, text, 5, 6, 7, 8), (2, text, 1, 2, 3, 4), (3, "other words stand here now", 9, 9, 9, 9)], "doc_id long, text string, __i long, __key long, i long, k long")
    left = simhash.near_dedup(docs)
    assert left.columns == docs.columns and counted(left, *docs.columns) == collections.Counter({(1, text, 5, 6, 7, 8): 1, (3, "other words stand here now", 9, 9, 9, 9): 1})
    cut = linededup.remove_repeats(docs)
    assert {(r.doc_id, r["__i"], r["__key"], r.i, r.k, r.text) for r in cut.collect()} == {(1, 5, 6, 7, 8, text), (2, 1, 2, 3, 4, ""), (3, 9, 9, 9, 9, "other words stand here now")}
