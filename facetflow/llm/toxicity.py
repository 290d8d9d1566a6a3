"""Toxicity by weak supervision.

Voters. Each has a name and says whether a text holds one of its terms: fixed lexicons by kind of abuse, patterns (shouting, marks,
masked words, abuse aimed at the reader, phrases), and lexicons induced from the labelled rows of the sample, of whole words and of
word beginnings (and of beginnings that two or three words of a text share), each parted by how many of the rows that hold a term are toxic: so a voter's terms are alike in accuracy.
Label model. The votes of all documents that may be learned from are counted by pattern (at most 2 ** voters rows, whatever
the input holds). Expectation maximisation, anchored by the patterns of all labelled rows, estimates how often each voter fires in
either class; voters that stay correlated within a class are joined to one factor with a table of its own (of at most
``FACTOR`` voters, a size of the model), and the model is estimated again. It gives each pattern a posterior probability.
Classifier. A linear model on indicators of words and word beginnings is trained on the posteriors of a bounded
sample of documents (``sample``, ``chars``, ``longest``; those with labels first, one text of each id), and calibrated on those of them that have labels. It scores every whole text.

Defined cases: null text counts as empty; texts without any term of the model have the score of its bias; rows
without a label are scored only; with no labelled toxic row, fixed voters alone decide; repeated rows score alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import EXAMPLE_CHARS, SAMPLE_CHARS, examples, materialize, texts
from facetflow.llm.quality import calibrate

SAMPLE = 16_000

#: Lexicons by kind of abuse.
LEXICONS = {
    "persons": "idiot moron loser clown fool jerk imbecile creep bigot bastard",
    "contempt": "stupid pathetic worthless dumb useless ridiculous hopeless inferior",
    "disgust": "disgusting scum trash filth vermin garbage vile repulsive",
    "threat": "kill murder hang shoot destroy hate",
    "dehumanising": "rats pigs cockroaches parasites subhuman savages swine animals",
    "exclusion": "deport expel banish invaders unwelcome outsiders",
    "shaming": "coward liar traitor disgrace shame ashamed embarrassment",
    "profanity": "damn crap bloody freaking bullshit hell",
}
#: Phrases of abuse.
PHRASES = ("shut up", "go to hell", "drop dead", "get lost", "nobody likes you", "nobody wants you", "i hope you", "people like you")
#: Characters stripped from words' ends.
MARKS = ".,!?:;\"'()[]{}<>*%&$#|"
PATTERNS = ("marks", "shouting", "masked", "aimed", "phrases")
#: Induced terms part at these shares of toxic rows among those that hold them.
TIERS = (0.95, 0.8, 0.0)
STARTS, FACTOR = (4, 5), 4
_MASKED = re.compile(r"[A-Za-z][*#@$]+[A-Za-z]")
_AIMED = re.compile(r"\b(?:you|you're|your|u)\b(?:\W+\w+){0,3}?\W+(?:" + "|".join((LEXICONS["persons"] + " " + LEXICONS["contempt"] + " " + LEXICONS["disgust"]).split()) + r")\b", re.I)


def terms(text: str) -> tuple[set[str], set[str]]:
    """The distinct words of a text and their beginnings; a beginning that two or three words share counts as further ones."""
    words = {w.strip(MARKS) for w in set(text.lower().split())}
    words.discard("")
    shared = Counter(w[:n] for w in words for n in STARTS if len(w) >= n)
    starts = set(shared)
    starts.update(f"{s} 2" for s, k in shared.items() if k > 1)
    starts.update(f"{s} 3" for s, k in shared.items() if k > 2)
    return words, starts


def telling(rows: list[tuple], hot: np.ndarray, kind: int) -> list[tuple[str, float]]:
    """Terms (0: words, 1: beginnings) that come with ``hot`` rows beyond chance, the most telling first, with the share of hot rows.

    A term's n rows, a share p of them hot, are beyond chance if n times the divergence of p from the share of hot rows
    exceeds the log of the number of terms by 4. Rows that hold nearly the same words count once: near copies are no
    further evidence.
    """
    first: set[tuple] = set()
    with_term, without = Counter(), Counter()
    n1 = n0 = 0
    for r, y in zip(rows, hot):
        sign = tuple(min((xxhash.xxh32_intdigest(w, seed) for w in r[0]), default=0) for seed in (1, 2, 3))
        if sign in first:
            continue
        first.add(sign)
        if y:
            n1 += 1
            with_term.update(r[kind])
        else:
            n0 += 1
            without.update(r[kind])
    if not n1 or not n0:
        return []
    base, bar = n1 / (n1 + n0), math.log(len(with_term.keys() | without.keys()) + 1) + 4
    out = []
    for t, a in with_term.items():
        n = a + without[t]
        p = a / n
        if p < max(0.5, base):
            continue
        gain = n * (p * math.log(p / base) + (0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - base))))
        if gain > bar:
            out.append((-gain, t, p))
    return [(t, p) for _, t, p in sorted(out)]


class Voters:
    """Bit j of a text's votes is that of voter ``names[j]``."""

    def __init__(self, words: list[tuple[str, float]], starts: list[tuple[str, float]]):
        self.names = [*LEXICONS, *PATTERNS, *(f"{kind}>={t}" for kind in ("words", "beginnings") for t in TIERS)]
        place = {name: 1 << j for j, name in enumerate(self.names)}
        self.bit = [place[x] for x in PATTERNS]
        self.words: dict[str, int] = {}
        self.starts: dict[str, int] = {}
        for name, of in LEXICONS.items():
            for t in of.split():
                self.words[t] = self.words.get(t, 0) | place[name]
        for kind, found, table in (("words", words, self.words), ("beginnings", starts, self.starts)):
            for t, p in found:
                table[t] = table.get(t, 0) | place[f"{kind}>={next(x for x in TIERS if p >= x)}"]
        self.n = len(self.names)

    def votes(self, text: str) -> int:
        words, starts = terms(text)
        marks, shouting, masked, aimed, phrases = self.bit
        out = 0
        for t in self.words.keys() & words:
            out |= self.words[t]
        for t in self.starts.keys() & starts:
            out |= self.starts[t]
        if "!!" in text or "?!" in text:
            out |= marks
        capitals = sum(map(str.isupper, text))
        if capitals > 20 and capitals > 0.3 * len(text):
            out |= shouting
        if _MASKED.search(text):
            out |= masked
        if out & 7 and _AIMED.search(text):  # one of the first three lexicons has voted
            out |= aimed
        low = text.lower()
        if any(x in low for x in PHRASES):
            out |= phrases
        return out


def label_model(patterns: dict[int, float], known: dict[tuple[int, int], float], voters: int, rounds: int = 60, tie: float = 0.15) -> dict[int, float]:
    """The posterior probability of label 1 for each pattern of votes."""
    keys = sorted(set(patterns) | {p for p, _ in known})
    if not keys:
        return {}
    votes = (np.array(keys)[:, None] >> np.arange(voters)) & 1
    total = np.array([patterns.get(p, 0.0) for p in keys])
    fixed = np.array([[known.get((p, 0), 0.0), known.get((p, 1), 0.0)] for p in keys])
    total = np.maximum(total - fixed.sum(1), 0)  # those with labels are in the corpus too
    # before the first step: the labelled rows, else that more votes mean label 1
    post = 1 / (1 + np.exp(-(2.0 * votes.sum(1) - 2.0)))
    if fixed[:, 1].sum():
        post = (fixed[:, 1] + post) / (fixed.sum(1) + 1)

    def estimate(groups: list[list[int]], post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = [sum(votes[:, v] << i for i, v in enumerate(g)) for g in groups]
        for _ in range(rounds):
            weight = np.stack([fixed[:, 0] + total * (1 - post), fixed[:, 1] + total * post])
            prior = (weight.sum(1) + 1) / (weight.sum() + 2)
            logs = np.log(prior)[:, None] + np.zeros_like(weight)
            for g, code in zip(groups, codes):
                size = 1 << len(g)
                table = np.stack([np.bincount(code, w, size) for w in weight]) + 0.5 / size
                table /= table.sum(1, keepdims=True)
                logs += np.log(table)[:, code]
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return new, weight

    post, weight = estimate([[j] for j in range(voters)], post)
    # correlations that the classes leave: join those voters to factors, the strongest first
    groups = [[j] for j in range(voters)]
    pairs = []
    for w in weight:
        w = w / max(w.sum(), 1e-9)
        mean = w @ votes
        cov = (votes * w[:, None]).T @ votes - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        pairs += [(-abs(corr[i, j]), i, j) for i in range(voters) for j in range(i) if abs(corr[i, j]) > tie]
    for _, i, j in sorted(pairs):
        a, b = (next(g for g in groups if v in g) for v in (i, j))
        if a is not b and len(a) + len(b) <= FACTOR:
            groups.remove(b)
            a += b
    post, _ = estimate(groups, post)
    return dict(zip(keys, post.tolist()))


def train(rows: list[tuple], post: np.ndarray, labels: np.ndarray, rounds: int = 150) -> dict:
    """A linear model on indicators: weights of words and of beginnings, bias, slope, offset. labels: -1 where unknown."""
    n1, n0 = max(1, int((post > 0.5).sum())), max(1, int((post <= 0.5).sum()))
    chosen = [(k, t) for k in (0, 1) for t, _ in telling(rows, post > 0.5, k)]
    place = [{}, {}]
    for i, (k, t) in enumerate(chosen):
        place[k][t] = i
    sets = [np.array(sorted(place[k][t] for k in (0, 1) for t in place[k].keys() & r[k]), dtype=np.int64) for r in rows]
    # rows with the same indicators are one row, with the square root of their number as its weight
    same: dict[bytes, list] = {}
    for x, p in zip(sets, post):
        g = same.setdefault(x.tobytes(), [x, 0.0, 0.0])
        g[1] += 1
        g[2] += p
    cases = [(x, math.sqrt(n), p / n) for x, n, p in same.values()]
    w, b, g2, gb = np.zeros(len(chosen)), math.log(n1 / n0), np.full(len(chosen), 1e-6), 1e-6
    rng = np.random.default_rng(3)
    for _ in range(rounds):  # logistic loss on soft labels, adaptive steps, a little shrinkage
        for i in rng.permutation(len(cases)):
            x, n, target = cases[i]
            g = n * (1 / (1 + math.exp(-max(-40.0, min(40.0, w[x].sum() + b)))) - target)
            if abs(g) < 1e-3:
                continue
            step = g + 1e-4 * w[x]
            g2[x] += step * step
            w[x] -= 0.5 * step / np.sqrt(g2[x])
            gb += g * g
            b -= 0.5 * g / math.sqrt(gb)
    margin = np.array([w[x].sum() + b for x in sets])
    known = labels >= 0
    slope, offset = 1.0, 0.0
    if (labels == 1).any() and (labels == 0).any():
        slope, offset = calibrate(np.clip(margin[known], -20, 20), labels[known] == 1)
    else:
        slope, offset = calibrate(np.clip(margin, -20, 20), post > 0.5)
    return {"words": {t: float(w[i]) for t, i in place[0].items()}, "starts": {t: float(w[i]) for t, i in place[1].items()}, "bias": float(b), "slope": float(slope), "offset": float(offset)}


def score(model: dict, text: str) -> float:
    words, starts = terms(text)
    m = model["bias"] + math.fsum(model["words"][t] for t in model["words"].keys() & words) + math.fsum(model["starts"][t] for t in model["starts"].keys() & starts)
    z = model["slope"] * min(max(m, -20.0), 20.0) + model["offset"]
    return 1 / (1 + math.exp(-min(max(z, -60.0), 60.0)))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.7, chars: int = SAMPLE_CHARS, longest: int = EXAMPLE_CHARS) -> DataFrame:
    """Rows (doc_id, score, predicted), one per row of ``docs``. ``learn``: a condition on the column id of rows to learn from.

    The sample has at most ``sample`` rows and ``chars`` characters, and no text of more than ``longest``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    may = rows.where(learn)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(learn).groupBy("id").agg(F.max("label").alias("label"))
    # rows with labels first, then others
    drawn = may.where("id is not null").select("id").distinct().join(known, "id", "left").select(F.xxhash64("id", F.lit(23)).alias("h"), "id", F.coalesce("label", F.lit(-1)).alias("label"))
    some = drawn.select((F.col("label") < 0).alias("bare"), "h", "id", "label").orderBy("bare", "h", "id").limit(sample)
    picked = materialize(examples(may, some, chars, longest).select("h", "id", "text", "label"), "toxicity-sample")

    def one_task(f):
        got = picked.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: pd.DataFrame({"out": [json.dumps(f(pdf.sort_values(["h", "id"])))]}), "out string").first()
        return json.loads(got["out"]) if got else None

    def parts(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
        one: dict[str, str] = {}  # rows share their terms' strings: a task holds the whole sample
        return [tuple(tuple(one.setdefault(t, t) for t in some) for some in terms(x or "")) for x in pdf["text"]], pdf["label"].to_numpy()

    def lexicons(pdf: pd.DataFrame):
        with_label = pdf[pdf["label"] >= 0]
        found, y = parts(with_label)
        words, starts = (telling(found, y == 1, k) for k in (0, 1))
        return {"words": words, "starts": starts}

    got = one_task(lexicons) or {"words": [], "starts": []}
    voters = spark.sparkContext.broadcast(Voters(got["words"], got["starts"]))

    def vote(batches):
        for pdf, xs in texts(batches):
            yield pdf[["id"]].assign(pattern=np.array([voters.value.votes(x) for x in xs], dtype=np.int64))

    # an id's rows are counted before they meet its label
    voted = may.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(vote, "id string, pattern long").groupBy("id", "pattern").agg(F.count(F.lit(1)).alias("n"))
    labelled = voted.join(known.withColumn("id", F.col("id").cast("string")), "id", "left")
    counted = labelled.groupBy("pattern", "label").agg(F.sum("n").alias("n")).collect()  # at most 2 ** voters patterns
    patterns, anchors = Counter(), {}
    for r in counted:
        patterns[r["pattern"]] += float(r["n"])
        if r["label"] in (0, 1):
            anchors[r["pattern"], r["label"]] = float(r["n"])
    posterior = label_model(patterns, anchors, voters.value.n)

    def linear(pdf: pd.DataFrame):
        found, y = parts(pdf)
        post = np.array([posterior.get(voters.value.votes(x or ""), 0.0) for x in pdf["text"]])
        return train(found, post, y)

    model = one_task(linear) or {"words": {}, "starts": {}, "bias": 0.0, "slope": 1.0, "offset": 0.0}
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series([score(shared.value, t or "") for t in x], dtype=np.float64)

    return rows.select(F.col("id").alias("doc_id"), scored("text").alias("score")).select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
