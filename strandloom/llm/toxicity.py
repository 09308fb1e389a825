"""Toxicity by maximum-scoring segments.

A bounded sample of labelled documents gives each word a log-odds ratio of toxic against clean text, smoothed by a
Dirichlet prior that follows the word's overall frequency and shrunk towards zero by some standard errors; what is left,
less a small cost, is the word's score, and a word never met costs the same. One linear scan of a text finds every maximal
segment of positive score. The best segment of a clean text follows an extreme-value law: its parameter lambda is solved from
the scores of clean words, K is fitted to the best segments of the sample's clean texts, and both give each segment
the number of equals to expect by chance in a text of this length. The significant ones are aggregated. A logistic curve
over the aggregate, fitted on texts of the sample that the words' scores were not taken from (by folds), gives the score.

The sample is bounded by FIT_ROWS labelled rows in the order of a hash; every whole text is scored. On both sides a word
counts once per text that has it, and texts with the same least hash of their shingles, as copies and most near copies have,
count as one: neither copies of a toxic document nor a word that one document repeats become significant, and a
word of a set phrase counts as any other. Scores are whole hundredths and sums are made in a fixed order, so the result does
not depend on how the table is dealt out.

Defined results. Null or empty text: the score of a text without toxic words. Null doc_id: scored, not held out. A doc_id
with several labels is toxic if any is. No labels, or labels of one kind: every score is their share of toxic ones (0 if
none). Repeated rows: rows of their own. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, written
from .simhash import NEAR_WIDTH, shingle_hashes

FIT_ROWS, FOLDS = 40_000, 5
#: What the prior adds to every count, and the share of a word's counts that it adds to that; standard errors that a ratio is
#: shrunk by; cost of a word; chance level.
LEAST_PRIOR, PRIOR, SHRINK, COST, CHANCE = 0.5, 0.02, 3.0, 0.25, 1.0
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")
_UNIT = 100  # scores are kept in hundredths


@dataclass(frozen=True)
class Model:
    """scores: of words, in hundredths, their cost taken off. lam, k: of the extreme-value law. curve: the logistic curve."""

    scores: dict[str, int] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.01
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal segments (first, last, score) of positive score, by the linear-time rule of Ruzzo and Tompa.

    A stacked segment links to the nearest before it that begins at a lower sum, so a search passes over each only once; where
    none begins lower, all before are final.
    """
    ups = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0], np.cumsum(scores, dtype=np.int64)])
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int, int, int, int]] = []  # first, last, sum before, sum after, link
    for at, before, after in zip(ups.tolist(), sums[ups].tolist(), sums[ups + 1].tolist()):
        first = at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0:
                out += [(x[0], x[1], x[3] - x[2]) for x in stack]
                stack = [(first, at, before, after, -1)]
                break
            if stack[j][3] >= after:
                stack.append((first, at, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return out + [(x[0], x[1], x[3] - x[2]) for x in stack]


def word_scores(text: str | None, scores: dict[str, int]) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(scores.get, words, repeat(-int(_UNIT * COST))), np.int64, len(words))


def passages(values: np.ndarray, model: Model) -> list[tuple[int, int, float, float]]:
    """(first word, last word, score, score in the law's own unit: the log of one over the expected number by chance)."""
    chance = log(model.k * len(values) + 1e-9)
    return [(a, b, s / _UNIT, model.lam * s / _UNIT - chance) for a, b, s in segments(values)]


def aggregate(text: str | None, model: Model) -> tuple[float, float, int]:
    """Raw score of all segments (log scale), the sum of the significant ones' normalised scores (log scale), their number."""
    values = word_scores(text, model.scores)
    if not len(values) or values.max() <= 0:
        return 0.0, 0.0, 0
    found = passages(values, model)
    good = [x for *_, x in found if x > -log(CHANCE)]
    return log1p(sum(s for _, _, s, _ in found)), log1p(sum(good)), len(good)


def toxic_passages(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """(first word, last word, expected number by chance) of every significant passage."""
    values = word_scores(text, model.scores)
    return [(a, b, exp(-x)) for a, b, _, x in passages(values, model) if x > -log(CHANCE)] if len(values) else []


def solve_lambda(share: dict[float, float]) -> float:
    """The positive root of E[exp(lambda * score)] = 1 for clean text, where share has the probability of each score."""
    gain = lambda x: sum(p * exp(min(700.0, x * s)) for s, p in sorted(share.items())) - 1
    low, high = 1e-6, 1.0
    while gain(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if gain(mid) < 0 else (low, mid)
    return high


def fit_k(best: dict[tuple[int, float], int], lam: float) -> float:
    """K by maximum likelihood: best counts texts by (words, score of the best segment), each an expected number K n exp(-lambda s)."""
    whole = sum(times * n * exp(-lam * s) for (n, s), times in sorted(best.items()))
    return min(1.0, max(1e-6, sum(best.values()) / whole)) if whole else 0.01


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Intercept and two weights by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(3), design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> DataFrame:
    """text, toxic, fold of the labelled texts that count: one for each least shingle hash and label. A written table."""
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = written(chosen, "fit-labels")
    sample = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `most` labels

    def kernel(batches):
        for batch in batches:
            keys, least = [], []
            for t in batch.column(0).to_pylist():
                hashes = shingle_hashes(t, NEAR_WIDTH)
                least.append(int(hashes.min()) - (1 << 63) if len(hashes) else 0)
                keys.append(hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string()), pa.array(least, pa.int64())], ["text", "toxic", "text_key", "least"])

    rows = written(map_arrow(sample.select("text", (F.col("toxic") > 0).alias("toxic")), kernel, "text string, toxic boolean, text_key string, least long"), "fit-rows")
    picked = written(rows.groupBy("least", "toxic").agg(F.min("text_key").alias("text_key")), "fit-picked")  # at most `most` rows
    once = rows.join(F.broadcast(picked), ["least", "toxic", "text_key"]).dropDuplicates(["text_key", "toxic"])
    return written(once.select("text", "toxic", F.pmod("least", F.lit(FOLDS)).cast("int").alias("fold")), "fit-texts", rows)


def word_counts(sample: DataFrame, folds: int = FOLDS) -> DataFrame:
    """word, fold, y0, y1: in how many clean and toxic texts of each fold of the sample each word is."""

    def holders(batches):
        for batch in batches:
            n: Counter = Counter()
            for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n.update((w, fold, toxic) for w in set(tokens(text)))
            keys = list({k[:2] for k in n})
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *[pa.array([n[(*k, toxic)] for k in keys], pa.int64()) for toxic in (False, True)]]
            yield pa.RecordBatch.from_arrays(columns, ["word", "fold", "y0", "y1"])

    return map_arrow(sample, holders, "word string, fold int, y0 long, y1 long").groupBy("word", "fold").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))


def scores_of(counts: DataFrame) -> dict[str, int]:
    """The shrunk log-odds of words, less their cost, from (word, y0, y1)."""
    n0, n1, words = (x or 0 for x in counts.agg(F.sum("y0"), F.sum("y1"), F.count(F.lit(1))).first())
    if not n0 or not n1:
        return {}
    prior = LEAST_PRIOR + PRIOR * (F.col("y0") + F.col("y1"))
    whole = LEAST_PRIOR * words + PRIOR * (n0 + n1)
    a, b = F.col("y1") + prior, F.col("y0") + prior
    ratio = F.log(a / (n1 + whole - a)) - F.log(b / (n0 + whole - b))
    shrunk = F.signum(ratio) * F.greatest(F.abs(ratio) - SHRINK * F.sqrt(1 / a + 1 / b), F.lit(0.0))
    score = F.round(_UNIT * (shrunk - COST)).cast("long")
    # words of the sample's bounded rows; those whose ratio is shrunk to nothing score as a word never met
    return dict(counts.select("word", score.alias("score")).filter(F.col("score") != -int(_UNIT * COST)).orderBy("word").collect())


def profiles(sample: DataFrame, models: list[dict[str, int]]) -> list[Model]:
    """Each model with lambda and K, from the clean texts of the fold that it was not taken from; the last is from all."""

    def profile(batches):
        n: Counter = Counter()
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for i, scores in enumerate(models):
                    if i in (fold, FOLDS) and len(values := word_scores(text, scores)):
                        n.update({(i, 0, v, 0): times for v, times in zip(*(x.tolist() for x in np.unique(values, return_counts=True)))})
                        n[i, 1, len(values), max((s for *_, s in segments(values)), default=0)] += 1
        columns = [*zip(*n)] if n else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*columns, n.values())], ["model", "kind", "a", "b", "n"])

    # a row per score, and one per number of words and best segment: no more than the sample's bounded rows
    clean = map_arrow(sample.filter("NOT toxic"), profile, "model long, kind long, a long, b long, n long").groupBy("model", "kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    out = []
    for i, scores in enumerate(models):
        share = {r["a"] / _UNIT: r["n"] for r in clean if (r["model"], r["kind"]) == (i, 0)}
        best = {(r["a"], r["b"] / _UNIT): r["n"] for r in clean if (r["model"], r["kind"]) == (i, 1)}
        lam = solve_lambda({s: n / sum(share.values()) for s, n in share.items()}) if any(s > 0 for s in share) else 1.0
        out.append(Model(scores, lam, fit_k(best, lam)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> Model:
    """The model from docs and labels (doc_id, toxic): at most `most` labels, by hash.

    The curve is fitted to texts that the words' scores were not taken from: scores of each fold's other texts, so that
    words which are toxic in the sample by chance count for what they are worth elsewhere.
    """
    sample = fit_sample(docs, labels, id_col, text_col, most)
    n_toxic, n_all = (x or 0 for x in sample.agg(F.sum(F.col("toxic").cast("int")), F.count(F.lit(1))).first())
    if not n_toxic or n_toxic == n_all:
        share = n_toxic / n_all if n_all else 0.0
        return Model(curve=(log(share / (1 - share)) if 0 < share < 1 else 20.0 if share else -20.0, 0.0, 0.0))
    counts = written(word_counts(sample), "fit-words")
    sums = lambda rows: rows.groupBy("word").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    *parts, model = profiles(sample, [scores_of(sums(counts.filter(F.col("fold") != i))) for i in range(FOLDS)] + [scores_of(sums(counts))])

    def points(batches):
        for batch in batches:
            got = [aggregate(t, parts[fold])[:2] for t, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([round(x, 2) for x, _ in got]), pa.array([round(x, 2) for _, x in got]), batch.column(1)], ["a", "b", "toxic"])

    # a row per pair of rounded values, fewer than the sample's bounded rows
    seen = sorted(map_arrow(sample, points, "a double, b double, toxic boolean").groupBy("a", "b", "toxic").count().collect())
    times = np.array([r["count"] for r in seen])
    x = np.repeat(np.array([[r["a"], r["b"]] for r in seen]), times, axis=0)
    y = np.repeat(np.array([float(r["toxic"]) for r in seen]), times)
    return Model(model.scores, model.lam, model.k, logistic(x, y))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every row."""

    def kernel(batches):
        for batch in batches:
            got = [aggregate(t, model) for t in batch.column(2).to_pylist()]
            c, wa, wb = model.curve
            scores = [1 / (1 + exp(-max(-30.0, min(30.0, c + wa * a + wb * b)))) for a, b, _ in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array([n for _, _, n in got], pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "n_passages"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return map_arrow(rows, kernel, "doc_id long, held_out boolean, score double, predicted int, n_passages int")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_texts(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))
