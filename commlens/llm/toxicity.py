"""Toxicity by maximum-scoring segments.

Training counts in how many toxic and how many other labelled texts each word and each prefix of PREFIX letters occurs (distinct
texts: copies and repeated words teach once).
Log-odds with an informative Dirichlet prior, shrunk by their standard error, give each word a score. In a document, the
linear-time scan of Ruzzo and Tompa finds all maximal-scoring runs of words. Their scores are calibrated as extreme values:
for a clean document of n words the best score is about Gumbel with location mu + beta ln n, so a passage counts as far as it
exceeds that. A logistic curve on that excess gives the probability of label 1.

The classifier is fitted on at most max_labelled labelled documents, the ones with the smallest hashes of doc_id (a documented
bound; below it, all). Counts are hashed to BUCKETS buckets, so the model is an array of fixed size. For the calibration, each fold is
scored with what the others have taught. Every text is scored whole; the score is a function of the text alone.

A null or empty text has no passage and gets the curve's value at no words. Null labels and labels of unknown documents are left
out; repeated labels of a document count as toxic if one of them is. Without a toxic or without a clean training document every
score is the share of toxic ones (0 without labels). Rows are scored one by one, so repeated rows and ties get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, release, stored, tidy

BUCKETS = 1 << 20
PREFIX = 4
FOLDS = 4
MAX_LABELLED = 200_000
THRESHOLD = 0.7
#: Words a task remembers, and bytes of text it holds as strings; they bound memory and change no result.
KNOWN_WORDS, HELD = 150_000, 1 << 20
#: Prior: as many words of the background distribution, plus SMOOTH for each bucket.
PRIOR, SMOOTH = 500.0, 0.5
ERRORS = 1.4
DRIFT = 0.3
BINS, LOWEST, HIGHEST = 400, -20.0, 60.0
WORD = re.compile(r"\w+")
#: Columns of the counts: for each fold, of clean and of toxic texts.
COUNTS = [f"c{g}" for g in range(2 * FOLDS)]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 3


def features(word: str) -> tuple[int, int]:
    """Buckets of the word and of its prefix."""
    return (
        xxhash.xxh3_64_intdigest(word) % BUCKETS,
        xxhash.xxh3_64_intdigest(word[:PREFIX], seed=1) % BUCKETS,
    )


class _Features(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = features(word)
        return value


class WordScores(dict):
    """Score of each word: the stronger of its own and its prefix's log-odds, less the drift."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        own, prefix = (float(self.table[b]) for b in features(word))
        self[word] = value = (own if abs(own) >= abs(prefix) else prefix) - DRIFT
        return value


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Shrunk log-odds of toxic against clean documents, for any of the buckets; the sums are over all buckets."""
    everything = all_toxic + all_clean
    prior = PRIOR * (toxic + clean) / max(everything, 1.0) + SMOOTH
    total = PRIOR * (everything > 0) + SMOOTH * BUCKETS
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (all_toxic + total - a)) - np.log(b / (all_clean + total - b))
    error = np.sqrt(1 / a + 1 / b)
    return (np.sign(delta) * np.maximum(0, np.abs(delta) - ERRORS * error)).astype(np.float32)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (first, end, score) of a sequence, left to right (Ruzzo and Tompa)."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    breaks = np.flatnonzero(np.diff(positive) > 1)
    first = positive[np.concatenate(([0], breaks + 1))]
    end = positive[np.concatenate((breaks, [len(positive) - 1]))] + 1
    # each entry: first, end, sum before, sum after, place of the nearest entry before it with a smaller sum before
    found: list[tuple[int, int, float, float, int]] = []
    for f, e in zip(first.tolist(), end.tolist(), strict=True):
        left, right = total[f], total[e]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((f, e, left, right, j))
                break
            f, left = found[j][0], found[j][2]
            del found[j:]
    return [(f, e, right - left) for f, e, left, right, _ in found]


@dataclass(frozen=True)
class Model:
    """Word table, Gumbel scale and location, logistic slope and intercept. share: the constant score without a table."""

    table: np.ndarray | None
    beta: float = 1.0
    mu: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0
    share: float = 0.0


def statistic(found: list[float], n_words: int, beta: float, mu: float) -> float:
    """Sum of what passages exceed the expected best score by, in Gumbel units; below zero: the best one's distance."""
    over = [(s - mu) / beta - np.log(max(n_words, 1)) for s in found]
    above = sum(x for x in over if x > 0)
    return float(above) if above > 0 else float(max(over, default=-mu / beta - np.log(max(n_words, 1))))


def _labelled(documents: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text, toxic, fold of the labelled documents to learn from. The broadcast side has max_labelled rows at most."""
    known = (
        labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null")
    return stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold")), "toxicity-labelled")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per bucket of all documents of a task: one column for each fold and label."""
    total = np.zeros((2 * FOLDS, BUCKETS), np.int32)
    documents = np.zeros(2 * FOLDS, np.int64)
    known = _Features()
    for batch in (some for whole in batches for some in in_slices(whole, 0, HELD)):
        for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            group = 2 * fold + toxic
            documents[group] += 1
            found = {b for w in set(WORD.findall(text.lower())) for b in known[w]}
            total[group][list(found)] += 1
    some = np.flatnonzero(total.any(axis=0))
    buckets = np.append(some, -1)
    columns = [pa.array(np.append(total[g][some], documents[g])) for g in range(2 * FOLDS)]
    yield pa.RecordBatch.from_arrays([pa.array(buckets), *columns], names=["bucket", *COUNTS])


def _tables(sums: DataFrame, totals: np.ndarray) -> list[np.ndarray]:
    """Score of each bucket, taught by all folds, and by all but one. Scores are computed where the counts are, and only those that differ
    from the score of a bucket without any count come to the driver."""

    def score(counts: np.ndarray) -> np.ndarray:
        """One row for each table, from counts of 2 * FOLDS rows."""
        out = []
        for left in [None, *range(FOLDS)]:
            taught = [f for f in range(FOLDS) if f != left]
            clean, toxic = counts[0::2][taught].sum(axis=0), counts[1::2][taught].sum(axis=0)
            out.append(log_odds(toxic, clean, totals[1::2][taught].sum(), totals[0::2][taught].sum()))
        return np.stack(out)

    usual = score(np.zeros((2 * FOLDS, 1)))[:, 0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(np.stack([batch.column(g + 1).to_numpy() for g in range(2 * FOLDS)]).astype(float))
            other = np.flatnonzero((found != usual[:, None]).any(axis=0))
            columns = [pa.array(found[t][other]) for t in range(1 + FOLDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(other)).cast(pa.int32()), *columns], names=names)

    names = ["bucket", *(f"t{t}" for t in range(1 + FOLDS))]
    rows = sums.select("bucket", *COUNTS).mapInArrow(scored, "bucket int, " + ", ".join(f"{n} float" for n in names[1:]))
    rows = rows.toArrow()  # at most BUCKETS rows of 24 bytes
    place = rows["bucket"].to_numpy()
    tables = [np.full(BUCKETS, u, np.float32) for u in usual]
    for t, values in enumerate(tables):
        values[place] = rows[f"t{t}"].to_numpy()
    return tables


def _newton(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Logistic curve through weighted points (Platt's smoothed targets)."""
    high, low = (ones.sum() + 1) / (ones.sum() + 2), 1 / (zeros.sum() + 2)
    weight, target = ones + zeros, ones * high + zeros * low
    x = np.stack([z, np.ones_like(z)])
    beta = np.array([0.1, np.log((ones.sum() + 1) / (zeros.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        gradient = x @ (target - weight * p) - 1e-3 * beta * [1, 0]
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))) @ x.T + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled rows whose remainder is not 1."""
    spark = documents.sparkSession
    rows = _labelled(documents, labels, max_labelled)
    counted = rows.mapInArrow(tidy(_counts), "bucket long, " + ", ".join(f"{c} long" for c in COUNTS))
    sums = stored(counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in COUNTS)), "toxicity-counts")
    totals = sums.groupBy((F.col("bucket") < 0).alias("texts")).agg(*(F.sum(c).alias(c) for c in COUNTS))
    totals = {r["texts"]: np.array(r[1:], float) for r in totals.collect()}
    n_texts = totals.get(True, np.zeros(2 * FOLDS))
    n_clean, n_toxic = n_texts[0::2].sum(), n_texts[1::2].sum()
    if not n_clean or not n_toxic:
        return Model(None, share=float(n_toxic / max(n_clean + n_toxic, 1)))
    table, *others = _tables(sums.where("bucket >= 0"), totals.get(False, np.zeros(2 * FOLDS)))
    # each fold is scored with what the others have taught
    shared = spark.sparkContext.broadcast(others)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [WordScores(t) for t in shared.value]
        for batch in (some for whole in batches for some in in_slices(whole, 0, HELD)):
            out: list[tuple] = []
            for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, found = scan(text, known[fold])
                out.append((toxic, n, [s for _, _, s in found]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.list_(pa.float64())),
                ],
                names=["toxic", "n", "found"],
            )

    seen = stored(rows.mapInArrow(tidy(scored), "toxic int, n long, found array<double>"), "toxicity-calibration")
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    clean = seen.where("toxic = 0 and n > 0").select(best.alias("x"), F.log(F.col("n")).alias("l"))
    moments = clean.agg(
        F.avg("x").alias("x"),
        F.avg("l").alias("l"),
        F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("xx"),
        F.coalesce(F.var_pop("l"), F.lit(0.0)).alias("ll"),
        F.coalesce(F.covar_pop("x", "l"), F.lit(0.0)).alias("xl"),
    ).first()
    beta, mu = gumbel(moments.x or 0.0, moments.l or 0.0, moments.xx, moments.ll, moments.xl)

    @F.pandas_udf("double")
    def excess(n: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([statistic(list(f), int(k), beta, mu) for k, f in zip(n, found, strict=True)], dtype=float)

    place = F.floor((F.col("z") - LOWEST) / (HIGHEST - LOWEST) * BINS)
    bins = (
        seen.select("toxic", excess("n", "found").alias("z"))
        .select("toxic", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros"))
        .toPandas()
    )
    z = LOWEST + (bins.bin.to_numpy(float) + 0.5) * (HIGHEST - LOWEST) / BINS
    slope, intercept = _newton(z, bins.ones.to_numpy(float), bins.zeros.to_numpy(float))
    return Model(table, beta, mu, slope, intercept)


def gumbel(x: float, l: float, xx: float, ll: float, xl: float) -> tuple[float, float]:  # noqa: E741
    """Scale and location from moments: best = mu + beta ln n + Gumbel(0, beta)."""
    a, b, c = np.pi**2 / 6 - ll, 2 * xl, -xx
    roots = [r.real for r in np.roots([a, b, c] if abs(a) > 1e-12 else [b, c]) if abs(r.imag) < 1e-12 and r.real > 0] if abs(a) + abs(b) > 1e-12 else []
    beta = max(min(roots, default=1.0), 0.25)
    return float(beta), float(x - beta * (l + np.euler_gamma))


def scan(text: str | None, known: WordScores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and all maximal-scoring passages."""
    found = WORD.findall(text.lower()) if text else []
    return len(found), segments(np.fromiter(map(known.__getitem__, found), np.float64, len(found)))


def probability(model: Model, n_words: int, passages: list[tuple[int, int, float]]) -> float:
    if model.table is None:
        return model.share
    z = statistic([s for _, _, s in passages], n_words, model.beta, model.mu)
    z = min(max(z, LOWEST), HIGHEST)
    return float(1 / (1 + np.exp(-np.clip(model.slope * z + model.intercept, -30, 30))))


def scorer(model: Model, spark):
    """A function of a text column: struct of score, n_words, passages (first word, end word, score) that beat chance."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_words long, passages array<struct<first:int,end:int,score:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known = WordScores(model.table if model.table is not None else np.zeros(BUCKETS, np.float32))
        for texts in batches:
            rows = []
            for text in texts:
                n, found = scan(text, known)
                floor = model.mu + model.beta * np.log(max(n, 1))
                passages = [{"first": f, "end": e, "score": s} for f, e, s in found if s > floor]
                rows.append((probability(model, n, found), n, passages))
            yield pd.DataFrame(rows, columns=["score", "n_words", "passages"])
        del known
        release()

    return score


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_words, passages of each document."""
    score = scorer(model, documents.sparkSession)
    return documents.select("doc_id", score("text").alias("_s")).select("doc_id", "_s.*")


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score below the threshold, all columns. No shuffle."""
    score = scorer(model, documents.sparkSession)
    return documents.where(score("text")["score"] < threshold)
