"""Soft-membership mixing.

A classifier fitted on the labelled documents predicts each document's posterior over domains. Rates r >= lowest are then fitted so
that the expected tokens of each domain, sum over documents of tokens * posterior * rate, meet the targets with the least change
from a start rate (least squares, weighted by tokens). The rates of that optimum are max(lowest, start + posterior . slope) with one
slope for each domain, found by damped Newton steps on the convex dual. Each step is one distributed sum of some k * k numbers for k
domains. A rate is a function of its document's posterior and of the slopes only, so no state per document is kept between steps,
and nothing of a document's size reaches the driver. The sums are exact over tasks: their order, or a retried task, cannot change a rate.

Steps end when no domain misses its target by more than TOLERANCE of all tokens, or when the largest miss stops falling (by less than
a hundredth in PATIENCE steps): no rates meet the targets then. `Mix.missing` has what each domain misses, and it is logged.

Domain of a labelled document: "junk" if labels.quality is 0, else its lang if that is one of the targets; other labelled documents
do not teach. Features of a text: square roots of the shares of its 256 byte values. The classifier learns from at most max_labelled
labelled documents, the ones with the smallest hashes of doc_id. Tokens are white-space words.

A null or empty text has no tokens and the classifier's posterior for no bytes; it keeps the rate of that posterior. With one domain
taught, or none, the posterior is constant (all on that domain, or uniform). A domain that is not taught has no tokens to repeat: the
others keep their proportions, and its whole target is missing. An empty table gives an empty result. Repeated rows and ties get equal
rates.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Context, Decimal

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

TARGETS = {"en": 0.5, "fr": 0.15, "de": 0.15, "es": 0.15, "junk": 0.05}
MAX_LABELLED = 50_000
TOLERANCE, PATIENCE = 1e-4, 20
#: Sums over tasks are of decimals of this unit, so that their order, or a retried task, cannot change them.
UNIT, EXACT = Decimal(1).scaleb(-18), Context(prec=38)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

log = logging.getLogger(__name__)


def describe(text: str | None) -> tuple[np.ndarray, int]:
    """Byte features and number of white-space words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(256), 0
    inside = ~SPACES[raw]
    n_words = int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    return np.sqrt(np.bincount(raw, minlength=256) / len(raw)), n_words


@dataclass(frozen=True)
class Mix:
    """Domains, classifier, lowest and start rate, slopes, and by how much each domain's share of the tokens falls short of its target
    (below 0: exceeds it)."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    taught: tuple[bool, ...] = ()
    lowest: float = 0.0
    start: float = 1.0
    slopes: tuple[float, ...] = ()
    missing: tuple[float, ...] = ()

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(self.lowest, self.start + (p @ np.array(self.slopes) if self.slopes else np.zeros(len(p))))


def classifier(documents: DataFrame, labels: DataFrame, domains: tuple[str, ...], max_labelled: int) -> Mix:
    """Multinomial logistic regression of the domain on byte features."""
    known = (
        labels.where("quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    place = F.array_position(F.array(*(F.lit(d) for d in domains)), F.when(F.col("quality") == 0, F.lit("junk")).otherwise(F.col("lang")))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([describe(t)[0] for t in texts])

    rows = documents.select("doc_id", "lang", "text").join(F.broadcast(known), "doc_id")  # max_labelled rows at most
    rows = rows.select((place - 1).cast("double").alias("label"), features("text").alias("x")).where("label >= 0")
    rows = stored(rows, "mixing-labelled")
    taught = [int(r.label) for r in rows.select("label").distinct().collect()]  # one row for each domain
    weights, bias = np.zeros((len(domains), 256)), np.zeros(len(domains))
    if len(taught) == 1:
        bias[:] = -50.0
        bias[taught[0]] = 0.0
    elif taught:
        fitted = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(
            rows.select("label", array_to_vector("x").alias("features"))
        )
        n = fitted.numClasses
        weights[:n], bias[:n] = fitted.coefficientMatrix.toArray(), np.maximum(fitted.interceptVector.toArray(), -50.0)
        absent = [k for k in range(len(domains)) if k not in taught]
        weights[absent], bias[absent] = 0.0, -50.0
    return Mix(domains, weights, bias, tuple(k in taught for k in range(len(domains))))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    total: float | None = None,
    lowest: float = 0.0,
    max_labelled: int = MAX_LABELLED,
) -> Mix:
    """Rates that give each domain its share of `total` expected tokens, by default as many as the input has. With a lowest rate above
    0 and no total, the total is free: domains get their shares with the least added to the lowest rate. Where posteriors are clear,
    that is the least number of tokens with these shares."""
    targets = targets or TARGETS
    share = np.array(list(targets.values()), float)
    share = share / share.sum()
    mix = classifier(documents, labels, tuple(targets), max_labelled)

    @F.pandas_udf("p array<double>, n long")
    def posterior(texts: pd.Series) -> pd.DataFrame:
        found = [describe(t) for t in texts]
        p = mix.posteriors(np.array([x for x, _ in found]).reshape(len(found), 256))
        return pd.DataFrame({"p": list(p), "n": [n for _, n in found]})

    rows = stored(documents.select(posterior("text").alias("_")).select("_.p", "_.n"), "mixing-posteriors")
    n_tokens = float(rows.agg(F.sum("n")).first()[0] or 0)
    if not n_tokens:
        return replace(mix, lowest=lowest, start=max(1.0, lowest))
    k, free = len(share), total is None and lowest > 0
    wanted = share * np.array(mix.taught) if any(mix.taught) else share
    wanted = wanted / (wanted.sum() or 1.0)
    size = 1.0 if total is None else total / n_tokens
    start = lowest if free else size
    # a free total: tokens weigh by how far their posterior is from the targets, and the weighted sum is to be 0
    centre, aim = (wanted, np.zeros(k)) if free else (np.zeros(k), size * wanted)

    def summed(slopes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """At these slopes: value of the dual, what is missing (its negative gradient), its second derivative, shares of all tokens."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(1 + k + k * k)
            for batch in batches:
                if len(batch):
                    p, n = np.stack(batch.p.to_numpy()), batch.n.to_numpy(float)
                    q = p - centre
                    z = q @ slopes
                    above = z >= lowest - start
                    dual = np.where(above, start * z + z * z / 2, lowest * z - (lowest - start) ** 2 / 2)
                    own = (np.maximum(lowest, start + z) * n) @ p
                    out += np.concatenate([[n @ dual], own, ((q * (n * above)[:, None]).T @ q).ravel()])
            yield pd.DataFrame({"place": range(len(out)), "value": [EXACT.quantize(Decimal(x), UNIT) for x in out / n_tokens]})

        sums = rows.mapInPandas(partial, "place int, value decimal(38,18)").groupBy("place").agg(F.sum("value").alias("value"))
        out = np.zeros(1 + k + k * k)
        for r in sums.collect():  # 1 + k + k * k rows
            out[r.place] = float(r.value)
        own = out[1 : 1 + k]
        return out[0] - aim @ slopes, aim - (own - centre * own.sum()), out[1 + k :].reshape(k, k), own

    slopes, damping = np.zeros(k), 1e-6
    value, missing, second, own = summed(slopes)
    best = marked = np.inf
    steps = since = 0
    while True:
        # the wanted total where it is given, else the total that came out
        miss = float(np.abs(missing).max() / (own.sum() if free else size or 1.0))
        if miss < best:
            best, found, reached = miss, slopes, own
        since = 0 if best <= 0.99 * marked else since + 1
        if not since:
            marked = best
        if best <= TOLERANCE or since >= PATIENCE:
            break
        steps += 1
        move = np.linalg.lstsq(second + damping * np.eye(k), missing, rcond=None)[0]
        next_value, *rest = summed(slopes + move)
        gain, expected = value - next_value, missing @ move - move @ second @ move / 2
        if gain > 0:
            slopes, value, (missing, second, own) = slopes + move, next_value, rest
        damping = max(damping / 10, 1e-12) if gain > expected / 2 else damping * (10 if gain < expected / 10 else 1)
    left = tuple(map(float, share - reached / (reached.sum() if free else size or 1.0)))
    text = ", ".join(f"{d} {x:+.5f}" for d, x in zip(mix.domains, left, strict=True))
    log.log(
        logging.INFO if max(map(abs, left)) <= TOLERANCE else logging.WARNING,
        "mixing: %d steps, %.4g tokens for each of the input, shares missing: %s", steps, reached.sum(), text,
    )
    # posterior - centre, times the slopes: the centre's part is the same for all documents
    return replace(mix, lowest=lowest, start=float(start - centre @ found), slopes=tuple(map(float, found)), missing=left)


def mixed(documents: DataFrame, mix: Mix) -> DataFrame:
    """All columns of documents, and struct `_mix` of n_tokens, posteriors, rate. No shuffle."""

    @F.pandas_udf("n_tokens long, posteriors array<double>, rate double")
    def rate(texts: pd.Series) -> pd.DataFrame:
        found = [describe(t) for t in texts]
        p = mix.posteriors(np.array([x for x, _ in found]).reshape(len(found), 256))
        return pd.DataFrame({"n_tokens": [n for _, n in found], "posteriors": list(p), "rate": mix.rates(p)})

    return documents.withColumn("_mix", rate("text"))


def copies(seed: int = 0):
    """How often a document is taken: the rate rounded up or down at random, fixed by doc_id, text and seed."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 53)) / float(1 << 53)
    rate = F.col("_mix.rate")
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def resampled(documents: DataFrame, mix: Mix) -> DataFrame:
    """Each document as often as its rate says, columns unchanged, whatever their names."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    count, copy = (free_name(n, documents.columns) for n in ("_copies", "_copy"))
    # the caller's columns are set aside in a struct, so none of them can be taken for one of the operator's
    whole = documents.select(F.struct(*columns).alias("given"), F.col("doc_id"), F.col("text"))
    rows = mixed(whole, mix).withColumn(count, copies()).where(F.col(count) > 0)
    repeated = rows.select("given", F.explode(F.array_repeat(F.lit(0), F.col(count))).alias(copy))
    return repeated.select(*(F.col("given").getField(c).alias(c) for c in documents.columns))
