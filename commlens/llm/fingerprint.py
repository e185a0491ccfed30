"""Fingerprints by consistent weighted sampling (Ioffe's gamma-based scheme).

A text is a weighted set: its pairs of adjacent white-space words (a text of one word: that word), weighted by how often they
occur. For each of SAMPLES samples, every term draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from its hash; with
t = floor(ln w / r + b), the term with the smallest ln c - r (t - b + 1) is sampled, together with t. Two texts share a sample with
a probability equal to the generalised Jaccard similarity of their sets, sum of minima over sum of maxima. A fingerprint is 16 bits of
each sample in hex. Draws come from a table of TABLE triples; terms that draw the same one are told apart by their hashes.

A null text is empty; texts without words share the fingerprint of zeros. Likeness is the share of equal samples; it is 1 for two
empty sets and 0 for one. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, mix, shingles, words

SAMPLES = 64
TABLE = 1 << 16
#: Terms whose draws are held at once: it bounds the memory of very long texts.
BLOCK = 4096
NO_TERMS = "0" * (4 * SAMPLES)

_rng = np.random.default_rng(20240101)
_R = _rng.gamma(2.0, 1.0, TABLE)
_LN_C = np.log(_rng.gamma(2.0, 1.0, TABLE))
_B = _rng.random(TABLE)
#: The value of a term of weight 1, for which t = 0.
_ONCE = (_LN_C - _R * (1 - _B)).astype(np.float32)
_SEEDS = mix(np.arange(1, SAMPLES // 4 + 1, dtype=np.uint64) * GOLDEN)


def draws(terms: np.ndarray) -> np.ndarray:
    """Table places, one row for each term and one column for each sample."""
    return mix(terms[:, None] ^ _SEEDS[None, :]).view(np.uint16).reshape(len(terms), SAMPLES)


def sample(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bits of each sample of a weighted set; terms must be sorted, which decides ties."""
    best = np.full(SAMPLES, np.inf, np.float32)
    name = np.zeros(SAMPLES, np.uint64)
    column = np.arange(SAMPLES)
    for low in range(0, len(terms), BLOCK):
        some, weight = terms[low : low + BLOCK], weights[low : low + BLOCK]
        place = draws(some)
        value = _ONCE[place]
        step = np.zeros(0, np.int64)
        many = np.flatnonzero(weight > 1)
        if len(many):
            at = place[many]
            r, b = _R[at], _B[at]
            step = np.floor(np.log(weight[many])[:, None] / r + b)
            value[many] = (_LN_C[at] - r * (step - b + 1)).astype(np.float32)
        winner = value.argmin(axis=0)
        least = value[winner, column]
        better = least < best
        times = np.zeros(SAMPLES, np.uint64)
        if len(many):
            row = np.searchsorted(many, winner)
            inside = (row < len(many)) & (many[np.minimum(row, len(many) - 1)] == winner)
            times[inside] = step[row[inside], column[inside]].astype(np.int64).view(np.uint64)
        best = np.where(better, least, best)
        name = np.where(better, mix(some[winner] + times * GOLDEN), name)
    return (name >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str | None, hashes: WordHashes) -> str:
    terms = shingles(hashes.of(words(text)), 2)
    if not len(terms):
        return NO_TERMS
    terms, weights = np.unique(terms, return_counts=True)
    return sample(terms, weights).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal samples."""
    if NO_TERMS in (a, b):
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document. No shuffle."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([fingerprint(t, hashes) for t in texts], dtype=object)

    return documents.select("doc_id", of("text").alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (bucket, doc_id, text, own) dealt so that each bucket holds a range of doc_ids, and the first row of the next bucket
    (own = false), sorted by descending doc_id.

    One shuffle of the texts; the edges of the buckets are `parts` quantiles, and one doc_id for each of them is looked up.
    A null doc_id comes last; rows that share one are ordered by text.
    """
    spark = documents.sparkSession
    # nulls sort last: below every other id
    ids = documents.select("doc_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("doc_id").alias("known"),
    ).first()
    if not ids.rows:
        return documents.select(F.lit(0).alias("bucket"), "doc_id", "text", F.lit(True).alias("own"))
    parts = parts or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.rows // 50_000)
    cuts: list[int] = []
    if ids.known:
        shares = ",".join(str(i / parts) for i in range(1, parts)) or "0.5"
        quantiles = documents.agg(F.expr(f"percentile_approx(doc_id, array({shares}), 10000)").alias("q")).first().q
        cuts = sorted(set(quantiles))
    # number of cuts at or above the id: the first bucket has the largest ids
    above = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above)
    rows = documents.select("doc_id", "text", bucket.alias("bucket"))
    first = {
        r.bucket: r.head
        for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()  # one row for each bucket
    }
    order = sorted(first)
    # the head of a bucket is the next document of the bucket before it; that of the first follows the last
    heads = [(order[i - 1], first[b]) for i, b in enumerate(order)]
    borrowed = F.filter(
        F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(h).cast("long").alias("head")) for b, h in heads)),
        lambda h: h["head"].eqNullSafe(F.col("doc_id")),
    )
    mine = F.array(F.struct(F.col("bucket"), F.lit(True).alias("own")))
    others = F.transform(borrowed, lambda h: F.struct(h["bucket"].alias("bucket"), F.lit(False).alias("own")))
    rows = rows.select("doc_id", "text", F.explode(F.concat(mine, others)).alias("p")).select("p.bucket", "doc_id", "text", "p.own")
    return rows.repartition(max(1, parts // 4), "bucket").sortWithinPartitions(
        "bucket", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text"
    )


def with_edits(documents: DataFrame) -> DataFrame:
    """Each document beside its edited text: the contract of op9.

    The next document of a row is the first one, by text, of the next smaller doc_id; of the smallest, that of the largest.
    Rows that share a doc_id have the same next document. A table with one doc_id is its own next document.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bucket, waiting = None, []  # rows of one doc_id that wait for the next one

        def finished(next_text: str, next_print: str) -> list[tuple]:
            out = []
            for doc_id, text, own_print in waiting:
                changed = edited(text, next_text)
                changed_print = own_print if changed == text else fingerprint(changed, hashes)
                out.append(
                    (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own_print, changed_print,
                     likeness(own_print, changed_print), likeness(own_print, next_print))
                )
            return out

        for batch in batches:
            out: list[tuple] = []
            for at, doc_id, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if at != bucket:
                    bucket, waiting = at, []
                if waiting is None:
                    continue
                mark = waiting[-1][2] if waiting and waiting[-1][1] == text else fingerprint(text, hashes)
                if waiting and (not own or doc_id != waiting[-1][0]):
                    out += finished(text, mark)
                    waiting = []
                if own:
                    waiting.append((doc_id, text, mark))
                else:
                    waiting = None  # only the first borrowed row counts
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    kinds = [arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    ddl = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(documents).mapInArrow(run, ddl)
