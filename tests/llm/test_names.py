"""Columns of the caller with the names that operators use inside, columns of any type, and accounts followed by capitals."""

import pytest
from pyspark.sql import functions as F

from commlens.llm import exact, minhash, mixing, pii

NAMES = ["_digest", "_place", "_dropped", "_of", "_copies", "_copy", "_mix", "_kept", "_DIGEST_", "given", "kept"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, f"text of number {i % 5} and five more words", "en") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = {n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES}
    return df.select("*", *[c.alias(n) for n, c in own.items()], F.create_map("lang", "doc_id").alias("extra"))


def values(df):
    return sorted((r["doc_id"], *(r[n] for n in NAMES), str(r["extra"])) for r in df.collect())


def test_exact_keeps_all_columns(crowded):
    left = exact.deduplicated(crowded.unionByName(crowded))
    assert left.columns == crowded.columns
    assert values(left) == values(crowded.where("doc_id >= 7"))


def test_near_copies_keep_all_columns(crowded):
    left = minhash.kept(crowded)
    assert left.columns == crowded.columns
    assert values(left) == values(crowded.where("doc_id < 5"))


def test_mixing_keeps_all_columns(spark, crowded):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    left = mixing.resampled(crowded, mixing.fit(crowded, labels, {"en": 1.0}, lowest=1.0))
    assert left.columns == crowded.columns
    assert set(values(left)) == set(values(crowded))


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
        ("IBAN: DE89370400440532013000 EUR", "DE89370400440532013000"),
        ("iban GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"),
        ("IBAN DE89 3704 0044 0532 0130 01 BIC", None),
        ("konto 12345678", "12345678"),
    ],
)
def test_accounts_end_where_they_end(text, span):
    found = [text[s:e] for s, k, e in pii.find(text, pii.automaton()) if pii.KINDS[k] == "account"]
    assert found == ([span] if span else [])
