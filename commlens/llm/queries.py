"""The registered queries of this subpackage: thin contracts over the operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, exact, fingerprint, minhash, mixing, packing, pii, substring, toxicity, trie, warc, whitening
from .common import table
from .oracles import ORACLES  # noqa: F401


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), min_revisit=0).drop("url")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), with_ids=False, special_tokens=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = mixing.mixed(documents, mixing.fit(documents, labels))
    shares = [F.col("_mix.posteriors")[i].alias(f"p_{d}") for i, d in enumerate(mixing.TARGETS)]
    return rows.select(
        "doc_id", F.col("_mix.n_tokens").alias("n_tokens"), *shares, F.col("_mix.rate").alias("rate"), mixing.copies().alias("copies")
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(k) for k in pii.BASE_KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        *(count(k) for k in pii.KINDS[len(pii.BASE_KINDS) :]),
    )


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.scored(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(toxicity.remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed(table(spark, sf_dir, "documents"), with_ids=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.node_table(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_chat, op3_packing, op4_mixing, op5_minhash,
        op6_exact, op7_pii, op8_substring, op9_fingerprint, op10_toxicity,
        op11_bestfit, op12_whitening, op13_trie,
    )
}
