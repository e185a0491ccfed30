"""A training-data pipeline over `documents`: five stages, each written and read again before the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from commlens.llm import exact, minhash, mixing, packing, toxicity
from commlens.llm.common import shared_folder, table


#: Documents from this score on are rejected. On held-out labels of sf0.1 and check_s it finds 93.1 and 99.9 % of the toxic documents
#: (91.0 and 98.9 % at 0.7) and rejects 0.4 and 0.3 % of the others (0.3 and 0.2 %).
REJECTED = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labelled ones among docs, does not reject."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), REJECTED)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id."""
    return minhash.kept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that domains meet their target shares; the lowest rate is 1, so that none is lost."""
    return mixing.resampled(docs, mixing.fit(docs, table(spark, sf_dir, "labels"), lowest=1.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.packed(docs, special_tokens=True, remember=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The first, fourth and fifth stage have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            path = f"{folder}/{place}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
