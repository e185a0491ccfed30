"""Exact duplicates by a heavy-hitter split. DataFrame and SQL functions only.

Texts are equal when identical after lower-casing A-Z; a null text is the empty text. A Misra-Gries sketch (Spark's
approx_top_k) names at most CANDIDATES frequent digests. They are counted exactly, and those that really repeat are
broadcast (at most CANDIDATES rows of three columns), so that their rows never enter a shuffle. All other digests are
frequent nowhere and go through an ordinary shuffle. Both ways are exact: the sketch decides only which way a digest takes.

Rows that repeat a doc_id: one of them stays if that doc_id is the largest of its group. A null doc_id is smaller than any
other; a group of nulls alone keeps one row, its keep_id is null. An empty table gives an empty result. Other columns may have any
name and type: own columns take names that are free, and columns with maps are ordered by their JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, free_name, stored

CANDIDATES = 512
TRACKED = 8192


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and a row number that tells repeated rows apart."""
    return stored(
        documents.select(
            "doc_id",
            F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )


def groups(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(documents)
    frequent = rows.agg(F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {TRACKED})").alias("top")).select(
        F.explode("top.item").alias("text_sha256")
    )
    counted = _summed(rows.join(F.broadcast(frequent), "text_sha256"))
    winners = stored(counted.where("group_size > 1"), "frequent")
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.join(_summed(light), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        "text_sha256",
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, all columns. Rows alike in doc_id and text: the first by the other columns."""
    columns = documents.columns
    digest, place, gone, other = (free_name(n, columns) for n in ("_digest", "_place", "_dropped", "_of"))
    rest = [_orderable(f) for f in documents.schema if f.name not in ("doc_id", "text")]
    by = Window.partitionBy(digest, "doc_id").orderBy(*(rest or [F.lit(0)]))
    keyed = documents.withColumn(digest, F.sha2(ascii_lower(F.col("text")), 256))
    single = keyed.withColumn(place, F.row_number().over(by)).where(F.col(place) == 1)
    dropped = (
        groups(documents)
        .where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(other))
    )
    same = (F.col(digest) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(gone))
    return single.join(dropped, same, "left_anti").select(*(F.col(f"`{c}`") for c in columns))


def _orderable(field: T.StructField) -> Column:
    """The column itself, or its JSON where it holds a map, which Spark cannot order."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column
