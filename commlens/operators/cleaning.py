"""Cleaning: dates, text, flags, duplicates, column alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from commlens.functions.text import strip
from commlens.schema import BINARY_COLUMNS, ID, REQUIRED_COLUMNS
from commlens.session import durable

# hashes of repeated keys that keep_first_of_few broadcasts: 16 MB as a hash table
REPEATED = 1 << 19


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def normalise_rows(df: DataFrame) -> DataFrame:
    """Date to day, text stripped, flags to int. One projection; a bad date raises, as in a strict parse."""
    changes: dict[str, Column] = {c: strip(F.col(c)) for c in text_columns(df)}
    changes |= {c: F.col(c).cast("int") for c in BINARY_COLUMNS if c in df.columns}
    if "sent_date" in df.columns:
        changes["sent_date"] = F.col("sent_date").cast("date")
    return df.withColumns(changes)


def keep_first(df: DataFrame, key: str = ID) -> DataFrame:
    """One row per key: the first by sent_date, then by the remaining columns in table order.

    Spark turns ``row_number = 1`` into a limit of one row per key in every map task before the shuffle, so a key
    with a third of all rows sends one row per task, not the rows.
    """
    order = [c for c in ["sent_date", *REQUIRED_COLUMNS, *df.columns] if c in df.columns and c != key]
    first = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in dict.fromkeys(order)])
    return df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")


def keep_first_of_few(df: DataFrame, key: str = ID, most: int = REPEATED) -> DataFrame:
    """``keep_first`` for a table in which few keys repeat: only rows of repeated keys are shuffled.

    A first pass counts 64-bit hashes of the key, a few bytes a row. The hashes that occur more than once, all repeated keys and
    by chance some others, are counted before they are broadcast. Rows with another hash pass through as they
    are; the rest go through the window. Beyond ``most`` such hashes the whole table does. The input is read three times, so
    it should be stored.
    """
    hashed = F.xxhash64(F.col(key))
    counts = df.select(hashed.alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n"))
    repeated = durable(counts.where(F.col("_n") > 1).select("_hash"))
    if repeated.count() > most:
        return keep_first(df, key)
    # at most ``most`` numbers of eight bytes, counted above
    marked = df.withColumn("_key_hash", hashed)
    same = marked["_key_hash"] == repeated["_hash"]
    unique = marked.join(F.broadcast(repeated), same, "left_anti").drop("_key_hash")
    others = marked.join(F.broadcast(repeated), same, "left_semi").drop("_key_hash")
    return unique.unionByName(keep_first(others, key))


def clean(df: DataFrame) -> DataFrame:
    return keep_first(normalise_rows(df))


def drop_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def add_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add absent columns with a constant; columns that exist keep their NULLs."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones as 0."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in names])


def lenient_date(value: Column) -> Column:
    return value.try_cast("date")
