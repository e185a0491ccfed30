"""Catalog tables: query, statement, write, exists, count."""

from __future__ import annotations

from typing import Any, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def query(spark: SparkSession, sql: str, params: Sequence[Any] | None = None, **frames: DataFrame) -> DataFrame:
    """A lazy SQL result; ``?`` takes positional parameters, ``{name}`` a frame."""
    return spark.sql(sql, args=list(params) if params else None, **frames)


def execute(spark: SparkSession, sql: str, params: Sequence[Any] | None = None) -> None:
    """Run a DDL or DML statement."""
    spark.sql(sql, args=list(params) if params else None)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_table(df: DataFrame, name: str, if_exists: str = "replace", partition_by: str | None = None) -> None:
    """Replace or append to a table. An append keeps the partitioning the table has.

    With ``partition_by`` the rows are rebalanced on that column first: AQE merges small partitions and splits
    large ones, so a day that holds a third of all rows is written by many tasks, and a quiet day as one file.
    """
    modes = {"replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ValueError(f"if_exists must be one of {sorted(modes)}, not {if_exists!r}")
    catalog = df.sparkSession.catalog
    if if_exists == "append" and catalog.tableExists(name):
        partition_by = next((c.name for c in catalog.listColumns(name) if c.isPartition), None)
    if partition_by is not None:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode(modes[if_exists]).format("parquet")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)


def append_batch(df: DataFrame, name: str, batch: str) -> None:
    """Append the rows as one batch. A job that is run again replaces its own batch, so nothing is inserted twice.

    The table is partitioned by ``batch``; only that partition is written, also when the new batch is empty.
    """
    spark = df.sparkSession
    if not table_exists(spark, name):
        df.limit(0).withColumn("batch", F.lit(batch)).write.partitionBy("batch").format("parquet").saveAsTable(name)
    columns = [c for c in spark.table(name).columns if c != "batch"]
    rows = df.select(*[F.col(f"`{c}`") for c in columns])
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = :batch) SELECT * FROM {{rows}}", {"batch": batch}, rows=rows)


def replace_partitions(df: DataFrame, name: str, partition: str) -> None:
    """Write the partitions that df has rows of, replacing each, and leave the others."""
    spark = df.sparkSession
    if not table_exists(spark, name):
        df.limit(0).write.partitionBy(partition).format("parquet").saveAsTable(name)
    columns = spark.table(name).columns
    rows = df.select(*[F.col(f"`{c}`") for c in columns]).hint("rebalance", partition)
    mode = "spark.sql.sources.partitionOverwriteMode"
    usual = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, usual)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Replace a table with one that is bucketed and sorted by key: a lookup of a key reads one bucket, and joins and groupings
    by the key need no shuffle. The rows are dealt to the buckets first, so each bucket is one file."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def row_count(spark: SparkSession, name: str) -> int:
    return count_rows(spark.table(name)).first()["n"]


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order (a top-n per task, then one merge; no full sort)."""
    return df.orderBy(key).limit(n)
