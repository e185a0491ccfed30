"""Global positions without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from commlens.session import durable

# the low bits of monotonically_increasing_id count the rows of a partition
ROW_BITS = 33


def with_position(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """Add each row's place (from 1) among the rows of its group, in ``order``.

    Rows are range-partitioned by group and order, so a group of any size is sorted by many tasks. Two prefix sums
    give the places: a row's number within its partition, and the rows of the group in the partitions before, one row per
    partition and group. The sorted rows are checkpointed, so both sums see the same partitions.
    """
    keys = [F.col(group), *order]
    ranged = durable(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    parts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and group
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        ranged.join(F.broadcast(parts), [group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1)
        .drop("_part", "_row", "_first", "_before")
    )
