"""Intermediate tables and stage markers in the folder all executors share."""

from __future__ import annotations

import json
import uuid
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this application wrote and no longer reads."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def staged(df: DataFrame, name: str) -> str:
    """Write df as Parquet below the shared folder; the path of the new folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


class Manifest:
    """What a run has finished, so that the same run started again goes on where it stopped.

    A stage counts as finished when its marker is written, after all its outputs. A marker holds the stage's small result.
    """

    def __init__(self, spark: SparkSession, run_id: str | None):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/runs/{run_id}" if run_id else None

    def stage(self, name: str, work: Callable[[], Any]) -> Any:
        """The result of work(), or what it was when this stage finished before."""
        if self.folder is None:
            return work()
        marker = f"{self.folder}/{name}"
        if exists(self.spark, f"{marker}/_SUCCESS"):
            return json.loads(self.spark.read.text(marker).first()["value"])
        result = work()
        row = self.spark.createDataFrame([(json.dumps(result),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(marker)
        return result
