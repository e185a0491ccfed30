"""Session defaults and the folder that durable intermediate results go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # HotSpot never compiles a method above 8,000 bytecodes; beyond that, separate operators beat a fused stage
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("commlens")
    for key, value in {**SESSION_CONF, "spark.driver.memory": memory, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the cluster's shared folder, so that a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        folder = spark.conf.get("spark.checkpoint.dir", None) or shared
        context.setCheckpointDir(folder)
    return df.checkpoint()
