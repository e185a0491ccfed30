"""The whole application: ingest, train, detect, score, write texts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from commlens.operators.anomaly import anomaly_text, detector_status
from commlens.operators.narrative import case_summaries
from commlens.operators.reports import sample_case
from commlens.operators.scoring import load_forest, score_batch
from commlens.operators.training import train
from commlens.plans.ingest import ingest
from commlens.settings import DEFAULTS, Settings
from commlens.sources.staging import Manifest
from commlens.sources.tables import row_count, write_table


@dataclass(frozen=True)
class RunSummary:
    rows: int
    metrics: dict[str, Any]
    detectors_flagged: int
    anomaly_text: str


def run(
    raw: DataFrame,
    model_path: str,
    settings: Settings = DEFAULTS,
    skip_texts: bool = False,
    parallelism: int = 1,
    run_id: str | None = None,
    **ingest_options: Any,
) -> RunSummary:
    """One Spark application. Next to the cases table it writes ``_detectors``, ``_scores`` and ``_texts``.

    Every stage reads the table the stage before wrote, so no stage repeats another's work and a lost executor
    costs at most the running stage's tasks. A run with a ``run_id`` that is started again, in any session, skips the
    stages it had finished.
    """
    spark, name, done = raw.sparkSession, settings.table_name, Manifest(raw.sparkSession, run_id)

    def ingested() -> int:
        ingest(raw, settings, **ingest_options)
        return row_count(spark, name)

    def trained() -> dict[str, Any]:
        return train(spark.table(name), model_path, settings, parallelism=parallelism).metrics

    def detected() -> list[Any]:
        write_table(detector_status(spark.table(name), settings=settings), f"{name}_detectors")
        status = spark.table(f"{name}_detectors")
        # three rows, one line of text
        return [anomaly_text(status).first()["anomaly_text"], status.where("flagged").count()]

    def scored() -> None:
        forest = load_forest(spark, model_path)
        write_table(score_batch(spark.table(name), forest, settings=settings), f"{name}_scores")

    def written() -> None:
        write_table(case_summaries(spark.table(f"{name}_scores"), text), f"{name}_texts")

    rows = done.stage("ingest", ingested)
    metrics = done.stage("train", trained)
    text, flagged = done.stage("detect", detected)
    done.stage("score", scored)
    if not skip_texts:
        done.stage("texts", written)
    return RunSummary(rows, metrics, flagged, text)


def sample_texts(scored: DataFrame, text: str = "") -> DataFrame:
    """The texts of the first case that needs intervention and the first that does not."""
    samples = sample_case(scored, 1).unionByName(sample_case(scored, 0))
    return case_summaries(samples, text)
