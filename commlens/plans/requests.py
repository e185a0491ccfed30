"""What a service would answer, for a whole feed of requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from commlens.operators.admission import split
from commlens.operators.anomaly import detector_rollup, detector_status
from commlens.operators.narrative import case_summaries
from commlens.operators.scoring import Forest, score_batch
from commlens.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Answers:
    answered: DataFrame
    quarantined: DataFrame


def score_requests(feed: DataFrame, forest: Forest, settings: Settings = DEFAULTS) -> Answers:
    """customer_id, intervention_score, needs_intervention, risk_band per admitted request."""
    admitted, quarantined = split(feed)
    scored = score_batch(admitted, forest, settings=settings).select(
        "customer_id",
        "intervention_score",
        F.col("predicted_intervention").alias("needs_intervention"),
        "risk_band",
    )
    return Answers(scored, quarantined)


def detect(
    cases: DataFrame, detector: str | None = None, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(status rows, any_flagged and total_flagged); an unknown detector is refused."""
    status = detector_status(cases, detector, settings)
    return status, detector_rollup(status)


def summarise_requests(
    feed: DataFrame, forest: Forest | None = None, anomaly_text: str = "", settings: Settings = DEFAULTS
) -> Answers:
    """customer_id, summary, source, model per admitted request; without a forest the band is Unknown."""
    admitted, quarantined = split(feed)
    scored = admitted if forest is None else score_batch(admitted, forest, settings=settings)
    return Answers(case_summaries(scored, anomaly_text), quarantined)
