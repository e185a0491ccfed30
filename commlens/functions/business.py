"""Business columns: engagement score, intervention rule, sentiment and risk bands, id labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from commlens.functions.rounding import round_even
from commlens.settings import DEFAULTS, Settings

# Weights of the engagement score.
ENGAGEMENT_WEIGHTS = {
    "opened": 0.35,
    "clicked": 0.30,
    "response_flag": 0.25,
    "complaint_flag": -0.15,
    "opt_out_flag": -0.10,
}
# Lower bounds of the sentiment bands, highest first.
SENTIMENT_BANDS = [(0.70, "positive"), (0.45, "neutral"), (0.25, "mixed")]
LOWEST_SENTIMENT = "negative"


def true_only(condition: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(condition, F.lit(False))


def engagement_score() -> Column:
    """Weighted sum of the flags, clipped to [0, 1], four decimals; NULL when a flag is missing."""
    first, *rest = ENGAGEMENT_WEIGHTS.items()
    raw = F.lit(first[1]) * F.col(first[0])
    for name, weight in rest:
        raw = raw + F.lit(weight) * F.col(name)
    # greatest/least skip NULL, so the guard keeps an unknown sum unknown
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.when(raw.isNotNull(), round_even(clipped))


def needs_intervention(settings: Settings = DEFAULTS) -> Column:
    """1 when any of four rules holds; reads the rounded engagement score."""
    score, days = F.col("engagement_score"), F.col("days_since_last_contact")
    rules = [
        (score < settings.low_engagement) & (F.col("opened") == 0) & (days < settings.recent_days),
        F.col("complaint_flag") == 1,
        F.col("escalation_flag") == 1,
        (days > settings.dormant_days)
        & (F.col("response_flag") == 0)
        & (F.col("opt_out_flag") == 0)
        & (score < settings.dormant_engagement),
    ]
    any_rule = true_only(rules[0])
    for rule in rules[1:]:
        any_rule = any_rule | true_only(rule)
    return any_rule.cast("int")


def sentiment_band(score: Column) -> Column:
    (bound, label), *rest = SENTIMENT_BANDS
    band = F.when(score >= bound, label)
    for bound, label in rest:
        band = band.when(score >= bound, label)
    return band.otherwise(LOWEST_SENTIMENT)


def risk_band(probability: Column, settings: Settings = DEFAULTS) -> Column:
    """Band of an unrounded probability."""
    return (
        F.when(probability >= settings.high_risk, "High")
        .when(probability >= settings.medium_risk, "Medium")
        .otherwise("Low")
    )


def threshold_flag(probability: Column, settings: Settings = DEFAULTS) -> Column:
    return (probability >= settings.probability_threshold).cast("int")


def id_label(prefix: str, number: Column, width: int) -> Column:
    """``CAMP_007``: prefix and zero-padded number; a longer number is never cut."""
    digits = number.cast("string")
    return F.concat(
        F.lit(f"{prefix}_"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    )
