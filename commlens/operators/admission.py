"""Row admission: request constraints applied to a whole feed, bad rows set aside with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from commlens.functions.text import number

# Defaults for absent fields.
REQUEST_DEFAULTS = {
    "customer_id": "UNKNOWN",
    "segment": "Standard",
    "product_type": "Auto",
    "channel": "Email",
    "campaign_id": "CAMP_001",
    "sent_date": "2026-01-01",
    "opened": 0,
    "clicked": 0,
    "response_flag": 0,
    "complaint_flag": 0,
    "escalation_flag": 0,
    "engagement_score": 0.5,
    "sentiment_text": "neutral",
    "premium_bucket": "Mid",
    "tenure_months": 12,
    "days_since_last_contact": 30,
    "opt_out_flag": 0,
}
# Inclusive bounds; None is open.
INTEGER_BOUNDS: dict[str, tuple[int, int | None]] = {
    "opened": (0, 1),
    "clicked": (0, 1),
    "response_flag": (0, 1),
    "complaint_flag": (0, 1),
    "escalation_flag": (0, 1),
    "opt_out_flag": (0, 1),
    "tenure_months": (1, 120),
    "days_since_last_contact": (0, None),
}


# a day, alone or with midnight
DAY = r"^\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0+)?)?Z?)?$"
# whole numbers: digits with single underscores, zeros after the point
WHOLE = r"^\s*[+-]?\d+(_\d+)*(\.0*)?\s*$"


def _parsed(df: DataFrame, name: str, whole: bool) -> Column:
    """NULL for what is no number. Text must be written as one; a numeric column is taken as it is."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        parsed = number(value)
        return F.when(value.rlike(WHOLE), parsed) if whole else parsed
    parsed = F.nullif(value.cast("double"), F.lit(float("nan")))
    return F.when(parsed == F.floor(parsed), parsed) if whole else parsed


def _reason(name: str, low: float, high: float | None, whole: bool) -> Column:
    value = F.col(f"_{name}")
    reason = F.when(value.isNull(), f"{name}: not {'an integer' if whole else 'a number'}")
    reason = reason.when(value < low, f"{name}: below {low}")
    return reason if high is None else reason.when(value > high, f"{name}: above {high}")


def admit(df: DataFrame) -> DataFrame:
    """The typed request columns, defaults filled in, plus ``reasons`` (empty: admitted).

    A table cannot tell an absent field from NULL: NULL takes the default.
    """
    schema = df.schema

    def filled_in(name: str, default: object) -> Column:
        value = F.lit(default)
        if name in schema.fieldNames():
            value = F.coalesce(F.col(name), value.cast(schema[name].dataType))
        return value.alias(name)

    filled = df.select(*[filled_in(name, default) for name, default in REQUEST_DEFAULTS.items()])
    day = F.col("sent_date")
    if isinstance(filled.schema["sent_date"].dataType, T.StringType):
        day = F.when(day.rlike(DAY), F.substring(day, 1, 10).try_cast("date"))
    typed = filled.withColumns(
        {
            "_sent_date": day.cast("date"),
            "_engagement_score": _parsed(filled, "engagement_score", whole=False),
            **{f"_{c}": _parsed(filled, c, whole=True) for c in INTEGER_BOUNDS},
        }
    )
    reasons = [_reason(c, low, high, whole=True) for c, (low, high) in INTEGER_BOUNDS.items()]
    reasons.append(_reason("engagement_score", 0, 1, whole=False))
    reasons.append(F.when(F.col("_sent_date").isNull(), "sent_date: not a date"))
    own = {"sent_date": F.col("_sent_date"), "engagement_score": F.col("_engagement_score")}
    own |= {c: F.col(f"_{c}").try_cast("int") for c in INTEGER_BOUNDS}
    return typed.select(
        *[own.get(c, F.col(c)).alias(c) for c in REQUEST_DEFAULTS], F.array_compact(F.array(*reasons)).alias("reasons")
    )


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, quarantined rows with reasons)"""
    checked = admit(df)
    # a generator is not merged with what follows, so each field is parsed once and not again by every filter and feature
    checked = checked.select(F.inline(F.array(F.struct(*checked.columns))))
    good = F.size("reasons") == 0
    return checked.where(good).drop("reasons"), checked.where(~good)
