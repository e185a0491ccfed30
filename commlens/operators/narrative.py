"""Case texts: context, prompt and next-best-action summary for every case, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from commlens.functions.rounding import fixed_text
from commlens.functions.text import lenient_double, lenient_int, or_default, yes_no

STUB = "stub"
FLAG_WORD = "FLAGGED"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def case_context(df: DataFrame, anomaly_text: str | Column = "") -> DataFrame:
    """The context columns of every case. Absent columns, missing values and bad numbers get defaults.

    ``anomaly_text`` is a constant or a scalar subquery: one value for the whole job, nothing is joined.
    """

    def source(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    text = F.lit(anomaly_text) if isinstance(anomaly_text, str) else anomaly_text
    return df.select(
        or_default(source("customer_id"), "Unknown").alias("customer_id"),
        or_default(source("segment"), "Unknown").alias("segment"),
        or_default(source("channel"), "Unknown").alias("channel"),
        or_default(source("sentiment_text"), "neutral").alias("sentiment"),
        lenient_double(source("engagement_score")).alias("engagement_score"),
        lenient_int(source("complaint_flag")).alias("complaint_flag"),
        lenient_int(source("escalation_flag")).alias("escalation_flag"),
        lenient_int(source("days_since_last_contact")).alias("days_since_contact"),
        lenient_double(source("intervention_score")).alias("intervention_score"),
        or_default(source("risk_band"), "Unknown").alias("risk_band"),
        F.coalesce(text, F.lit("")).alias("anomaly_summary"),
    )


# The sentences below.


def user_prompt() -> Column:
    """The prompt text over the context columns."""
    return _text(
        "Customer case summary request:\n\nCustomer ID     : ",
        F.col("customer_id"),
        "\nSegment         : ",
        F.col("segment"),
        "\nChannel         : ",
        F.col("channel"),
        "\nSentiment       : ",
        F.col("sentiment"),
        "\nEngagement score: ",
        fixed_text(F.col("engagement_score"), 2),
        " / 1.00\nComplaint flag  : ",
        yes_no(F.col("complaint_flag")),
        "\nEscalation flag : ",
        yes_no(F.col("escalation_flag")),
        "\nDays since last contact: ",
        F.col("days_since_contact").cast("string"),
        "\nModel intervention score: ",
        fixed_text(F.col("intervention_score"), 2),
        " (risk: ",
        F.col("risk_band"),
        ")\n\nAnomaly context:\n",
        F.col("anomaly_summary"),
        "\n\nWrite a 2-3 sentence next-best-action summary for this customer case.",
    )


def stub_summary() -> Column:
    """The template summary over the context columns: opening, recommendation, closing."""
    segment, channel = F.col("segment"), F.col("channel")
    days = F.col("days_since_contact").cast("string")
    engagement = fixed_text(F.col("engagement_score"), 2)

    at_risk = _text(
        "This ",
        segment,
        " segment customer is showing elevated intervention risk (score: ",
        fixed_text(F.col("intervention_score"), 2),
        ") with ",
        F.col("sentiment"),
        " sentiment and ",
        days,
        " days since last contact.",
    )
    complained = _text(
        "A complaint has been raised by this ",
        segment,
        " customer, with engagement score at ",
        engagement,
        " and risk band flagged as ",
        F.col("risk_band"),
        ".",
    )
    declined = _text(
        "Engagement for this ",
        segment,
        " customer has declined to ",
        engagement,
        " over the past period, with ",
        days,
        " days since last meaningful contact.",
    )
    opening = (
        F.when((F.col("risk_band") == "High") | (F.col("escalation_flag") != 0), at_risk)
        .when(F.col("complaint_flag") != 0, complained)
        .otherwise(declined)
    )

    recommendation = (
        F.when(
            channel == "Email",
            "Recommend reducing Email frequency and switching to a personalised SMS or phone outreach "
            "within the next 7 days.",
        )
        .when(
            channel == "SMS",
            "Recommend escalating from SMS to a direct phone call to re-establish engagement and address any "
            "outstanding concerns.",
        )
        .otherwise(
            _text(
                "Recommend a direct follow-up via ",
                channel,
                " with a personalised retention offer tailored to the ",
                segment,
                " segment.",
            )
        )
    )

    closing = F.when(
        F.contains("anomaly_summary", F.lit(FLAG_WORD)),
        "Broader segment-level anomalies have been detected — review campaign messaging for this cohort before "
        "next outreach.",
    ).otherwise(
        "Monitor engagement over the next 14 days and escalate if intervention score remains above 0.45."
    )
    return F.concat_ws(" ", opening, recommendation, closing)


def case_prompts(df: DataFrame, anomaly_text: str | Column = "") -> DataFrame:
    return case_context(df, anomaly_text).select(
        "customer_id", user_prompt().alias("user_prompt")
    )


def case_summaries(df: DataFrame, anomaly_text: str | Column = "") -> DataFrame:
    """customer_id, summary, source, model for every case."""
    return case_context(df, anomaly_text).select(
        "customer_id",
        stub_summary().alias("summary"),
        F.lit(STUB).alias("source"),
        F.lit(STUB).alias("model"),
    )
