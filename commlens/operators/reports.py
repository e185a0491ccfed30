"""Report tables: the figures behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from commlens.functions.rounding import round_even
from commlens.functions.text import yes_no
from commlens.operators.cleaning import lenient_date
from commlens.schema import DOMAINS, ID, TARGET
from commlens.sources.files import nan_to_null

# Columns and lengths of the case list.
CASE_COLUMNS = [
    "customer_id",
    "segment",
    "channel",
    "campaign_id",
    "engagement_score",
    "complaint_flag",
    "escalation_flag",
    "days_since_last_contact",
    "needs_intervention",
]
SCORE_COLUMNS = ["intervention_score", "risk_band"]
CASE_LIMIT = 200
HISTOGRAM_BINS = 40


def _mean(name: str) -> Column:
    return round_even(F.avg(name))


def kpis(df: DataFrame) -> DataFrame:
    return nan_to_null(df).agg(
        F.count("*").alias("total_records"),
        _mean(TARGET).alias("intervention_rate"),
        _mean("engagement_score").alias("avg_engagement"),
        _mean("complaint_flag").alias("complaint_rate"),
        _mean("escalation_flag").alias("escalation_rate"),
        _mean("opt_out_flag").alias("opt_out_rate"),
    )


def engagement_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """bin, lower, upper, n for equal bins on [0, 1]; the last bin includes 1, empty bins count 0.

    One zero row per bin joins the count as ordinary input, so empty bins need no join.
    """
    slot = F.least(F.floor(F.col("engagement_score") * bins), F.lit(bins - 1)).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    slots = df.where(F.col("engagement_score").between(0, 1)).select(slot.alias("bin"), one.alias("n"))
    empty = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").alias("bin"), zero.alias("n"))
    return (
        slots.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (F.col("bin") / F.lit(float(bins))).alias("lower"),
            ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
            "n",
        )
    )


def segment_rate(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("segment").isNotNull()).groupBy("segment").agg(_mean(TARGET).alias("intervention_rate"))
    )


def channel_breakdown(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("channel").isNotNull())
        .groupBy("channel")
        .agg(F.count(ID).alias("total"), _mean(TARGET).alias("intervention"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per non-missing value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def sentiment_mix(df: DataFrame) -> DataFrame:
    return value_counts(df, "sentiment_text")


def daily_complaints(df: DataFrame) -> DataFrame:
    """Complaints, rows with a known flag, and their rate per day; rows without a readable date are left out."""
    return (
        df.select(lenient_date(F.col("sent_date")).alias("date"), "complaint_flag")
        .where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(
            F.coalesce(F.sum("complaint_flag"), F.lit(0)).cast("bigint").alias("complaints"),
            F.count("complaint_flag").alias("total"),
        )
        .withColumn("rate", round_even(F.try_divide(F.col("complaints"), F.col("total"))))
    )


def open_rate_heatmap(df: DataFrame) -> DataFrame:
    """Mean open rate, campaigns down, segments across. The levels are given, so no job looks for them."""
    levels = sorted(DOMAINS["segment"])
    wide = (
        df.where(F.col("campaign_id").isNotNull()).groupBy("campaign_id").pivot("segment", levels).agg(F.avg("opened"))
    )
    return wide.select("campaign_id", *[round_even(F.col(s)).alias(s) for s in levels])


def distinct_values(df: DataFrame, columns: tuple[str, ...] = ("segment", "channel")) -> DataFrame:
    """column_name, value: the filter choices. Combinations are deduplicated first, so few rows are unpivoted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(*columns)
        .distinct()
        .select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("column_name", "value")
    )


def filter_cases(
    df: DataFrame, segments: list[str], channels: list[str], needs_intervention: int | None = None
) -> DataFrame:
    """Membership and flag filter; an empty list selects nothing."""
    chosen = F.col("segment").isin(segments) & F.col("channel").isin(channels)
    if needs_intervention is not None:
        chosen = chosen & (F.col(TARGET) == needs_intervention)
    return df.where(chosen)


def first_cases(df: DataFrame, limit: int = CASE_LIMIT) -> DataFrame:
    """The first cases in id order, all columns: what a list shows is chosen before it is scored."""
    return df.orderBy(ID).limit(limit)


def case_list(df: DataFrame, limit: int = CASE_LIMIT) -> DataFrame:
    """The display columns of the first cases in id order."""
    shown = CASE_COLUMNS + [c for c in SCORE_COLUMNS if c in df.columns]
    return df.orderBy(ID).select(*shown).limit(limit)


def candidate_cases(df: DataFrame, limit: int = 100) -> DataFrame:
    """Ids of the first flagged cases."""
    return df.where(F.col(TARGET) == 1).orderBy(ID).select(ID).limit(limit)


def case_lookup(df: DataFrame, customer_id: str | Column) -> DataFrame:
    """All columns of one case; among duplicates the earliest, then the first by the other columns."""
    rest = [c for c in df.columns if c not in ("sent_date", ID)]
    return df.where(F.col(ID) == customer_id).orderBy("sent_date", *[F.col(f"`{c}`") for c in rest]).limit(1)


def sample_case(df: DataFrame, needs_intervention: int = 1) -> DataFrame:
    """The first case with the given flag."""
    return df.where(F.col(TARGET) == needs_intervention).orderBy(ID).limit(1)


def case_card(case: DataFrame) -> DataFrame:
    """The drill-down fields of a case."""
    return case.select(
        "customer_id",
        "engagement_score",
        "tenure_months",
        "days_since_last_contact",
        yes_no(F.col("opt_out_flag")).alias("opt_out"),
        yes_no(F.col("complaint_flag")).alias("complaint"),
        yes_no(F.col("escalation_flag")).alias("escalation"),
        *[c for c in SCORE_COLUMNS if c in case.columns],
    )
