"""Anomaly detectors: weekly engagement drop, daily complaint spike, campaign underperformance.

Every detector sums *measures*: per-row counts and sums of the few columns it needs. Base rows carry measures of
single rows; ``rollup`` carries the same measures per day, segment and campaign. A detector accepts either, so one
detector alone reads only its own columns, and all three together read the table once.

Nothing is joined and no task sees an unbounded group. The last day and the median are scalar subqueries that read
one or two columns: the median's buffer holds distinct rates, at most 10,001 after rounding to four decimals. The
deviation over days uses a window over one row per day, and a DATE has fewer than four million values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from commlens.functions.business import true_only
from commlens.functions.rounding import fixed_text, percent_text, round_even
from commlens.operators.ordering import with_position
from commlens.session import durable
from commlens.settings import DEFAULTS, Settings
from commlens.sources.files import nan_to_null
from commlens.sources.tables import replace_partitions

SEGMENT_DROP = "segment_engagement_drop"
COMPLAINT_SPIKE = "complaint_spike"
CAMPAIGN = "campaign_underperformance"
DETECTORS = [SEGMENT_DROP, COMPLAINT_SPIKE, CAMPAIGN]
ALL = "all"

KEYS = {"day": "sent_date", "segment": "segment", "campaign_id": "campaign_id"}

# Scores have four decimals; their sums are kept as whole millionths. Integer sums do not depend on the order of
# tasks, so a retry cannot move a mean, and equal scores have exactly equal means. A BIGINT holds nine trillion rows.
SCORE_SCALE = 1e6
ROLLUP_PARTITIONS = 8


# --- measures --------------------------------------------------------------------------------------------------


def measure_rows(df: DataFrame) -> DataFrame:
    """Keys and additive measures of the detector columns that the frame has; NaN counts as missing."""
    sources = {
        "complaints": ("complaint_flag", lambda c: F.coalesce(c, F.lit(0)).cast("bigint")),
        "opened_known": ("opened", lambda c: c.isNotNull().cast("bigint")),
        "opened_sum": ("opened", lambda c: F.coalesce(c, F.lit(0)).cast("bigint")),
        "score_known": ("engagement_score", lambda c: c.isNotNull().cast("bigint")),
        "score_sum": ("engagement_score", lambda c: F.coalesce(F.rint(c * SCORE_SCALE).cast("bigint"), F.lit(0))),
    }
    used = {*KEYS.values(), *(c for c, _ in sources.values())}
    df = nan_to_null(df.select(*[c for c in df.columns if c in used]))
    keys = [
        (F.col(c).cast("date") if name == "day" else F.col(c)).alias(name)
        for name, c in KEYS.items()
        if c in df.columns
    ]
    measures = [build(F.col(c)).alias(name) for name, (c, build) in sources.items() if c in df.columns]
    return df.select(*keys, F.lit(1).cast("bigint").alias("rows"), *measures)


def rollup(df: DataFrame) -> DataFrame:
    """Measures per day, segment and campaign: its size follows the calendar, not the table."""
    rows = measure_rows(df)
    keys = [k for k in KEYS if k in rows.columns]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def _whole() -> WindowSpec:
    return Window.partitionBy()


def _mean_score(total: Column, known: Column) -> Column:
    return F.try_divide(total, known) / F.lit(SCORE_SCALE)


# --- detector 1: weekly engagement drop per segment ------------------------------------------------------------


def _last_day(measures: DataFrame) -> Column:
    """The last day on file stands for today; a scalar subquery over the day column alone."""
    return measures.agg(F.max("day")).scalar()


def _segment_weeks(measures: DataFrame, threshold: float) -> DataFrame:
    today, age = _last_day(measures), F.col("age")
    current, previous = age <= 6, age >= 7

    def total(name: str, week: Column) -> Column:
        return F.sum(F.when(week, F.col(name)))

    # the filter reaches the scan, so a table partitioned by day reads fourteen days
    per_segment = (
        measures.where((F.col("day") >= F.date_sub(today, 13)) & F.col("segment").isNotNull())
        .withColumn("age", F.date_diff(today, "day"))
        .groupBy("segment")
        .agg(
            total("rows", current).alias("current_rows"),
            total("rows", previous).alias("previous_rows"),
            _mean_score(total("score_sum", current), total("score_known", current)).alias("current_avg"),
            _mean_score(total("score_sum", previous), total("score_known", previous)).alias("previous_avg"),
        )
    )
    drop = F.try_divide(F.col("previous_avg") - F.col("current_avg"), F.col("previous_avg"))
    return (
        per_segment.where(F.col("current_rows").isNotNull() & F.col("previous_rows").isNotNull())
        .where(F.coalesce(F.col("previous_avg") != 0, F.lit(True)))
        .select(
            "segment",
            round_even(F.col("current_avg")).alias("current_week_avg"),
            round_even(F.col("previous_avg")).alias("previous_week_avg"),
            round_even(drop).alias("drop_pct"),
            percent_text(drop).alias("drop_pct_label"),
            true_only(drop > threshold).alias("flagged"),
        )
    )


def segment_weeks(df: DataFrame, drop_threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Every segment seen in both weeks, with its drop and flag."""
    threshold = settings.override(engagement_drop_threshold=drop_threshold).engagement_drop_threshold
    return _segment_weeks(measure_rows(df), threshold)


def segment_drop(df: DataFrame, drop_threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Flagged segments."""
    return segment_weeks(df, drop_threshold, settings).where("flagged").drop("flagged").orderBy("segment")


# --- detector 2: daily complaint spike -------------------------------------------------------------------------


def _complaint_days(measures: DataFrame, threshold: float) -> DataFrame:
    daily = (
        measures.where(F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.sum("complaints").alias("complaints"), F.sum("rows").alias("total_sent"))
        .withColumns(
            {
                "days": F.count("*").over(_whole()),
                "mean_complaints": F.avg("complaints").over(_whole()),
                "std_complaints": F.stddev_samp("complaints").over(_whole()),
            }
        )
    )
    zscore = F.when(
        (F.col("days") >= 3) & (F.col("std_complaints") != 0),
        F.try_divide(F.col("complaints") - F.col("mean_complaints"), F.col("std_complaints")),
    )
    return daily.select(
        F.col("day").alias("date"),
        "complaints",
        "total_sent",
        round_even(F.col("complaints") / F.col("total_sent")).alias("complaint_rate"),
        round_even(zscore).alias("zscore"),
        true_only(zscore > threshold).alias("flagged"),
        "days",
        "mean_complaints",
        "std_complaints",
    )


def complaint_days(df: DataFrame, zscore_threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Every day with its z-score and flag; z-scores are NULL below three days or without any spread."""
    threshold = settings.override(complaint_zscore_threshold=zscore_threshold).complaint_zscore_threshold
    return _complaint_days(measure_rows(df), threshold)


def complaint_spike(df: DataFrame, zscore_threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Flagged days, highest z-score first."""
    return (
        complaint_days(df, zscore_threshold, settings)
        .where("flagged")
        .select("date", "complaints", "total_sent", "complaint_rate", "zscore")
        .orderBy(F.desc("zscore"), "date")
    )


def top_spikes(df: DataFrame, n: int = 3, settings: Settings = DEFAULTS) -> DataFrame:
    return complaint_spike(df, settings=settings).select("date", "zscore").limit(n)


# --- detector 3: campaign underperformance ---------------------------------------------------------------------


def _open_rate() -> Column:
    """Rounded before median and cutoff; a campaign with nothing sent counts as 0.0."""
    rate = F.try_divide(F.sum("opened_sum"), F.sum("opened_known"))
    return F.coalesce(round_even(rate), F.lit(0.0)).alias("open_rate")


def _campaigns(measures: DataFrame, ratio: float) -> DataFrame:
    rate = F.col("open_rate")
    named = measures.where(F.col("campaign_id").isNotNull())
    # one row per campaign, read twice: by the median and by the result
    stats = durable(
        named.groupBy("campaign_id").agg(
            _open_rate(),
            F.sum("opened_known").alias("total_sent"),
            F.sum("complaints").alias("complaint_count"),
            _mean_score(F.sum("score_sum"), F.sum("score_known")).alias("mean_score"),
        )
    )
    stats = stats.withColumn("median_raw", stats.agg(F.median("open_rate")).scalar())
    stats = stats.withColumn("cutoff", F.col("median_raw") * ratio)
    share = F.when(F.col("median_raw") > 0, round_even(F.try_divide(rate, F.col("median_raw")))).otherwise(0.0)
    return stats.select(
        "campaign_id",
        rate,
        percent_text(rate).alias("open_rate_label"),
        round_even(F.col("median_raw")).alias("median_open_rate"),
        share.alias("pct_of_median"),
        "total_sent",
        "complaint_count",
        round_even(F.col("mean_score")).alias("avg_engagement"),
        round_even(F.col("cutoff")).alias("cutoff_open_rate"),
        (rate < F.col("cutoff")).alias("flagged"),
        "median_raw",
    )


def campaign_scorecard(df: DataFrame, open_rate_ratio: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Every campaign with open rate, median, cutoff and flag."""
    ratio = settings.override(campaign_open_rate_ratio=open_rate_ratio).campaign_open_rate_ratio
    return _campaigns(measure_rows(df), ratio).drop("median_raw")


def campaign_underperformance(
    df: DataFrame, open_rate_ratio: float | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Flagged campaigns, worst first."""
    return (
        campaign_scorecard(df, open_rate_ratio, settings)
        .where("flagged")
        .drop("flagged", "cutoff_open_rate")
        .orderBy("open_rate", "campaign_id")
    )


# --- one status row per detector -------------------------------------------------------------------------------
# The summary sentences below, and the columns of flagged items.

SEGMENT_FIELDS = ["segment", "current_week_avg", "previous_week_avg", "drop_pct", "drop_pct_label"]
COMPLAINT_FIELDS = ["date", "complaints", "total_sent", "complaint_rate", "zscore"]
CAMPAIGN_FIELDS = [
    "campaign_id",
    "open_rate",
    "open_rate_label",
    "median_open_rate",
    "pct_of_median",
    "total_sent",
    "complaint_count",
    "avg_engagement",
]


def _items(order: list[Column], fields: list[str]) -> Column:
    """Flagged rows of an aggregate as an ordered array of text maps. One entry per flagged segment, day or
    campaign; the rows behind it are long aggregated."""
    entry = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)],
        *[F.col(f).cast("string").alias(f) for f in fields],
    )
    flagged = F.array_sort(F.collect_list(F.when(F.col("flagged"), entry)))
    return F.transform(flagged, lambda e: F.create_map(*[x for f in fields for x in (F.lit(f), e[f])]))


def _metadata(**values: Column) -> Column:
    return F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))])


def _status(
    totals: DataFrame,
    position: int,
    detector: str,
    summary: Column,
    metadata: Column,
    flagged: Column,
    segments: Column | None = None,
) -> DataFrame:
    names = F.lit(None) if segments is None else segments
    return totals.select(
        F.lit(position).alias("position"),
        F.lit(detector).alias("detector"),
        flagged.alias("flagged"),
        summary.alias("summary"),
        metadata.alias("metadata"),
        F.col("n").alias("n_flagged"),
        "anomalies",
        names.cast("array<string>").alias("segments"),
    )


def _segment_status(measures: DataFrame, settings: Settings) -> DataFrame:
    threshold = settings.engagement_drop_threshold
    today = _last_day(measures)
    worst = F.min_by(
        F.struct("segment", "drop_pct_label"),
        F.when(F.col("flagged"), F.struct((-F.col("drop_pct")).alias("d"), "segment")),
    )
    totals = _segment_weeks(measures, threshold).agg(
        F.count_if("flagged").alias("n"),
        F.count("*").alias("compared"),
        F.array_sort(F.collect_list("segment")).alias("segments"),
        worst.alias("worst"),
        _items([F.col("segment")], SEGMENT_FIELDS).alias("anomalies"),
    )
    found = F.concat(
        F.col("n").cast("string"),
        F.lit(f" segment(s) show engagement drops above {threshold:.0%}. Worst: "),
        F.col("worst.segment"),
        F.lit(" dropped "),
        F.col("worst.drop_pct_label"),
        F.lit(" week-over-week."),
    )
    clean = F.concat(
        F.lit(f"No segment engagement drops above {threshold:.0%} detected across "),
        F.col("compared").cast("string"),
        F.lit(" segment(s)."),
    )
    flagged = F.col("n") > 0
    metadata = _metadata(
        threshold=F.lit(threshold),
        segments_compared=F.col("compared"),
        current_week_start=F.date_sub(today, 6),
        previous_week_start=F.date_sub(today, 13),
    )
    return _status(totals, 0, SEGMENT_DROP, F.when(flagged, found).otherwise(clean), metadata, flagged, F.col("segments"))


def _complaint_status(measures: DataFrame, settings: Settings) -> DataFrame:
    threshold = settings.complaint_zscore_threshold
    worst = F.min_by(
        F.struct("date", "complaints", "zscore"),
        F.when(F.col("flagged"), F.struct((-F.col("zscore")).alias("z"), "date")),
    )
    totals = _complaint_days(measures, threshold).agg(
        F.count("*").alias("days"),
        F.count_if("flagged").alias("n"),
        F.max("mean_complaints").alias("mean"),
        F.max("std_complaints").alias("std"),
        worst.alias("worst"),
        _items([-F.col("zscore"), F.col("date")], COMPLAINT_FIELDS).alias("anomalies"),
    )
    few = F.col("days") < 3
    uniform = F.col("std") == 0
    flagged = F.col("n") > 0
    found = F.concat(
        F.col("n").cast("string"),
        F.lit(" day(s) with complaint spikes detected. Highest: "),
        F.col("worst.date").cast("string"),
        F.lit(" with "),
        F.col("worst.complaints").cast("string"),
        F.lit(" complaints (z-score: "),
        fixed_text(F.col("worst.zscore"), 2),
        F.lit(")."),
    )
    clean = F.concat(
        F.lit(f"No complaint spikes above z-score {threshold} detected. Daily average: "),
        fixed_text(F.col("mean"), 1),
        F.lit(" complaints."),
    )
    summary = (
        F.when(few, "Insufficient data for complaint spike detection (need >= 3 days).")
        .when(uniform, "Complaint counts are uniform — no spike detection possible.")
        .when(flagged, found)
        .otherwise(clean)
    )
    limit = F.lit(threshold)
    metadata = (
        F.when(few, _metadata(threshold=limit))
        .when(uniform, _metadata(threshold=limit, mean=round_even(F.col("mean"), 2)))
        .otherwise(
            _metadata(
                threshold=limit,
                mean_complaints=round_even(F.col("mean"), 2),
                std_complaints=round_even(F.col("std"), 2),
                days_analysed=F.col("days"),
            )
        )
    )
    return _status(totals, 1, COMPLAINT_SPIKE, summary, metadata, flagged)


def _campaign_status(measures: DataFrame, settings: Settings) -> DataFrame:
    ratio = settings.campaign_open_rate_ratio
    worst = F.min_by(
        F.struct("campaign_id", "open_rate_label", "pct_of_median"),
        F.when(F.col("flagged"), F.struct("open_rate", "campaign_id")),
    )
    totals = _campaigns(measures, ratio).agg(
        F.count("*").alias("campaigns"),
        F.count_if("flagged").alias("n"),
        F.max("median_raw").alias("median"),
        worst.alias("worst"),
        _items([F.col("open_rate"), F.col("campaign_id")], CAMPAIGN_FIELDS).alias("anomalies"),
    )
    flagged = F.col("n") > 0
    found = F.concat(
        F.col("n").cast("string"),
        F.lit(" campaign(s) underperforming. Median open rate: "),
        percent_text(F.col("median")),
        F.lit(". Worst: "),
        F.col("worst.campaign_id"),
        F.lit(" at "),
        F.col("worst.open_rate_label"),
        F.lit(" ("),
        percent_text(F.col("worst.pct_of_median"), 0),
        F.lit(" of median)."),
    )
    clean = F.concat(
        F.lit("All "),
        F.col("campaigns").cast("string"),
        F.lit(f" campaigns performing above {ratio:.0%} of median open rate ("),
        F.coalesce(percent_text(F.col("median")), F.lit("nan%")),
        F.lit(")."),
    )
    metadata = _metadata(
        ratio_threshold=F.lit(ratio),
        median_open_rate=round_even(F.col("median")),
        cutoff_open_rate=round_even(F.col("median") * ratio),
        campaigns_checked=F.col("campaigns"),
    )
    return _status(totals, 2, CAMPAIGN, F.when(flagged, found).otherwise(clean), metadata, flagged)


_STATUS = {SEGMENT_DROP: _segment_status, COMPLAINT_SPIKE: _complaint_status, CAMPAIGN: _campaign_status}


def selected(detector: str | None) -> list[str]:
    """The detectors a request names; None and "all" mean all three."""
    if detector is None or detector == ALL:
        return DETECTORS
    if detector not in DETECTORS:
        raise ValueError(f"Unknown detector {detector!r}; expected one of {[*DETECTORS, ALL]}")
    return [detector]


def detector_status(df: DataFrame, detector: str | None = ALL, settings: Settings = DEFAULTS) -> DataFrame:
    """detector, flagged, summary, metadata, n_flagged, anomalies, segments: one row per selected detector.

    ``anomalies`` lists the flagged segments, days or campaigns in the detector's order, ``segments`` the names of those compared
    (NULL for the other detectors); where they are many, ``detector_items`` has them as rows, and columns that are not selected are
    not collected. For several detectors the rollup, a few rows per day, is checkpointed in the shared folder, so the table is read
    once, every call reads it anew, and nothing is left in memory.
    """
    names = selected(detector)
    return status_of(_measures(df, names), detector, settings)


def status_of(measures: DataFrame, detector: str | None = ALL, settings: Settings = DEFAULTS) -> DataFrame:
    """``detector_status`` from measures or from a stored rollup."""
    rows = reduce(DataFrame.unionByName, [_STATUS[name](measures, settings) for name in selected(detector)])
    return rows.orderBy("position").drop("position")


def _measures(df: DataFrame, names: list[str]) -> DataFrame:
    return measure_rows(df) if len(names) == 1 else durable(rollup(df).repartition(ROLLUP_PARTITIONS))


# --- the flagged items -----------------------------------------------------------------------------------------


def _flagged(rows: DataFrame, detector: str, fields: list[str], key: str, rank: Column) -> DataFrame:
    texts = [F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields]
    return rows.where("flagged").select(
        F.lit(DETECTORS.index(detector)).alias("place"),
        F.lit(detector).alias("detector"),
        F.col(key).cast("string").alias("item"),
        rank.cast("double").alias("rank"),
        F.map_from_entries(F.array(*texts)).alias("fields"),
    )


def _segment_items(measures: DataFrame, settings: Settings) -> DataFrame:
    rows = _segment_weeks(measures, settings.engagement_drop_threshold)
    return _flagged(rows, SEGMENT_DROP, SEGMENT_FIELDS, "segment", F.lit(0.0))


def _complaint_items(measures: DataFrame, settings: Settings) -> DataFrame:
    rows = _complaint_days(measures, settings.complaint_zscore_threshold)
    return _flagged(rows, COMPLAINT_SPIKE, COMPLAINT_FIELDS, "date", -F.col("zscore"))


def _campaign_items(measures: DataFrame, settings: Settings) -> DataFrame:
    rows = _campaigns(measures, settings.campaign_open_rate_ratio)
    return _flagged(rows, CAMPAIGN, CAMPAIGN_FIELDS, "campaign_id", F.col("open_rate"))


_ITEMS = {SEGMENT_DROP: _segment_items, COMPLAINT_SPIKE: _complaint_items, CAMPAIGN: _campaign_items}


def detector_items(df: DataFrame, detector: str | None = ALL, settings: Settings = DEFAULTS) -> DataFrame:
    """detector, position, item, fields: one row per flagged segment, day or campaign.

    Positions count from 1 in the order of each detector: segments by name, days by falling z-score, campaigns by open rate.
    However many are flagged, they are ordinary rows: nothing is gathered into one value or one task.
    """
    names = selected(detector)
    measures = _measures(df, names)
    rows = reduce(DataFrame.unionByName, [_ITEMS[name](measures, settings) for name in names])
    placed = with_position(rows, "place", [F.col("rank"), F.col("item")])
    return placed.select("detector", "position", "item", "fields")


def store_rollup(df: DataFrame, table: str) -> None:
    """Bring a stored rollup up to date with the cases of some days: each of these days is replaced, the others stay.

    df holds all cases of the days it touches. What is read is these days, not the years before; ``status_of`` and
    ``detector_status`` then agree.
    """
    replace_partitions(rollup(df), table, "day")


def detector_rollup(status: DataFrame) -> DataFrame:
    return status.agg(
        F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("any_flagged"),
        F.count_if("flagged").alias("total_flagged"),
    )


def anomaly_text(status: DataFrame) -> DataFrame:
    """One row, one column ``anomaly_text``: a status line per detector, in detector order."""
    line = F.concat(
        F.lit("  ["),
        F.when(F.col("flagged"), "⚠ FLAGGED").otherwise("✓ OK"),
        F.lit("] "),
        F.col("detector"),
        F.lit(": "),
        F.col("summary"),
    )
    position = F.array_position(F.array(*[F.lit(d) for d in DETECTORS]), F.col("detector"))
    # three rows
    lines = F.array_sort(F.collect_list(F.struct(position.alias("p"), line.alias("line"))))
    return status.agg(F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("anomaly_text"))
