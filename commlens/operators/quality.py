"""Data quality. All checks are counts of one aggregate, so the table is read once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from commlens.functions.rounding import percent_text, round_even
from commlens.schema import BINARY_COLUMNS, CRITICAL_COLUMNS, DOMAINS, REQUIRED_COLUMNS, TARGET, WARNED_RANGES
from commlens.settings import DEFAULTS, Settings

ERROR, WARNING = "error", "warning"


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def non_numeric(df: DataFrame, names: list[str]) -> list[str]:
    return [f.name for f in df.select(*names).schema if not isinstance(f.dataType, T.NumericType)]


# --- predicates of a bad value ---------------------------------------------------------------------------------


def _missing(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _not_binary(name: str) -> Column:
    # a missing flag is not binary either: NULL IN (0, 1) is NULL, not false
    return ~F.coalesce(F.col(name).isin(0, 1), F.lit(False))


def _unexpected(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).isin(DOMAINS[name])


def _outside(name: str, low: float, high: float) -> Column:
    # NaN compares as greater than everything in Spark; it is missing here, not out of range
    value = F.col(name)
    return (value < low) | ((value > high) & ~F.isnan(value))


# --- the single pass -------------------------------------------------------------------------------------------


def _aggregates(df: DataFrame) -> list[Column]:
    present = set(df.columns)
    aggregates = [F.count("*").alias("row_count")]
    aggregates += [F.count_if(_missing(df, c)).alias(f"null_{c}") for c in df.columns]
    aggregates += [F.count_if(_not_binary(c)).alias(f"binary_{c}") for c in BINARY_COLUMNS if c in present]
    aggregates += [F.count_if(_unexpected(c)).alias(f"domain_{c}") for c in DOMAINS if c in present]
    aggregates += [
        F.count_if(_outside(c, low, high)).alias(f"range_{c}")
        for c, (low, high) in {"engagement_score": (0, 1), **WARNED_RANGES}.items()
        if c in present
    ]
    for column, name in (
        (TARGET, "intervention_rate"),
        ("engagement_score", "engagement_mean"),
        ("complaint_flag", "complaint_rate"),
    ):
        known = F.when(~_missing(df, column), F.col(column)) if column in present else F.lit(None).cast("double")
        aggregates.append(F.avg(known).alias(name))
    return aggregates


def profile(df: DataFrame) -> DataFrame:
    """One row with every count and mean the checks need."""
    return df.agg(*_aggregates(df))


def _finding(check: str, name: str | None, severity: str, failures: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_name"),
        F.lit(name).cast("string").alias("column_name"),
        F.lit(severity).alias("severity"),
        failures.cast("bigint").alias("failures"),
        detail.alias("detail"),
    )


def _count_finding(check: str, prefix: str, name: str, severity: str, before: str, after: str) -> Column:
    failures = F.col(f"{prefix}_{name}")
    detail = F.concat(F.lit(before), failures.cast("string"), F.lit(after))
    return F.when(failures > 0, _finding(check, name, severity, failures, detail))


# The message texts below.


def _findings(settings: Settings) -> list[Column]:
    """Findings over the profile row, in check order; NULL where the check passes."""
    others = [c for c in REQUIRED_COLUMNS if c not in CRITICAL_COLUMNS]
    found = [
        _count_finding("nulls", "null", c, ERROR, f"Nulls in critical column '{c}': ", " rows")
        for c in CRITICAL_COLUMNS
    ]
    found += [_count_finding("nulls", "null", c, WARNING, f"Nulls in '{c}': ", " rows") for c in others]
    found += [
        _count_finding("binary", "binary", c, ERROR, f"Column '{c}' contains non-binary values: ", " rows")
        for c in BINARY_COLUMNS
    ]
    found += [
        _count_finding("domain", "domain", c, ERROR, f"Column '{c}' has unexpected values: ", " rows")
        for c in DOMAINS
    ]
    found.append(
        _count_finding(
            "score_range", "range", "engagement_score", ERROR, "engagement_score out of [0,1] range: ", " rows"
        )
    )
    found += [
        _count_finding("numeric_range", "range", c, WARNING, f"Column '{c}' has ", f" values outside [{low}, {high}]")
        for c, (low, high) in WARNED_RANGES.items()
    ]
    rows, rate = F.col("row_count"), F.col("intervention_rate")
    found.append(
        F.when(
            rows < settings.min_rows,
            _finding(
                "row_count",
                None,
                WARNING,
                rows,
                F.concat(
                    F.lit("Dataset has only "), rows.cast("string"), F.lit(f" rows (expected >= {settings.min_rows})")
                ),
            ),
        )
    )
    low = F.concat(
        F.lit("Intervention rate very low: "), percent_text(rate), F.lit(" — model may struggle")
    )
    high = F.concat(
        F.lit("Intervention rate very high: "), percent_text(rate), F.lit(" — check target definition")
    )
    found.append(
        F.when(
            rate < settings.min_intervention_rate, _finding("intervention_rate", TARGET, WARNING, F.lit(1), low)
        ).when(rate > settings.max_intervention_rate, _finding("intervention_rate", TARGET, WARNING, F.lit(1), high))
    )
    return found


def _stats(df: DataFrame) -> list[Column]:
    null_total = F.col(f"null_{df.columns[0]}")
    for name in df.columns[1:]:
        null_total = null_total + F.col(f"null_{name}")
    return [
        F.col("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        null_total.alias("null_total"),
        round_even(F.col("engagement_mean")).alias("engagement_mean"),
        round_even(F.col("complaint_rate")).alias("complaint_rate"),
        round_even(F.col("intervention_rate")).alias("intervention_rate"),
    ]


# --- results ---------------------------------------------------------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    """column_name, severity, nulls: one row per required column."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(ERROR if c in CRITICAL_COLUMNS else WARNING).alias("severity"),
            F.col(f"null_{c}").alias("nulls"),
        )
        for c in REQUIRED_COLUMNS
    ]
    return profile(df).select(F.inline(F.array(*rows)))


def range_counts(df: DataFrame) -> DataFrame:
    """column_name, low, high, severity, failures for the bounded numbers."""
    bounds = {"engagement_score": (0, 1), **WARNED_RANGES}
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(low).cast("bigint").alias("low"),
            F.lit(high).cast("bigint").alias("high"),
            F.lit(ERROR if c == "engagement_score" else WARNING).alias("severity"),
            F.col(f"range_{c}").alias("failures"),
        )
        for c, (low, high) in bounds.items()
    ]
    return profile(df).select(F.inline(F.array(*rows)))


def _bad_values(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """column_name, value, failures: each distinct bad value with its row count.

    Only bad values leave the row, and they are counted map-side, so clean data shuffles nothing and a value
    that fills a third of the table is one partial count per task.
    """
    hits = F.array(
        *[
            F.when(bad, F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
            for c, bad in predicates.items()
        ]
    )
    return (
        df.select(F.inline(F.array_compact(hits)))
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("failures"))
    )


def non_binary_values(df: DataFrame) -> DataFrame:
    return _bad_values(df, {c: _not_binary(c) for c in BINARY_COLUMNS if c in df.columns})


def unexpected_values(df: DataFrame) -> DataFrame:
    return _bad_values(df, {c: _unexpected(c) for c in DOMAINS if c in df.columns})


def stats(df: DataFrame) -> DataFrame:
    return profile(df).select(*_stats(df))


def report(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per failed check: position, check_name, column_name, severity, failures, detail."""
    absent = missing_columns(df)
    if absent:
        return df.sparkSession.range(1).select(
            F.lit(0).alias("position"),
            F.lit("required_columns").alias("check_name"),
            F.lit(None).cast("string").alias("column_name"),
            F.lit(ERROR).alias("severity"),
            F.lit(len(absent)).cast("bigint").alias("failures"),
            F.lit(f"Missing required columns: {absent}").alias("detail"),
        )
    return (
        profile(df)
        .select(F.posexplode(F.array(*_findings(settings))).alias("position", "finding"))
        .where(F.col("finding").isNotNull())
        .select("position", "finding.*")
    )


@dataclass
class ValidationReport:
    passed: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stats: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> str:
        text = f"Validation {'PASSED' if self.passed else 'FAILED'}\n"
        text += f"  Errors   : {len(self.errors)}\n  Warnings : {len(self.warnings)}"
        for title, mark, messages in (("Error", "✗", self.errors), ("Warning", "⚠", self.warnings)):
            if messages:
                text += f"\n  {title} details:" + "".join(f"\n    {mark} {m}" for m in messages)
        return text


def validate(df: DataFrame, settings: Settings = DEFAULTS) -> ValidationReport:
    """Run all checks in one job. A missing column stops the rest."""
    absent = missing_columns(df)
    if absent:
        return ValidationReport(passed=False, errors=[f"Missing required columns: {absent}"])
    return _judged(df, profile(df), settings)


def observed(df: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, Callable[[], ValidationReport]]:
    """df, and a function that gives the report once df has been written or collected.

    The counts of all checks are taken while the rows pass by, so checking costs no read of its own. A missing column
    is known before.
    """
    if missing_columns(df):
        return df, lambda: validate(df, settings)
    observation = Observation()
    aggregates = _aggregates(df)
    schema = df.limit(0).agg(*aggregates).schema

    def judge() -> ValidationReport:
        found = observation.get
        row = df.sparkSession.createDataFrame([tuple(found[f.name] for f in schema)], schema)
        return _judged(df, row, settings)

    return df.observe(observation, *aggregates), judge


def _judged(df: DataFrame, counts: DataFrame, settings: Settings) -> ValidationReport:
    row = (
        counts
        .select(
            F.array_compact(F.array(*_findings(settings))).alias("findings"),
            F.struct(*_stats(df)).alias("stats"),
        )
        .first()
    )
    errors = [f["detail"] for f in row["findings"] if f["severity"] == ERROR]
    warnings = [f["detail"] for f in row["findings"] if f["severity"] == WARNING]
    return ValidationReport(not errors, errors, warnings, row["stats"].asDict())
