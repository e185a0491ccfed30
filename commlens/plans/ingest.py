"""Ingest: quality gate, cleaning, table, CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from commlens.operators.cleaning import keep_first_of_few, normalise_rows
from commlens.operators.quality import ValidationReport, missing_columns, observed, validate
from commlens.schema import REQUIRED_COLUMNS
from commlens.settings import DEFAULTS, Settings
from commlens.sources.files import nan_to_null, write_csv
from commlens.sources.staging import discard, staged
from commlens.sources.tables import write_table


def ingest(
    raw: DataFrame,
    settings: Settings = DEFAULTS,
    raw_csv: str | None = None,
    processed_csv: str | None = None,
    skip_validation: bool = False,
    partition_by: str | None = "sent_date",
) -> DataFrame:
    """Write the clean table, replacing it, and return it. Raises ValueError when a quality check fails.

    The checks see the rows as they arrive, before stripping: padded values are errors, not repaired. The feed is read
    once: its rows are written to a staged table, and every check is counted on the way. Only if the checks pass is the staged
    table cleaned and published; a rejected feed leaves the old table as it was. The CSV copies are optional extra outputs.
    """
    spark = raw.sparkSession
    raw = nan_to_null(raw)
    if not skip_validation and missing_columns(raw):
        _accept(validate(raw, settings))
    watched, judge = (raw, None) if skip_validation else observed(raw, settings)
    path = staged(watched, "ingest")
    try:
        arrived = spark.read.schema(raw.schema).parquet(path)
        if raw_csv is not None:
            write_csv(arrived, raw_csv)
        if judge is not None:
            _accept(judge())
        write_table(keep_first_of_few(normalise_rows(arrived)), settings.table_name, partition_by=partition_by)
    finally:
        discard(spark, path)
    table = spark.table(settings.table_name)
    ordered = [c for c in REQUIRED_COLUMNS if c in table.columns]
    table = table.select(*ordered, *[c for c in table.columns if c not in ordered])
    if processed_csv is not None:
        write_csv(table, processed_csv)
    return table


def _accept(report: ValidationReport) -> None:
    if not report.passed:
        raise ValueError(f"Validation failed:\n{report.summary()}")
