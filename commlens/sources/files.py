"""CSV sinks, record sources, and the NaN rule."""

from __future__ import annotations

from typing import Any, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from commlens.schema import COMMUNICATIONS


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column; afterwards only NULL means missing."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: F.when(~F.isnan(F.col(name)), F.col(name)) for name in floating})


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; dates as ISO text, missing values as empty fields."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    text = df.withColumns({name: F.date_format(name, "yyyy-MM-dd") for name in dates})
    text.write.mode("overwrite").option("header", True).csv(path)
    return path


def schema_of(names: Iterable[str]) -> T.StructType:
    """Table fields for known names, strings for others."""
    known = {f.name: f for f in COMMUNICATIONS}
    return T.StructType([known.get(name, T.StructField(name, T.StringType())) for name in names])


def from_records(spark: SparkSession, records: Iterable[Mapping[str, Any]], typed: bool = True) -> DataFrame:
    """Frame of dict records. Columns no record carries stay absent, so defaults can tell absent from NULL.

    Untyped, every column is text: for admission and case texts, which parse leniently.
    """
    rows = [dict(r) for r in records]
    present = {key for row in rows for key in row}
    names = [n for n in COMMUNICATIONS.fieldNames() if n in present]
    names += sorted(present - set(names))
    loose = T.StructType(
        [
            T.StructField(
                f.name, T.StringType() if not typed or isinstance(f.dataType, T.DateType) else f.dataType
            )
            for f in schema_of(names)
        ]
    )
    values = [[_plain(row.get(f.name), f.dataType) for f in loose] for row in rows]
    return spark.createDataFrame(values, loose)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The bulk form of from_records: JSON lines under the fixed schema, no inference pass."""
    return nan_to_null(spark.read.schema(COMMUNICATIONS).json(path))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def _plain(value: Any, kind: T.DataType) -> Any:
    """The value in the column's Python type; NaN is missing, a number that does not fit raises ValueError."""
    if value is None or value != value:
        return None
    if isinstance(kind, T.StringType):
        return value.isoformat() if hasattr(value, "isoformat") else str(value)
    number = float(value)
    if isinstance(kind, T.IntegerType):
        if not number.is_integer():
            raise ValueError(f"{value!r} is not an integer")
        return int(number)
    return number
