"""Evaluation of a score column against a label column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from commlens.functions.rounding import round_even

# a window ranks the values of one digit; a prefix is that many digits of a score in [0, 1]
DIGIT_BITS = 16
PREFIX_BITS = 48


def _exact(count: Column) -> Column:
    return count.cast("decimal(18,0)")


def auc_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives, and ``pairs``, twice the pairs a positive wins plus the pairs that tie.

    A rank sum by radix, in one lazy plan. Labels are counted per distinct score, map-side first, so a frequent
    score is one row per task. Distinct scores are then ranked inside prefixes of 48 bits, these inside prefixes of 32
    bits, and so on: each step adds the pairs that part at its digit and sums the prefix up. No window sees more than
    65,536 rows while scores lie in [0, 1] and differ by 2**-48 or more; others are ranked right in larger windows.
    Rows without a score or without a label 0 or 1 do not count.
    """
    value = F.col("score")
    # scaling by powers of two is exact, so prefixes nest
    prefix = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * float(1 << PREFIX_BITS))
    rows = (
        df.select(F.nanvl(F.col(score).cast("double"), F.lit(None)).alias("score"), F.col(label).alias("label"))
        .where(value.isNotNull() & F.col("label").isin(0, 1))
        .groupBy("score")
        .agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
        .withColumn("prefix", F.least(prefix.cast("bigint"), F.lit((1 << PREFIX_BITS) - 1)))
        .withColumn("pairs", (_exact(F.col("positives")) * _exact(F.col("negatives"))).cast("decimal(38,0)"))
    )
    order, group = "score", F.col("prefix")
    for _ in range(PREFIX_BITS // DIGIT_BITS + 1):
        rows = rows.withColumn("group", group)
        lower = Window.partitionBy("group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("negatives").over(lower), F.lit(0))
        won = (_exact(F.col("positives")) * _exact(below) * 2).cast("decimal(38,0)")
        rows = (
            rows.withColumn("pairs", (F.col("pairs") + won).cast("decimal(38,0)"))
            .groupBy(F.col("group").alias("prefix"))
            .agg(*[F.sum(c).cast(t).alias(c) for c, t in (("positives", "bigint"), ("negatives", "bigint"), ("pairs", "decimal(38,0)"))])
        )
        order, group = "prefix", F.shiftright("prefix", DIGIT_BITS)
    return rows.agg(*[F.sum(c).alias(c) for c in ("positives", "negatives", "pairs")])


def _area() -> Column:
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return F.try_divide(F.col("pairs").cast("double"), pairs * 2)


def ranking(df: DataFrame, score: str, label: str) -> DataFrame:
    """One lazy row: rows, positives, roc_auc (ties averaged; NULL where a class has no row)."""
    return auc_counts(df, score, label).select(
        (F.col("positives") + F.col("negatives")).alias("rows"), "positives", round_even(_area()).alias("roc_auc")
    )


def roc_auc_frame(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking(df, score, label).select("roc_auc")


def roc_auc(df: DataFrame, score: str, label: str) -> float:
    """The unrounded area; NaN where a class has no row."""
    area = auc_counts(df, score, label).select(_area().alias("area")).first()["area"]
    return float("nan") if area is None else area


def confusion_matrix(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row: true_negatives, false_positives, false_negatives, true_positives."""
    p, y = F.col(predicted), F.col(label)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )


def classification_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """label, precision, recall, f1, support, accuracy for both classes; 0 where a denominator is 0."""
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")

    def ratio(part: Column, whole: Column) -> Column:
        return round_even(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)))

    def row(value: int, hit: Column, missed: Column, wrong: Column) -> Column:
        return F.struct(
            F.lit(value).alias("label"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(hit * 2, hit * 2 + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
            ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        )

    return confusion_matrix(df, predicted, label).select(
        F.inline(F.array(row(0, tn, fp, fn), row(1, tp, fn, fp)))
    )


def metrics(df: DataFrame, score: str, predicted: str, label: str) -> DataFrame:
    """One lazy row: rows, positives, roc_auc, accuracy, and precision, recall, f1 of the positive class."""
    counts = auc_counts(df, score, label)
    return (
        classification_report(df, predicted, label)
        .where(F.col("label") == 1)
        .select(
            df.agg(F.count("*")).scalar().alias("rows"),
            F.col("support").alias("positives"),
            counts.select(round_even(_area())).scalar().alias("roc_auc"),
            "accuracy",
            "precision",
            "recall",
            "f1",
        )
    )
