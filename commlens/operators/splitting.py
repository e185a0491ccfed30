"""Exact stratified split and folds without moving the rows.

Rows of a class are ordered by the MD5 of their id; the first ``ceil(fraction * n)`` are the test set, and the rest
falls into equal consecutive folds. A window per class would sort half the table in one task. Here the cut points
are found by radix selection: a histogram over the first four hex digits (65,536 buckets a class) tells in which bucket each cut
falls. While such a bucket holds more than ``RANKED_ROWS`` rows, it is refined by the next four digits, with one more count over its
rows; only what is left is ranked, one small group per cut. At 10**12 rows that takes two histograms; ids that crowd
into one bucket take more, and the bound stays. The cut points are then compared with each row's hash in a plain projection.

Every pass counts before it shuffles, so an id that is repeated (cleaning removes repeats) costs one partial count
per task; all its rows land on the same side. The driver holds the cuts only: at most ``folds`` of each of three classes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from commlens.schema import ID, TARGET
from commlens.settings import DEFAULTS, Settings

DIGITS, ALL_DIGITS = 4, 32
RANKED_ROWS = 1 << 16
# the class of rows whose label is neither 0 nor 1
UNLABELLED = -1


@dataclass(frozen=True)
class Cut:
    """The cut after ``place`` rows of the bucket ``prefix`` (``n`` rows) of a class."""

    label: int
    rows: int
    test_rows: int
    number: int
    prefix: str
    place: int
    n: int


def hash_key() -> Column:
    return F.md5(F.coalesce(F.col(ID), F.lit("")))


def _label() -> Column:
    return F.when(F.col(TARGET).isin(0, 1), F.col(TARGET).cast("int")).otherwise(UNLABELLED)


def _first_cuts(keyed: DataFrame, settings: Settings) -> list[Cut]:
    in_class = Window.partitionBy("label")
    histogram = (
        keyed.groupBy("label", F.substring("key", 1, DIGITS).alias("prefix"))
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(in_class.orderBy("prefix")) - F.col("n"))
        .withColumn("rows", F.sum("n").over(in_class))
        .withColumn("test_rows", F.ceil(F.lit(settings.test_fraction) * F.col("rows")))
    )
    rest = F.col("rows") - F.col("test_rows")
    ranks = [F.col("test_rows")]
    ranks += [F.col("test_rows") + F.ceil(rest * fold / F.lit(float(settings.folds))) for fold in range(1, settings.folds)]
    found = (
        histogram.select("*", F.posexplode(F.array(*ranks)).alias("number", "rank"))
        .where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        .withColumn("place", F.col("rank") - F.col("before"))
    )
    names = Cut.__dataclass_fields__
    return [Cut(*[r[c] for c in names]) for r in found.select(*names).collect()]


def _refined(keyed: DataFrame, cuts: list[Cut], digits: int) -> list[Cut]:
    """The cuts in the buckets of ``digits`` more digits; with all digits a bucket is one hash."""
    length = len(cuts[0].prefix)
    buckets = keyed.sparkSession.createDataFrame(
        sorted({(c.label, c.prefix) for c in cuts}), "label int, prefix string"
    )
    # at most folds rows of each of three classes
    histogram = (
        keyed.withColumn("prefix", F.substring("key", 1, length))
        .join(F.broadcast(buckets), ["label", "prefix"])
        .groupBy("label", "prefix", F.substring("key", 1, length + digits).alias("longer"))
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("label", "prefix").orderBy("longer")))
    )
    wanted = keyed.sparkSession.createDataFrame(
        [(c.label, c.prefix, c.number, c.place) for c in cuts], "label int, prefix string, number int, place long"
    )
    inside = (F.col("upto") - F.col("n") < F.col("place")) & (F.col("place") <= F.col("upto"))
    found = histogram.join(F.broadcast(wanted), ["label", "prefix"]).where(inside)
    by_number = {(c.label, c.number): c for c in cuts}
    return [
        replace(by_number[r["label"], r["number"]], prefix=r["longer"], place=r["place"] - r["upto"] + r["n"], n=r["n"])
        for r in found.collect()
    ]


def cut_points(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """label, rows, test_rows, cuts (hashes of the last test row and of each fold's last row).

    Three rows at most: one per class, one for rows without a valid label if there are any.
    """
    keyed = df.select(_label().alias("label"), hash_key().alias("key"))
    cuts = _first_cuts(keyed, settings)
    length = DIGITS
    while length < ALL_DIGITS and any(c.n > RANKED_ROWS for c in cuts):
        cuts, length = _refined(keyed, cuts, DIGITS), length + DIGITS
    if cuts and length < ALL_DIGITS:
        cuts = _refined(keyed, cuts, ALL_DIGITS - length)
    classes = {c.label: (c.label, c.rows, c.test_rows) for c in cuts}
    rows = [(*own, sorted(c.prefix for c in cuts if c.label == label)) for label, own in sorted(classes.items())]
    return df.sparkSession.createDataFrame(rows, "label int, rows long, test_rows long, cuts array<string>")


def assign_slots(df: DataFrame, cuts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``slot``: 0 is the test set, 1..folds the training folds. Only rows labelled 0 or 1 have a slot."""
    key = hash_key()
    slot = F.lit(0)
    for position in range(settings.folds):
        slot = slot + (key > F.col("cuts")[position]).cast("int")
    # at most three rows
    joined = df.join(F.broadcast(cuts.select(F.col("label").alias("_label"), "cuts")), F.col(TARGET) == F.col("_label"))
    return joined.withColumn("slot", slot).drop("_label", "cuts")


def stratified_split(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``slot`` (0 test, 1..folds) and ``part`` ("test" or "train")."""
    part = F.when(F.col("slot") == 0, "test").otherwise("train")
    return assign_slots(df, cut_points(df, settings), settings).withColumn("part", part)


def class_weights(df: DataFrame) -> DataFrame:
    """label, rows, weight: rows / (classes * rows of the class), the balanced weights."""
    classes = df.groupBy(_label().alias("label")).agg(F.count("*").alias("rows")).where(F.col("label") != UNLABELLED)
    # at most two rows
    both = Window.partitionBy()
    return classes.withColumn(
        "weight", F.sum("rows").over(both).cast("double") / (F.count("*").over(both) * F.col("rows"))
    )
