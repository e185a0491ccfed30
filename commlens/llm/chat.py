"""Multi-party perspective rotation. DataFrame functions only.

For every participant of a conversation the dialogue is rendered once, with that speaker as assistant, the others as named
users, and only the assistant's content trainable. A dialogue is returned as its turns in order: `content` of positions 1, 2, ...
joined gives the text, `start` and `end` are code point offsets in it, and `mask_start` to `mask_end` is the trainable span
(null in other turns). So no dialogue is gathered into one row or one task, however long it is.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. Offsets come from two prefix sums:
within blocks of BLOCK turn numbers, then over the blocks. A null role is the speaker "unknown", a null text is empty, turns
with a null conv_id are one conversation. Speakers in `system` are no participants: their turns are rendered as system turns.
A conversation of system turns only has no participant and gives no row. "<|" inside names and texts is written "< |", so that
content cannot forge a marker. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 64
END = "<|end|>\n"


def rotated(conversations: DataFrame, system: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, participant, position, turn, role, name, content, start, end, mask_start, mask_end."""

    def plain(column):
        return F.replace(column, F.lit("<|"), F.lit("< |"))

    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        plain(F.coalesce("text", F.lit(""))).alias("text"),
    )
    people = (
        turns.where(~F.col("speaker").isin(*system))
        .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant"))
        .distinct()
    )
    own = F.col("speaker") == F.col("participant")
    marker = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(F.col("speaker").isin(*system), F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), plain(F.col("speaker")), F.lit("|>\n")))
    )
    rows = turns.join(people, turns["conv_id"].eqNullSafe(people["_conv"])).select(
        "conv_id",
        "participant",
        "turn",
        F.floor(F.col("turn") / BLOCK).alias("block"),
        F.when(own, F.lit("assistant")).when(F.col("speaker").isin(*system), F.lit("system")).otherwise(F.lit("user")).alias("role"),
        "speaker",
        "text",
        F.length(marker).alias("_marker"),
        F.concat(marker, F.col("text"), F.lit(END)).alias("content"),
    )
    rows = rows.withColumn("_length", F.length("content").cast("long"))
    key = ["conv_id", "participant", "block"]
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "text")]
    before = Window.partitionBy("conv_id", "participant").orderBy(F.col("block").asc_nulls_first())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*key)
        .agg(F.sum("_length").alias("_sum"), F.count(F.lit(1)).alias("_count"))
        .select(
            *(F.col(c).alias(f"_{c}") for c in key),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
            F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_turns"),
        )
    )
    within = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("_place", F.row_number().over(within)).withColumn(
        "_to", F.sum("_length").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    start = F.col("_base") + F.col("_to") - F.col("_length")
    trains = F.col("role") == "assistant"
    return rows.join(blocks, same).select(
        "conv_id",
        "participant",
        (F.col("_turns") + F.col("_place")).alias("position"),
        "turn",
        "role",
        F.when(F.col("role") == "user", F.col("speaker")).alias("name"),
        "content",
        start.alias("start"),
        (F.col("_base") + F.col("_to")).alias("end"),
        F.when(trains, start + F.col("_marker")).alias("mask_start"),
        F.when(trains, F.col("_base") + F.col("_to") - 1).alias("mask_end"),
    )
