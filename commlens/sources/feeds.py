"""Communications derived from the driver tables: one case per event, joined with its customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from commlens.functions.business import (
    engagement_score,
    id_label,
    needs_intervention,
    sentiment_band,
    true_only,
)
from commlens.schema import REQUIRED_COLUMNS

# the columns used, declared, so that opening the tables starts no job
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string"
CUSTOMER = "c_custkey bigint, c_acctbal double, c_mktsegment string"


def _pick(key: Column, *labels: str) -> Column:
    """labels[key]"""
    chosen = F.when(key == 0, labels[0])
    for position, label in enumerate(labels[1:-1], start=1):
        chosen = chosen.when(key == position, label)
    return chosen.otherwise(labels[-1])


def communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table."""
    return _numbered(spark, sf_dir).select(*REQUIRED_COLUMNS)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table and the number ``n`` of each case.

    Integer arithmetic only, so that any engine derives the same rows. No broadcast hint: the customer side grows
    with the data, so Catalyst and AQE choose by size, and AQE splits the partition of a user who owns a large share
    of the events.
    """
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    customers = spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet")
    joined = events.join(customers, events["user_id"] == customers["c_custkey"])

    event, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind, market, sent = F.col("event_type"), F.col("c_mktsegment"), F.col("sent_date")
    slot = event % 20

    def flag(condition: Column) -> Column:
        return true_only(condition).cast("int")

    based = joined.withColumns(
        {
            # the number in {"k": n}
            "k": F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("int"),
            "sent_date": F.col("ts").cast("date"),
        }
    )
    flagged = based.select(
        event.alias("n"),
        id_label("CUST", event, 9).alias("customer_id"),
        F.when(market == "AUTOMOBILE", "Premium")
        .when(market.isin("BUILDING", "MACHINERY"), "Standard")
        .otherwise("Basic")
        .alias("segment"),
        _pick(user % 4, "Auto", "Home", "Life", "Health").alias("product_type"),
        F.when(slot < 9, "Email").when(slot < 14, "SMS").when(slot < 18, "Phone").otherwise("Direct Mail").alias(
            "channel"
        ),
        id_label("CAMP", k % 10 + 1, 3).alias("campaign_id"),
        sent,
        F.when(~kind.isin("view", "click", "purchase"), 0)
        .when((k % 10 == 7) & (k % 40 != 17), 0)
        .when((market == "AUTOMOBILE") & (sent >= F.lit("2024-01-24").cast("date")) & (k % 2 == 1), 0)
        .otherwise(1)
        .alias("opened"),
        kind.isin("click", "purchase").alias("follows_link"),
        flag((event * 7 + k) % 4 == 0).alias("response_flag"),
        flag(
            ((event * 11 + user * 3 + k) % 20 == 0)
            | ((kind == "error") & (sent == F.lit("2024-01-15").cast("date")))
        ).alias("complaint_flag"),
        flag((event * 17 + k) % 33 == 0).alias("escalation_flag"),
        flag((event * 13 + k) % 25 < 2).alias("opt_out_flag"),
        F.when(F.col("c_acctbal") < 2500, "Low").when(F.col("c_acctbal") < 7000, "Mid").otherwise("High").alias(
            "premium_bucket"
        ),
        (user * 7 % 120 + 1).cast("int").alias("tenure_months"),
        (event * 37 % 181).cast("int").alias("days_since_last_contact"),
    )
    return (
        flagged.withColumn("clicked", F.when(F.col("follows_link"), F.col("opened")).otherwise(0))
        .withColumn("engagement_score", engagement_score())
        .withColumn("sentiment_text", sentiment_band(F.col("engagement_score")))
        .withColumn("needs_intervention", needs_intervention())
        .select("n", *REQUIRED_COLUMNS)
    )


def raw_feed(spark: SparkSession, sf_dir: str, bad_dates: bool = False) -> DataFrame:
    """All communications as an untidy feed: padded text, repeated customer ids, missing and wrong values.

    Every row of the clean table is here once. Each fault hits the rows whose number a prime divides, so all
    faults occur alone and together.
    """
    user = F.col("tenure_months") * 10 + F.col("n") % 7

    def every(prime: int) -> Column:
        return F.col("n") % prime == 0

    date_text = F.date_format("sent_date", "yyyy-MM-dd")
    sent = F.when(F.col("n") % 2 == 0, F.concat(date_text, F.lit(" 09:30:00"))).otherwise(date_text)
    if bad_dates:
        sent = F.when(every(103), F.lit("not a date")).otherwise(sent)

    return (
        _numbered(spark, sf_dir)
        .withColumns(
            {
                "customer_id": F.when(every(101), F.lit(None)).otherwise(id_label("CUST", user, 6)),
                "segment": F.when(every(97), F.lit(None))
                .when(every(89), "Gold")
                .when(every(13), F.concat(F.lit("  "), F.col("segment"), F.lit(" ")))
                .otherwise(F.col("segment")),
                "channel": F.when(every(17), F.concat(F.col("channel"), F.lit("\t\u00a0"))).otherwise(
                    F.col("channel")
                ),
                "sent_date": sent,
                "opened": F.when(~every(107), F.col("opened")),
                "complaint_flag": F.when(every(109), 2).otherwise(F.col("complaint_flag")),
                "engagement_score": F.when(every(113), 1.5)
                .when(every(127), -0.2)
                .when(every(131), F.lit(None))
                .otherwise(F.col("engagement_score")),
                "sentiment_text": F.when(every(157), "angry").otherwise(F.col("sentiment_text")),
                "tenure_months": F.when(every(139), 0).otherwise(F.col("tenure_months")),
                "days_since_last_contact": F.when(every(149), 400)
                .when(every(151), -1)
                .otherwise(F.col("days_since_last_contact")),
                "needs_intervention": F.when(~every(163), F.col("needs_intervention")),
            }
        )
        .drop("n")
    )
