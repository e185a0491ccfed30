"""Hand-made frames."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from commlens.schema import COMMUNICATIONS

END = date(2024, 3, 31)

# One case that meets several arms of the target rule, one that meets none, and one that meets only the complaint arm.
SAFE = {
    "customer_id": "CASE_CALM",
    "segment": "Premium",
    "product_type": "Health",
    "channel": "SMS",
    "campaign_id": "CAMP_006",
    "sent_date": "2024-02-17",
    "opened": 1,
    "clicked": 1,
    "response_flag": 1,
    "complaint_flag": 0,
    "escalation_flag": 0,
    "engagement_score": 0.9,
    "sentiment_text": "positive",
    "premium_bucket": "Mid",
    "tenure_months": 61,
    "days_since_last_contact": 12,
    "opt_out_flag": 0,
}
COMPLAINT = {
    **SAFE,
    "customer_id": "CASE_COMPLAINT",
    "segment": "Standard",
    "clicked": 0,
    "response_flag": 0,
    "complaint_flag": 1,
    "engagement_score": 0.2,
    "sentiment_text": "negative",
    "days_since_last_contact": 118,
}
RISKY = {
    **COMPLAINT,
    "customer_id": "CASE_SEVERAL",
    "opened": 0,
    "escalation_flag": 1,
    "engagement_score": 0.0,
    "tenure_months": 17,
    "days_since_last_contact": 141,
    "opt_out_flag": 0,
}


def case(**values):
    """One valid row, with changes."""
    row = {**SAFE, "sent_date": date(2024, 1, 1), "needs_intervention": 0, **values}
    return tuple(row[f] for f in COMMUNICATIONS.fieldNames())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COMMUNICATIONS)


def dated(spark, n_days=20, rows_per_day=10, spike_day=None, drop_segment=None):
    """n_days up to END; score 0.65, or 0.10 for one segment in the last seven days; all complaints on one day."""
    rows = []
    for day in range(n_days):
        for i in range(rows_per_day):
            segment = ["Premium", "Standard", "Basic"][i % 3]
            low = segment == drop_segment and day >= n_days - 7
            rows.append(
                case(
                    customer_id=f"CUST_{day:03d}_{i:03d}",
                    segment=segment,
                    campaign_id=f"CAMP_{i % 3 + 1:03d}",
                    sent_date=END - timedelta(days=n_days - 1 - day),
                    engagement_score=0.10 if low else 0.65,
                    opened=0 if low else 1,
                    complaint_flag=int(day == spike_day),
                )
            )
    return frame(spark, *rows)


def never_opened(df, campaign):
    return df.withColumn("opened", F.when(F.col("campaign_id") == campaign, 0).otherwise(F.col("opened")))


def records(df):
    return [r.asDict() for r in df.collect()]
