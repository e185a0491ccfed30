"""The communications table: columns, types, domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order and domains of the communications table.
COMMUNICATIONS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("sent_date", T.DateType()),
        T.StructField("opened", T.IntegerType()),
        T.StructField("clicked", T.IntegerType()),
        T.StructField("response_flag", T.IntegerType()),
        T.StructField("complaint_flag", T.IntegerType()),
        T.StructField("escalation_flag", T.IntegerType()),
        T.StructField("engagement_score", T.DoubleType()),
        T.StructField("sentiment_text", T.StringType()),
        T.StructField("premium_bucket", T.StringType()),
        T.StructField("tenure_months", T.IntegerType()),
        T.StructField("days_since_last_contact", T.IntegerType()),
        T.StructField("opt_out_flag", T.IntegerType()),
        T.StructField("needs_intervention", T.IntegerType()),
    ]
)

REQUIRED_COLUMNS = COMMUNICATIONS.fieldNames()
CRITICAL_COLUMNS = ["customer_id", "segment", "engagement_score", "needs_intervention"]
BINARY_COLUMNS = [
    "opened",
    "clicked",
    "response_flag",
    "complaint_flag",
    "escalation_flag",
    "opt_out_flag",
    "needs_intervention",
]
DOMAINS = {
    "segment": ["Premium", "Standard", "Basic"],
    "product_type": ["Auto", "Home", "Life", "Health"],
    "channel": ["Email", "SMS", "Phone", "Direct Mail"],
    "premium_bucket": ["Low", "Mid", "High"],
    "sentiment_text": ["positive", "neutral", "negative", "mixed"],
}
WARNED_RANGES = {"tenure_months": (1, 120), "days_since_last_contact": (0, 365)}

ID = "customer_id"
TARGET = "needs_intervention"
