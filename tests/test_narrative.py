import pytest

from commlens.operators import narrative
from commlens.sources.files import from_records

CASE = {
    "customer_id": "N-17",
    "segment": "Standard",
    "channel": "Email",
    "sentiment_text": "mixed",
    "engagement_score": 0.31,
    "complaint_flag": 0,
    "escalation_flag": 0,
    "days_since_last_contact": 52,
}
# fixed values: the sentences of the summary
AT_RISK = (
    "This Standard segment customer is showing elevated intervention risk (score: 0.76) with mixed sentiment and "
    "52 days since last contact."
)
COMPLAINED = (
    "A complaint has been raised by this Standard customer, with engagement score at 0.31 and risk band flagged as Low."
)
DECLINED = (
    "Engagement for this Standard customer has declined to 0.31 over the past period, with 52 days since last "
    "meaningful contact."
)
EMAIL = (
    "Recommend reducing Email frequency and switching to a personalised SMS or phone outreach within the next 7 days."
)
SMS = (
    "Recommend escalating from SMS to a direct phone call to re-establish engagement and address any outstanding "
    "concerns."
)
OTHER = (
    "Recommend a direct follow-up via Direct Mail with a personalised retention offer tailored to the Standard segment."
)
CALM = "Monitor engagement over the next 14 days and escalate if intervention score remains above 0.45."
FLAGGED = (
    "Broader segment-level anomalies have been detected — review campaign messaging for this cohort before next "
    "outreach."
)


def scored(spark, score, band, **changes):
    from pyspark.sql import functions as F

    df = from_records(spark, [{**CASE, **changes}])
    return df.withColumns({"intervention_score": F.lit(score), "risk_band": F.lit(band)})


@pytest.mark.parametrize(
    "score, band, changes, anomalies, expected",
    [
        (0.76, "High", {}, "", [AT_RISK, EMAIL, CALM]),
        (0.76, "Low", {"escalation_flag": 1, "channel": "SMS"}, "", [AT_RISK, SMS, CALM]),
        (0.76, "High", {"complaint_flag": 1}, "", [AT_RISK, EMAIL, CALM]),
        (0.1, "Low", {"complaint_flag": 1}, "", [COMPLAINED, EMAIL, CALM]),
        (0.1, "Low", {"channel": "Direct Mail"}, "[⚠ FLAGGED] x", [DECLINED, OTHER, FLAGGED]),
        (0.1, "Medium", {}, "[✓ OK] x", [DECLINED, EMAIL, CALM]),
    ],
)
def test_summary_branches(spark, score, band, changes, anomalies, expected):
    row = narrative.case_summaries(scored(spark, score, band, **changes), anomalies).first()
    assert row.asDict() == {"customer_id": "N-17", "summary": " ".join(expected), "source": "stub", "model": "stub"}


def test_context_without_score(spark):
    row = narrative.case_context(from_records(spark, [CASE]), "text").first()
    assert row["intervention_score"] == 0.0 and row["risk_band"] == "Unknown"
    assert row["anomaly_summary"] == "text"


def test_context_of_nothing(spark):
    row = narrative.case_context(spark.range(1)).first().asDict()
    assert row == {
        "customer_id": "Unknown",
        "segment": "Unknown",
        "channel": "Unknown",
        "sentiment": "neutral",
        "engagement_score": 0.0,
        "complaint_flag": 0,
        "escalation_flag": 0,
        "days_since_contact": 0,
        "intervention_score": 0.0,
        "risk_band": "Unknown",
        "anomaly_summary": "",
    }


UNREADABLE = ["", "  ", "--", "1d", "1__0", "0x1F", "1e", "NaN", "½", "１"]


@pytest.mark.parametrize("text", UNREADABLE)
def test_text_that_is_no_number_counts_as_zero(spark, text):
    record = {"customer_id": "Q", "engagement_score": text, "complaint_flag": text, "days_since_last_contact": text}
    row = narrative.case_context(from_records(spark, [record], typed=False)).first()
    assert (row["engagement_score"], row["complaint_flag"], row["days_since_contact"]) == (0.0, 0, 0)


def test_numbers_written_as_text(spark):
    written = [("0.25", "1", "30"), (" 0.25 ", "1.0", "30.9"), ("25e-2", "+1", "3e1")]
    df = spark.createDataFrame(written, "engagement_score string, complaint_flag string, days_since_last_contact string")
    rows = {(r["engagement_score"], r["complaint_flag"], r["days_since_contact"]) for r in narrative.case_context(df).collect()}
    assert rows == {(0.25, 1, 30)}


def test_summaries_of_gaps(spark):
    """Every record gets its text, whatever is missing in it."""
    gaps = [{**CASE, "customer_id": f"G{i}", name: None} for i, name in enumerate(CASE) if name != "customer_id"]
    texts = narrative.case_summaries(from_records(spark, gaps, typed=False)).collect()
    assert {r["customer_id"] for r in texts} == {g["customer_id"] for g in gaps}
    assert all(r["summary"].endswith(CALM) for r in texts)


def test_empty_text_counts_as_missing(spark):
    row = narrative.case_context(from_records(spark, [{**CASE, "segment": "", "sentiment_text": ""}])).first()
    assert row["segment"] == "Unknown" and row["sentiment"] == "neutral"


def test_prompt(spark):
    row = narrative.case_prompts(scored(spark, 0.76, "High", complaint_flag=1), "⚠ FLAGGED x").first()
    assert row["user_prompt"] == (
        "Customer case summary request:\n\n"
        "Customer ID     : N-17\n"
        "Segment         : Standard\n"
        "Channel         : Email\n"
        "Sentiment       : mixed\n"
        "Engagement score: 0.31 / 1.00\n"
        "Complaint flag  : Yes\n"
        "Escalation flag : No\n"
        "Days since last contact: 52\n"
        "Model intervention score: 0.76 (risk: High)\n\n"
        "Anomaly context:\n⚠ FLAGGED x\n\n"
        "Write a 2-3 sentence next-best-action summary for this customer case."
    )
