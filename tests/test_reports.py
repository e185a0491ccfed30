from datetime import date

from pyspark.sql import functions as F

from commlens.operators import anomaly, reports
from commlens.schema import COMMUNICATIONS
from frames import case, frame, records


def test_histogram(spark, cases):
    rows = records(reports.engagement_histogram(cases).orderBy("bin"))
    assert len(rows) == 40 and sum(r["n"] for r in rows) == cases.count()
    edges = frame(spark, case(engagement_score=0.0), case(engagement_score=1.0), case(engagement_score=None))
    counts = {r["bin"]: r["n"] for r in records(reports.engagement_histogram(edges))}
    assert counts[0] == 1 and counts[39] == 1 and sum(counts.values()) == 2


def test_groups_skip_missing_keys_and_values(spark):
    df = frame(
        spark,
        case(customer_id=None, segment=None, channel="SMS", sentiment_text=None, needs_intervention=1),
        case(segment="Basic", channel="SMS", needs_intervention=None),
        case(segment="Basic", channel=None, needs_intervention=1),
    )
    assert records(reports.segment_rate(df)) == [{"segment": "Basic", "intervention_rate": 1.0}]
    assert records(reports.channel_breakdown(df)) == [{"channel": "SMS", "total": 1, "intervention": 1.0}]
    assert records(reports.sentiment_mix(df)) == [{"sentiment_text": "positive", "n": 2}]


def test_daily_series_is_lenient_and_counts_known_flags(spark):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", 1), ("2024-01-01", None), ("2024-01-02", None), ("bad", 1)],
        "sent_date string, complaint_flag int",
    )
    rows = {r["date"]: r for r in records(reports.daily_complaints(df))}
    assert set(rows) == {date(2024, 1, 1), date(2024, 1, 2)}
    assert rows[date(2024, 1, 1)]["total"] == 1 and rows[date(2024, 1, 1)]["rate"] == 1.0
    assert rows[date(2024, 1, 2)] == {"date": date(2024, 1, 2), "complaints": 0, "total": 0, "rate": None}


def test_heatmap_keeps_absent_segments_as_columns(spark):
    df = frame(spark, case(campaign_id="A", segment="Basic"), case(campaign_id=None))
    assert records(reports.open_rate_heatmap(df)) == [
        {"campaign_id": "A", "Basic": 1.0, "Premium": None, "Standard": None}
    ]


def test_case_filters(cases):
    assert reports.filter_cases(cases, [], ["Email"]).count() == 0
    both = reports.filter_cases(cases, ["Premium"], ["Email"]).count()
    split = [reports.filter_cases(cases, ["Premium"], ["Email"], k).count() for k in (0, 1)]
    assert both == sum(split) and min(split) > 0


def test_lists_and_lookup(cases):
    listed = records(reports.case_list(cases))
    assert len(listed) == 200 and listed == sorted(listed, key=lambda r: r["customer_id"])
    candidate = records(reports.candidate_cases(cases, 1))[0]["customer_id"]
    card = reports.case_card(reports.case_lookup(cases, candidate)).first()
    assert card["customer_id"] == candidate and card["complaint"] in ("Yes", "No")
    assert records(reports.case_lookup(cases, "nobody")) == []


def test_kpis_of_nothing(spark):
    row = reports.kpis(spark.createDataFrame([], COMMUNICATIONS)).first()
    assert row["total_records"] == 0 and row["avg_engagement"] is None


def test_flagged_campaigns_are_part_of_the_scorecard(cases):
    scorecard = anomaly.campaign_scorecard(cases)
    flagged = anomaly.campaign_underperformance(cases)
    assert flagged.count() == scorecard.where("flagged").count()
    assert flagged.exceptAll(scorecard.select(flagged.columns)).count() == 0


def test_distinct_values(cases):
    rows = records(reports.distinct_values(cases))
    assert [r["value"] for r in rows if r["column_name"] == "segment"] == ["Basic", "Premium", "Standard"]
    assert F  # the frame is ordered by column, then value
