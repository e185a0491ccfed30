from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from commlens.operators import anomaly
from commlens.schema import COMMUNICATIONS
from commlens.settings import Settings
from frames import END, case, dated, frame, never_opened, records


def status(df, detector, **settings):
    return anomaly.detector_status(df, detector, Settings(**settings)).first()


# --- weekly drop ---


def test_detects_a_real_drop(spark):
    rows = records(anomaly.segment_drop(dated(spark, rows_per_day=15, drop_segment="Premium"), 0.15))
    assert rows == [
        {
            "segment": "Premium",
            "current_week_avg": 0.1,
            "previous_week_avg": 0.65,
            "drop_pct": 0.8462,
            "drop_pct_label": "84.6%",
        }
    ]


def test_stable_segments_are_compared_but_not_flagged(spark):
    rows = records(anomaly.segment_weeks(dated(spark)))
    assert {r["segment"] for r in rows} == {"Premium", "Standard", "Basic"}
    assert not any(r["flagged"] for r in rows)
    row = status(dated(spark), anomaly.SEGMENT_DROP)
    assert row["summary"] == "No segment engagement drops above 15% detected across 3 segment(s)."
    assert row["n_flagged"] == 0 and row["flagged"] is False


def test_drop_threshold_is_strict_and_zero_is_kept(spark):
    df = dated(spark, rows_per_day=15, drop_segment="Basic")
    assert [r["segment"] for r in records(anomaly.segment_drop(df, 0.0))] == ["Basic"]
    assert records(anomaly.segment_drop(dated(spark), 0.0)) == []


def test_weeks_are_counted_from_the_last_day_on_file(spark):
    row = status(dated(spark, drop_segment="Premium"), anomaly.SEGMENT_DROP)
    assert row["metadata"] == {
        "threshold": "0.15",
        "segments_compared": "3",
        "current_week_start": str(END - timedelta(days=6)),
        "previous_week_start": str(END - timedelta(days=13)),
    }
    assert row["summary"] == (
        "1 segment(s) show engagement drops above 15%. Worst: Premium dropped 84.6% week-over-week."
    )


def test_segment_timestamps_count_as_days(spark):
    weeks = [("Basic", range(7), 0.2), ("Basic", range(7, 14), 0.8), ("Standard", range(14), 0.6)]
    rows = [(f"{END - timedelta(days=day)} 21:15:00", name, score) for name, days, score in weeks for day in days]
    df = spark.createDataFrame(rows, "sent_date string, segment string, engagement_score double")
    assert [(r["segment"], r["drop_pct"]) for r in records(anomaly.segment_drop(df, 0.1))] == [("Basic", 0.75)]


def test_zero_previous_mean_and_one_week_segments_are_not_compared(spark):
    df = frame(
        spark,
        case(segment="Basic", sent_date=END, engagement_score=0.5),
        case(segment="Basic", sent_date=END - timedelta(days=8), engagement_score=0.0),
        case(segment="Premium", sent_date=END, engagement_score=0.5),
        case(segment=None, sent_date=END, engagement_score=0.1),
        case(segment=None, sent_date=END - timedelta(days=8), engagement_score=0.9),
    )
    assert records(anomaly.segment_weeks(df)) == []


def test_worst_segment_on_a_tie_is_the_first(spark):
    low = dated(spark, drop_segment="Standard").withColumn(
        "engagement_score",
        F.when(
            (F.col("segment") != "Basic") & (F.col("sent_date") >= F.lit(END - timedelta(days=6))), 0.1
        ).otherwise(0.65),
    )
    row = status(low, anomaly.SEGMENT_DROP)
    assert "2 segment(s)" in row["summary"] and "Worst: Premium" in row["summary"]


# --- complaint spike ---


def test_detects_a_spike(spark):
    rows = records(anomaly.complaint_spike(dated(spark, spike_day=5), 2.0))
    assert rows == [
        {
            "date": END - timedelta(days=14),
            "complaints": 10,
            "total_sent": 10,
            "complaint_rate": 1.0,
            "zscore": 4.2485,
        }
    ]


def test_uniform_and_short_series(spark):
    uniform = status(dated(spark), anomaly.COMPLAINT_SPIKE)
    assert uniform["summary"] == "Complaint counts are uniform — no spike detection possible."
    assert uniform["metadata"] == {"threshold": "2.0", "mean": "0.0"}
    short = status(dated(spark, n_days=2, spike_day=0), anomaly.COMPLAINT_SPIKE)
    assert short["summary"] == "Insufficient data for complaint spike detection (need >= 3 days)."
    assert short["metadata"] == {"threshold": "2.0"} and short["flagged"] is False


def test_no_spike_text(spark):
    df = dated(spark, spike_day=5)
    row = status(df, anomaly.COMPLAINT_SPIKE, complaint_zscore_threshold=5.0)
    assert row["summary"] == "No complaint spikes above z-score 5.0 detected. Daily average: 0.5 complaints."
    assert row["metadata"]["days_analysed"] == "20"


def test_zero_zscore_threshold_is_kept(spark):
    assert len(records(anomaly.complaint_spike(dated(spark, spike_day=5), 0.0))) == 1


def test_times_of_one_day_merge(spark):
    times = [("2024-03-05 00:10:00", 1), ("2024-03-05 23:50:00", 1), ("2024-03-05 12:00:00", 1)]
    quiet = [(f"2024-03-0{day} 06:45:00", 0) for day in (6, 7, 8)]
    df = spark.createDataFrame(times + quiet, "sent_date string, complaint_flag int")
    rows = records(anomaly.complaint_spike(df, 0.5))
    # counts 3, 0, 0, 0: mean 0.75, deviation 1.5
    assert [(r["date"], r["complaints"], r["zscore"]) for r in rows] == [(date(2024, 3, 5), 3, 1.5)]


def test_missing_complaint_flags_count_as_sent(spark):
    df = spark.createDataFrame(
        [(d, f) for d in ("2026-01-01", "2026-01-02", "2026-01-03") for f in (None, 0, None)] + [("2026-01-03", 1)],
        "sent_date string, complaint_flag int",
    )
    rows = {r["date"].day: r for r in anomaly.complaint_days(df).collect()}
    assert rows[1]["complaints"] == 0 and rows[1]["total_sent"] == 3
    assert rows[3]["complaint_rate"] == 0.25


def test_spikes_are_sorted_by_rounded_zscore_then_date(spark):
    df = dated(spark, n_days=30).withColumn(
        "complaint_flag", F.col("sent_date").isin(END, END - timedelta(days=9)).cast("int")
    )
    rows = records(anomaly.complaint_spike(df, 1.0))
    assert [r["date"] for r in rows] == [END - timedelta(days=9), END]
    assert len(records(anomaly.top_spikes(df, 1))) == 1


# --- campaigns ---


def test_detects_a_bad_campaign(spark):
    df = never_opened(dated(spark, rows_per_day=30), "CAMP_001")
    rows = records(anomaly.campaign_underperformance(df, 0.5))
    assert [(r["campaign_id"], r["open_rate"], r["open_rate_label"]) for r in rows] == [("CAMP_001", 0.0, "0.0%")]
    assert rows[0]["median_open_rate"] == 1.0 and rows[0]["total_sent"] == 200
    text = status(df, anomaly.CAMPAIGN)["summary"]
    assert text == (
        "1 campaign(s) underperforming. Median open rate: 100.0%. Worst: CAMP_001 at 0.0% (0% of median)."
    )


def test_ratio_zero_never_flags(spark):
    df = never_opened(dated(spark), "CAMP_001")
    assert records(anomaly.campaign_underperformance(df, 0.0)) == []
    row = status(df, anomaly.CAMPAIGN, campaign_open_rate_ratio=0.0)
    assert row["summary"] == "All 3 campaigns performing above 0% of median open rate (100.0%)."


CAMPAIGN_SCHEMA = "campaign_id string, opened int, complaint_flag int, engagement_score double"


def test_null_opened_is_left_out_of_both_sides(spark):
    flags = {"FULL": (0, 1, 0, 0, 0), "PART": (None, 1, 0, None, 1, 1)}
    df = spark.createDataFrame([(name, o, 0, 0.4) for name, opened in flags.items() for o in opened], CAMPAIGN_SCHEMA)
    rates = {r["campaign_id"]: (r["open_rate"], r["total_sent"]) for r in anomaly.campaign_scorecard(df).collect()}
    assert rates == {"FULL": (0.2, 5), "PART": (0.75, 4)}


def test_campaign_without_any_known_opened(spark):
    unknown = [("BLANK", None, None, 0.4)] * 2
    known = [("SIXTH", int(i == 0), 0, 0.4) for i in range(6)]
    df = spark.createDataFrame(unknown + known + [(None, 1, 0, 0.0)], CAMPAIGN_SCHEMA)
    rows = {r["campaign_id"]: r for r in anomaly.campaign_scorecard(df).collect()}
    assert set(rows) == {"BLANK", "SIXTH"}
    assert rows["BLANK"]["open_rate"] == 0.0 and rows["BLANK"]["complaint_count"] == 0
    # the median of 0 and the rounded 0.1667, the empty campaign included
    assert abs(rows["SIXTH"]["median_open_rate"] - 0.08335) < 1e-4


def test_ties_are_ordered_by_campaign(spark):
    df = never_opened(never_opened(dated(spark, rows_per_day=30), "CAMP_003"), "CAMP_002").unionByName(
        frame(spark, *[case(campaign_id=f"CAMP_1{i:02d}", sent_date=END) for i in range(5)])
    )
    assert [r["campaign_id"] for r in records(anomaly.campaign_underperformance(df))] == ["CAMP_002", "CAMP_003"]


# --- all detectors ---


def test_all_detectors(spark, cases):
    rows = records(anomaly.detector_status(cases))
    assert [r["detector"] for r in rows] == anomaly.DETECTORS
    text = anomaly.anomaly_text(anomaly.detector_status(cases)).first()["anomaly_text"].split("\n")
    assert [line.split(":")[0] for line in text] == [f"  [⚠ FLAGGED] {d}" for d in anomaly.DETECTORS]
    assert anomaly.detector_rollup(anomaly.detector_status(cases)).first().asDict() == {
        "any_flagged": True,
        "total_flagged": 3,
    }


@pytest.mark.parametrize("detector", anomaly.DETECTORS)
def test_one_detector_agrees_with_all(spark, cases, detector):
    alone = records(anomaly.detector_status(cases, detector))
    assert alone == [r for r in records(anomaly.detector_status(cases)) if r["detector"] == detector]


def test_status_lists_what_it_counts(spark):
    df = never_opened(dated(spark, rows_per_day=15, drop_segment="Premium", spike_day=5), "CAMP_002")
    status = {r["detector"]: r for r in records(anomaly.detector_status(df))}
    items = sorted(records(anomaly.detector_items(df)), key=lambda r: r["position"])
    for detector, row in status.items():
        assert row["anomalies"] == [r["fields"] for r in items if r["detector"] == detector]
        assert len(row["anomalies"]) == row["n_flagged"] > 0
    assert status[anomaly.SEGMENT_DROP]["segments"] == ["Basic", "Premium", "Standard"]
    assert status[anomaly.CAMPAIGN]["segments"] is None


def test_detector_selection():
    assert anomaly.selected(None) == anomaly.selected("all") == anomaly.DETECTORS
    with pytest.raises(ValueError, match="not_a_real_detector"):
        anomaly.selected("not_a_real_detector")


def test_rows_and_rollup_give_the_same_figures(cases):
    rows = records(anomaly._campaigns(anomaly.measure_rows(cases), 0.5).orderBy("campaign_id"))
    rolled = records(anomaly._campaigns(anomaly.rollup(cases), 0.5).orderBy("campaign_id"))
    assert rows == rolled


def test_empty_input_is_not_flagged(spark):
    rows = records(anomaly.detector_status(spark.createDataFrame([], COMMUNICATIONS)))
    assert [r["flagged"] for r in rows] == [False, False, False]
    assert all(r["n_flagged"] == 0 for r in rows)
    assert anomaly.detector_items(spark.createDataFrame([], COMMUNICATIONS)).collect() == []


def test_missing_keys_and_dates_are_left_out(spark):
    df = dated(spark, spike_day=5).unionByName(frame(spark, case(segment=None, campaign_id=None, sent_date=None)))
    assert len(records(anomaly.complaint_days(df))) == 20
    assert len(records(anomaly.campaign_scorecard(df))) == 3


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("A", 1.0, 0.0, 0.5), ("A", nan, nan, nan), ("B", 0.0, 1.0, nan)],
        "campaign_id string, opened double, complaint_flag double, engagement_score double",
    )
    rows = {r["campaign_id"]: r for r in anomaly.campaign_scorecard(df).collect()}
    assert (rows["A"]["total_sent"], rows["A"]["open_rate"], rows["A"]["avg_engagement"]) == (1, 1.0, 0.5)
    assert (rows["B"]["complaint_count"], rows["B"]["avg_engagement"]) == (1, None)


def test_rows_added_from_outside_are_seen(spark, tmp_path):
    import shutil

    from datetime import date

    folder, other = str(tmp_path / "table"), str(tmp_path / "other")
    frame(spark, *[case(customer_id=f"A{i}", sent_date=date(2022, 5, 1 + i % 20)) for i in range(40)]).write.parquet(folder)

    def week(df):
        rows = anomaly.detector_status(df).collect()
        return next(r["metadata"]["current_week_start"] for r in rows if "current_week_start" in r["metadata"])

    before = week(spark.read.parquet(folder))
    frame(spark, *[case(customer_id=f"B{i}", sent_date=date(2022, 9, 9)) for i in range(40)]).coalesce(1).write.parquet(other)
    for part in (tmp_path / "other").glob("part-*"):
        shutil.copy(part, tmp_path / "table" / f"late-{part.name}")
    spark.catalog.clearCache()
    assert week(spark.read.parquet(folder)) > before
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
