from datetime import date

import pytest
from pyspark.sql import functions as F

from commlens.operators import admission, cleaning, quality
from commlens.sources.files import nan_to_null
from frames import case, frame, records


def healthy(spark, n=120):
    return frame(spark, *[case(customer_id=f"C{i:04d}", needs_intervention=int(i % 3 == 0)) for i in range(n)])


def with_bad(spark, **values):
    return healthy(spark).unionByName(frame(spark, case(customer_id="BAD", **values)))


def test_clean_data_passes(spark):
    report = quality.validate(healthy(spark))
    assert report.passed and report.errors == [] and report.warnings == []
    assert report.stats["row_count"] == 120 and report.stats["column_count"] == 18
    assert report.stats["intervention_rate"] == 0.3333
    assert "PASSED" in report.summary()


def test_missing_column_stops_the_rest(spark):
    df = healthy(spark).drop("needs_intervention").withColumn("opened", F.lit(99))
    report = quality.validate(df)
    assert report.errors == ["Missing required columns: ['needs_intervention']"]
    rows = records(quality.report(df))
    assert len(rows) == 1 and rows[0]["check_name"] == "required_columns"


def test_bad_binary_value(spark):
    df = with_bad(spark, complaint_flag=99)
    report = quality.validate(df)
    assert report.errors == ["Column 'complaint_flag' contains non-binary values: 1 rows"]
    assert records(quality.non_binary_values(df)) == [
        {"column_name": "complaint_flag", "value": "99", "failures": 1}
    ]


def test_null_flag_is_a_warning_and_an_error(spark):
    report = quality.validate(with_bad(spark, opened=None))
    assert report.errors == ["Column 'opened' contains non-binary values: 1 rows"]
    assert report.warnings == ["Nulls in 'opened': 1 rows"]


@pytest.mark.parametrize("column", ["customer_id", "segment", "engagement_score", "needs_intervention"])
def test_null_in_critical_column_is_an_error(spark, column):
    values = {"customer_id": None} if column == "customer_id" else {column: None}
    df = healthy(spark).unionByName(frame(spark, case(**values)))
    assert f"Nulls in critical column '{column}': 1 rows" in quality.validate(df).errors


@pytest.mark.parametrize("score", [1.5, -0.1])
def test_score_out_of_range(spark, score):
    assert quality.validate(with_bad(spark, engagement_score=score)).errors == [
        "engagement_score out of [0,1] range: 1 rows"
    ]


def test_nan_is_missing_not_out_of_range(spark):
    report = quality.validate(with_bad(spark, engagement_score=float("nan")))
    assert report.errors == ["Nulls in critical column 'engagement_score': 1 rows"]
    assert report.stats["engagement_mean"] == 0.9


def test_padded_value_is_unexpected(spark):
    df = with_bad(spark, segment=" Premium")
    assert quality.validate(df).errors == ["Column 'segment' has unexpected values: 1 rows"]
    assert records(quality.unexpected_values(df))[0]["value"] == " Premium"


def test_ranges_warn(spark):
    report = quality.validate(with_bad(spark, tenure_months=0, days_since_last_contact=366))
    assert report.passed
    assert report.warnings == [
        "Column 'tenure_months' has 1 values outside [1, 120]",
        "Column 'days_since_last_contact' has 1 values outside [0, 365]",
    ]


def test_small_and_one_sided_data_warn(spark):
    few = healthy(spark, 9)
    assert "Dataset has only 9 rows (expected >= 100)" in quality.validate(few).warnings
    none = healthy(spark).withColumn("needs_intervention", F.lit(0))
    assert quality.validate(none).warnings == ["Intervention rate very low: 0.0% — model may struggle"]
    every = healthy(spark).withColumn("needs_intervention", F.lit(1))
    assert quality.validate(every).warnings == ["Intervention rate very high: 100.0% — check target definition"]


def test_report_agrees_with_validate(spark):
    df = with_bad(spark, opened=None, segment="Gold", engagement_score=1.5, tenure_months=500)
    rows = quality.report(df).orderBy("position").collect()
    report = quality.validate(df)
    assert [r["detail"] for r in rows if r["severity"] == "error"] == report.errors
    assert [r["detail"] for r in rows if r["severity"] == "warning"] == report.warnings


def test_all_checks_share_one_scan(spark, small):
    from commlens.sources.feeds import raw_feed

    plan = quality.report(raw_feed(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1


def test_cleaning(spark):
    df = frame(
        spark,
        case(customer_id=" A ", segment="Premium ", sent_date=date(2024, 1, 2), channel="\tSMS"),
        case(customer_id="A", segment="Basic", sent_date=date(2024, 1, 1)),
        case(customer_id="B"),
    ).withColumn("sent_date", F.concat(F.col("sent_date").cast("string"), F.lit(" 09:00:00")))
    rows = {r["customer_id"]: r for r in cleaning.clean(df).collect()}
    assert set(rows) == {"A", "B"}
    assert rows["A"]["segment"] == "Basic" and rows["A"]["sent_date"] == date(2024, 1, 1)
    assert df.count() == 3


def test_duplicates_do_not_depend_on_the_layout(spark, small):
    from commlens.sources.feeds import raw_feed

    feed = raw_feed(spark, small)
    one = cleaning.clean(feed)
    other = cleaning.clean(feed.repartition(7, "days_since_last_contact"))
    assert one.exceptAll(other).count() == 0 and one.count() == other.count()


def test_bad_date_raises_when_strict_and_is_null_when_lenient(spark):
    df = spark.createDataFrame([("2024-01-01",), ("nope",)], "sent_date string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.normalise_rows(df).collect()
    assert [r[0] for r in df.select(cleaning.lenient_date(F.col("sent_date"))).collect()] == [date(2024, 1, 1), None]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert cleaning.add_missing(df, {"b": "x", "c": "y"}).first().asDict() == {"a": 1, "b": None, "c": "y"}
    assert cleaning.align(df, ["z", "a"]).first().asDict() == {"z": 0, "a": 1}
    assert cleaning.drop_present(df, ["b", "nothing"]).columns == ["a"]
    assert quality.non_numeric(df, ["a", "b"]) == ["b"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, t string")
    assert [r["v"] for r in nan_to_null(df).orderBy("t").collect()] == [None, 1.0]


def test_admission(spark):
    good, bad = admission.split(
        frame(
            spark,
            case(customer_id="OK"),
            case(customer_id="HIGH", engagement_score=1.5),
            case(customer_id="MANY", opened=2, tenure_months=0, days_since_last_contact=-1),
            case(customer_id=None, opened=None),
        ).drop("premium_bucket")
    )
    rows = {r["customer_id"]: r for r in good.collect()}
    assert set(rows) == {"OK", "UNKNOWN"}
    assert rows["UNKNOWN"]["opened"] == 0 and rows["OK"]["premium_bucket"] == "Mid"
    reasons = {r["customer_id"]: r["reasons"] for r in bad.collect()}
    assert reasons["HIGH"] == ["engagement_score: above 1"]
    assert reasons["MANY"] == ["opened: above 1", "tenure_months: below 1", "days_since_last_contact: below 0"]


def test_admission_of_text_fields(spark):
    df = spark.createDataFrame(
        [("A", "1", "2024-05-06"), ("B", "0.5", "2024-05-06"), ("C", "x", "soon")],
        "customer_id string, opened string, sent_date string",
    )
    rows = {r["customer_id"]: r for r in admission.admit(df).collect()}
    assert rows["A"]["opened"] == 1 and rows["A"]["reasons"] == [] and rows["A"]["sent_date"] == date(2024, 5, 6)
    assert rows["B"]["reasons"] == ["opened: not an integer"]
    assert rows["C"]["reasons"] == ["opened: not an integer", "sent_date: not a date"]


@pytest.mark.parametrize(
    "opened, day, good",
    [
        ("1", "2023-02-11", True), (" 1 ", "2023-02-11T00:00:00", True), ("1.0", "2023-02-11 00:00", True),
        ("1e0", "2023-02-11", False), ("1d", "2023-02-11", False), ("1", "2023-02-11Tjunk", False), ("1", "2023", False),
        ("1", "2023-02", False), ("1", " 2023-2-11 ", False), ("1", "2023-02-11 09:30:00", False), ("1", "2023-02-30", False),
    ],
)
def test_admission_reads_strictly(spark, opened, day, good):
    df = spark.createDataFrame([(opened, day)], "opened string, sent_date string")
    assert (admission.admit(df).first()["reasons"] == []) == good


def test_empty_table(spark):
    from commlens.schema import COMMUNICATIONS

    empty = spark.createDataFrame([], COMMUNICATIONS)
    report = quality.validate(empty)
    assert report.passed and report.warnings == ["Dataset has only 0 rows (expected >= 100)"]
    assert report.stats["row_count"] == 0 and report.stats["engagement_mean"] is None
    assert cleaning.clean(empty).count() == 0
    assert admission.admit(empty).count() == 0


def test_extra_columns_are_counted(spark):
    df = healthy(spark).withColumn("notes", F.lit(None).cast("array<string>"))
    report = quality.validate(df)
    assert report.passed and report.stats["column_count"] == 19 and report.stats["null_total"] == 120
