import pytest
from pyspark.sql import functions as F

from commlens.functions import business, rounding, text
from frames import case, frame


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, expected", [(0.03125, 0.0312), (0.00005, 0.0), (0.09375, 0.0938), (1.0, 1.0), (-0.03125, -0.0312)]
)
def test_rounding_is_half_even(spark, value, expected):
    assert one(spark, rounding.round_even(F.col("v")), v=("double", value)) == expected


def test_fixed_text_equals_printf(spark):
    values = [k / 10_000 for k in range(10_001)] + [2.675, 1.005, -0.125, 1e6 + 0.125, 19.43333]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(
        "v",
        rounding.fixed_text(F.col("v"), 2).alias("fixed"),
        rounding.percent_text(F.col("v")).alias("percent"),
        rounding.percent_text(F.col("v"), 0).alias("whole"),
    ).collect()
    assert len(rows) == len(values)
    for row in rows:
        assert (row["fixed"], row["percent"], row["whole"]) == (
            f"{row['v']:.2f}",
            f"{row['v']:.1%}",
            f"{row['v']:.0%}",
        )


FLAGS = ["opened", "clicked", "response_flag", "complaint_flag", "opt_out_flag"]


@pytest.mark.parametrize(
    "flags, expected",
    [
        ((1, 1, 1, 0, 0), 0.9),
        ((0, 0, 0, 1, 1), 0.0),
        ((1, 0, 0, 0, 1), 0.25),
        ((1, 0, 1, 1, 0), 0.45),
        ((1, None, 0, 0, 0), None),
    ],
)
def test_engagement_score(spark, flags, expected):
    df = spark.createDataFrame([flags], ", ".join(f"{f} int" for f in FLAGS))
    assert df.select(business.engagement_score().alias("x")).first()["x"] == expected


def test_bands_read_the_rounded_score(spark):
    # 0.35 - 0.10 and 0.35 + 0.25 - 0.15 are below their bounds before rounding
    df = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 1, 1, 0)], ", ".join(f"{f} int" for f in FLAGS))
    score = business.engagement_score()
    assert [r["x"] for r in df.select(business.sentiment_band(score).alias("x")).collect()] == ["mixed", "neutral"]


@pytest.mark.parametrize(
    "score, expected",
    [(0.70, "positive"), (0.6999, "neutral"), (0.45, "neutral"), (0.25, "mixed"), (0.2499, "negative"), (None, "negative")],
)
def test_sentiment_bounds(spark, score, expected):
    assert one(spark, business.sentiment_band(F.col("s")), s=("double", score)) == expected


@pytest.mark.parametrize(
    "probability, band, flag",
    [(0.80, "High", 1), (0.70, "High", 1), (0.69999, "Medium", 1), (0.45, "Medium", 1), (0.44999, "Low", 0)],
)
def test_risk_band_and_flag_use_the_unrounded_probability(spark, probability, band, flag):
    assert one(spark, business.risk_band(F.col("p")), p=("double", probability)) == band
    assert one(spark, business.threshold_flag(F.col("p")), p=("double", probability)) == flag


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, 0),
        ({"engagement_score": 0.2, "opened": 0, "days_since_last_contact": 44}, 1),
        ({"engagement_score": 0.2, "opened": 0, "days_since_last_contact": 45}, 0),
        ({"engagement_score": 0.25, "opened": 0, "days_since_last_contact": 10}, 0),
        ({"engagement_score": 0.2, "opened": 1, "days_since_last_contact": 10}, 0),
        ({"complaint_flag": 1}, 1),
        ({"escalation_flag": 1}, 1),
        ({"days_since_last_contact": 121, "response_flag": 0, "engagement_score": 0.4}, 1),
        ({"days_since_last_contact": 120, "response_flag": 0, "engagement_score": 0.4}, 0),
        ({"days_since_last_contact": 121, "response_flag": 0, "engagement_score": 0.5}, 0),
        ({"days_since_last_contact": 121, "response_flag": 0, "engagement_score": 0.4, "opt_out_flag": 1}, 0),
        ({"complaint_flag": None, "engagement_score": None}, 0),
        ({"complaint_flag": None, "escalation_flag": 1}, 1),
    ],
)
def test_intervention_rule(spark, changes, expected):
    row = frame(spark, case(**changes)).select(business.needs_intervention().alias("x")).first()
    assert row["x"] == expected


def test_id_label_never_cuts(spark):
    assert one(spark, business.id_label("CAMP", F.col("n"), 3), n=("bigint", 7)) == "CAMP_007"
    assert one(spark, business.id_label("CAMP", F.col("n"), 3), n=("bigint", 12345)) == "CAMP_12345"


@pytest.mark.parametrize(
    "value, as_double, as_int",
    [(None, 0.0, 0), ("NaN", 0.0, 0), ("bad", 0.0, 0), ("1.0", 1.0, 1), ("", 0.0, 0), ("-1.9", -1.9, -1), (" 2 ", 2.0, 2), ("1d", 0.0, 0), ("2.5f", 0.0, 0), ("1_000", 1000.0, 1000)],
)
def test_lenient_numbers(spark, value, as_double, as_int):
    assert one(spark, text.lenient_double(F.col("v")), v=("string", value)) == as_double
    assert one(spark, text.lenient_int(F.col("v")), v=("string", value)) == as_int


def test_strip_removes_all_python_whitespace(spark):
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert one(spark, text.strip(F.col("v")), v=("string", " \t Direct Mail \n")) == "Direct Mail"


def test_every_combination_of_flags(spark):
    """Score, sentiment and rule over all flag values and the days around each bound, against plain Python."""
    from itertools import product

    import numpy as np

    days = [0, 29, 44, 45, 120, 121, 180]
    rows = [
        case(
            customer_id=f"C{i}",
            opened=o,
            clicked=c,
            response_flag=r,
            complaint_flag=p,
            escalation_flag=e,
            opt_out_flag=u,
            days_since_last_contact=d,
        )
        for i, (o, c, r, p, e, u, d) in enumerate(product(*[(0, 1)] * 6, days))
    ]
    df = (
        frame(spark, *rows)
        .withColumn("engagement_score", business.engagement_score())
        .withColumn("sentiment_text", business.sentiment_band(F.col("engagement_score")))
        .withColumn("needs_intervention", business.needs_intervention())
    )
    found = df.collect()
    assert len(found) == 64 * len(days)
    for x in found:
        raw = 0.35 * x.opened + 0.30 * x.clicked + 0.25 * x.response_flag
        raw += -0.15 * x.complaint_flag - 0.10 * x.opt_out_flag
        score = float(np.round(min(max(raw, 0.0), 1.0), 4))
        silent = x.response_flag == 0 and x.opt_out_flag == 0
        rule = (
            (score < 0.25 and not x.opened and x.days_since_last_contact < 45)
            or x.complaint_flag
            or x.escalation_flag
            or (x.days_since_last_contact > 120 and silent and score < 0.5)
        )
        sentiment = next((s for b, s in ((0.7, "positive"), (0.45, "neutral"), (0.25, "mixed")) if score >= b), "negative")
        assert (x.engagement_score, x.sentiment_text, x.needs_intervention) == (score, sentiment, int(bool(rule)))
