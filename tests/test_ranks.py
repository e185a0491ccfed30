"""Ranks without a global window: AUC by radix, cut points by radix selection, positions over range partitions."""

import hashlib
import math
import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from commlens.operators import anomaly, evaluation, splitting
from commlens.operators.ordering import with_position
from commlens.settings import Settings
from frames import case, frame


def jobs(spark, work):
    """How many jobs the driver starts while ``work`` runs."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        result = work()
        return len(tracker.getJobIdsForGroup(group)), result
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


SCORES = {
    "coarse": lambda rng: rng.randrange(5) / 4,
    "fine": lambda rng: rng.random(),
    "crowded": lambda rng: 0.5 + rng.randrange(300) * 2.0**-52,
    "outside": lambda rng: rng.gauss(0, 5),
    "tiny": lambda rng: rng.random() * 1e-300,
    "ends": lambda rng: rng.choice([0.0, 1.0, -0.0, 1.0 - 2.0**-53, float("inf"), float("-inf")]),
}


@pytest.mark.parametrize("kind", sorted(SCORES))
def test_auc_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    rows = [(SCORES[kind](rng), rng.choice([0, 1, 1])) for _ in range(400)]
    extra = [(None, 1), (0.3, None), (float("nan"), 0), (0.2, 7)]
    df = spark.createDataFrame(rows + extra, "score double, label int").repartition(5)
    negatives = sorted(s for s, y in rows if y == 0)
    positives = [s for s, y in rows if y == 1]
    won = sum(bisect_left(negatives, s) + bisect_right(negatives, s) for s in positives)
    found = evaluation.auc_counts(df, "score", "label").first()
    assert (found["positives"], found["negatives"]) == (len(positives), len(negatives))
    assert int(found["pairs"]) == won
    assert evaluation.roc_auc(df, "score", "label") == pytest.approx(won / 2 / len(positives) / len(negatives), rel=1e-14)


def test_auc_of_one_class_or_no_rows_is_missing(spark):
    for rows in ([(0.5, 1)], []):
        df = spark.createDataFrame(rows, "score double, label int")
        assert evaluation.roc_auc_frame(df, "score", "label").first()["roc_auc"] is None
        assert math.isnan(evaluation.roc_auc(df, "score", "label"))


def test_auc_starts_no_job_before_it_is_read(spark, cases):
    scored = cases.withColumn("score", F.lit(1.0) - F.col("engagement_score"))
    started, lazy = jobs(spark, lambda: evaluation.roc_auc_frame(scored, "score", "needs_intervention"))
    assert started == 0 and 0 < lazy.first()["roc_auc"] < 1


def expected_cuts(rows, settings):
    out = {}
    for label in {y for _, y in rows}:
        keys = sorted(hashlib.md5((i or "").encode()).hexdigest() for i, y in rows if y == label)
        test = math.ceil(settings.test_fraction * len(keys))
        rest = len(keys) - test
        ranks = [test, *(test + math.ceil(rest * f / settings.folds) for f in range(1, settings.folds))]
        out[label] = (len(keys), test, [keys[r - 1] for r in ranks])
    return out


@pytest.mark.parametrize("ranked", [1 << 16, 40, 1])
def test_cut_points_by_radix(spark, monkeypatch, ranked):
    monkeypatch.setattr(splitting, "RANKED_ROWS", ranked)
    monkeypatch.setattr(splitting, "DIGITS", 1)
    rng = random.Random(ranked)
    # crowded ids: all hashes of class 1 begin with the same digit, and one id is a third of all rows
    crowd = [i for i in (f"C{n}" for n in range(6000)) if hashlib.md5(i.encode()).hexdigest()[0] == "7"]
    rows = [(i, 1) for i in crowd] + [(f"D{rng.randrange(10**6)}", 0) for _ in range(500)] + [("HOT", 0)] * 300
    df = frame(spark, *[case(customer_id=i, needs_intervention=y) for i, y in rows]).repartition(4)
    settings = Settings()
    found = {r["label"]: (r["rows"], r["test_rows"], r["cuts"]) for r in splitting.cut_points(df, settings).collect()}
    assert found == expected_cuts(rows, settings)


def test_what_is_ranked_is_small(spark, monkeypatch):
    monkeypatch.setattr(splitting, "RANKED_ROWS", 20)
    monkeypatch.setattr(splitting, "DIGITS", 1)
    crowd = [i for i in (f"C{n}" for n in range(9000)) if hashlib.md5(i.encode()).hexdigest()[0] == "7"]
    df = frame(spark, *[case(customer_id=i, needs_intervention=int(i.endswith("3"))) for i in crowd])
    refine, sizes = splitting._refined, []

    def watched(keyed, cuts, digits):
        if digits > 1:
            sizes.extend(c.n for c in cuts)
        return refine(keyed, cuts, digits)

    monkeypatch.setattr(splitting, "_refined", watched)
    splitting.cut_points(df).collect()
    assert sizes and max(sizes) <= 20


def test_no_rows_have_no_cuts(spark):
    assert splitting.cut_points(frame(spark, case()).limit(0)).collect() == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice("aaab"), rng.randrange(40) / 4, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = with_position(df, "g", [F.col("x").desc(), F.col("i")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    expected = []
    for g in "ab":
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected += [(*r, n) for n, r in enumerate(ranked, 1)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_items_of_many_campaigns_are_rows(spark):
    """600 flagged campaigns of 1,300: nothing is one value or one task."""
    rows = [case(customer_id=f"C{c}-{k}", campaign_id=f"CAMP_{c:04d}", opened=int(c >= 600 or k == 0)) for c in range(1300) for k in range(4)]
    df = frame(spark, *rows)
    items = anomaly.detector_items(df, anomaly.CAMPAIGN).orderBy("position").collect()
    assert [r["position"] for r in items] == list(range(1, 601))
    assert [r["item"] for r in items] == [f"CAMP_{c:04d}" for c in range(600)]
    status = anomaly.detector_status(df, anomaly.CAMPAIGN).first()
    assert status["n_flagged"] == 600
