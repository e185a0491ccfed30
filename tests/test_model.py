from dataclasses import replace
from threading import Lock

import pytest
from pyspark.sql import functions as F

from commlens.operators import evaluation, features, scoring, splitting, training
from commlens.settings import Settings
from commlens.sources.files import from_records
from frames import COMPLAINT, RISKY, SAFE, case, frame, records


# --- features ---


def test_feature_names(cases):
    names = features.get_feature_names(cases)
    assert len(names) == 26
    assert names[:9] == features.PASSTHROUGH and names[9:13] == features.INTERACTIONS
    assert names[13:] == [
        "segment_Premium",
        "segment_Standard",
        "product_type_Health",
        "product_type_Home",
        "product_type_Life",
        "channel_Email",
        "channel_Phone",
        "channel_SMS",
        "premium_bucket_Low",
        "premium_bucket_Mid",
        "sentiment_text_negative",
        "sentiment_text_neutral",
        "sentiment_text_positive",
    ]


def test_feature_frame(cases):
    built = features.build_features(cases)
    assert built.count() == cases.count()
    assert not set(features.CATEGORICALS) & set(built.columns)
    nulls = built.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in built.columns]).first()
    assert sum(nulls) == 0


def test_interactions(spark):
    row = features.add_interactions(
        frame(
            spark,
            case(days_since_last_contact=29, response_flag=0, engagement_score=0.3, tenure_months=24),
        )
    ).first()
    assert (row["contact_but_no_response"], row["high_risk_combo"], row["low_engagement_long_silence"]) == (1, 0, 0)
    assert row["engagement_x_tenure"] == 0.9657
    missing = features.add_interactions(
        frame(spark, case(days_since_last_contact=None, engagement_score=None, complaint_flag=None))
    ).first()
    assert (missing["contact_but_no_response"], missing["high_risk_combo"]) == (0, 0)
    assert missing["engagement_x_tenure"] is None and missing["low_engagement_long_silence"] == 0


def test_unseen_and_missing_levels_are_all_zero(spark):
    encoded = features.one_hot(frame(spark, case(segment="Gold"), case(segment=None)), features.DECLARED_LEVELS)
    for row in encoded.collect():
        assert row["segment_Premium"] == 0 and row["segment_Standard"] == 0


def test_non_numeric_feature_raises(spark):
    df = frame(spark, case()).withColumn("opened", F.lit("yes"))
    with pytest.raises(ValueError, match="opened"):
        features.build_features(df, features.DECLARED_LEVELS)


def test_undeclared_levels_raise(spark):
    df = frame(spark, case(), case(segment="Bronze"))
    with pytest.raises(ValueError, match="segment"):
        features.fit_levels(df)


# --- split ---


def brute_slots(ids, labels, fraction=0.2, folds=5):
    from hashlib import md5
    from math import ceil

    slots = {}
    for label in set(labels):
        ordered = sorted((i for i, y in zip(ids, labels) if y == label), key=lambda i: md5(i.encode()).hexdigest())
        n, test = len(ordered), ceil(fraction * len(ordered))
        ends = [test] + [test + ceil((n - test) * f / folds) for f in range(1, folds)]
        for rank, identifier in enumerate(ordered, start=1):
            slots[identifier] = sum(rank > end for end in ends)
    return slots


@pytest.mark.parametrize("n", [2, 3, 7, 50, 1000])
def test_split_equals_ranking(spark, n):
    ids = [f"C{i}" for i in range(n)]
    labels = [int(i % 3 == 0) for i in range(n)]
    df = frame(spark, *[case(customer_id=i, needs_intervention=y) for i, y in zip(ids, labels)])
    split = splitting.stratified_split(df)
    assert {r["customer_id"]: r["slot"] for r in split.collect()} == brute_slots(ids, labels)


def test_split_keeps_every_labelled_row_once(spark, cases):
    extra = cases.limit(3).withColumn("needs_intervention", F.lit(None).cast("int"))
    split = splitting.stratified_split(cases.unionByName(extra))
    assert split.count() == cases.count()
    rates = {r["part"]: r["r"] for r in split.groupBy("part").agg(F.avg("needs_intervention").alias("r")).collect()}
    assert abs(rates["test"] - rates["train"]) < 0.001


# --- evaluation ---


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [(0, 0, 0.1), (0, 0, 0.4), (0, 1, 0.4), (1, 1, 0.4), (1, 1, 0.8), (1, 0, 0.2)],
        "label int, predicted int, score double",
    )
    # pairs won: 0.4 beats 0.1 (and ties twice), 0.8 beats three, 0.2 beats 0.1
    assert evaluation.roc_auc(df, "score", "label") == pytest.approx((1 + 0.5 + 0.5 + 3 + 1) / 9)
    assert evaluation.confusion_matrix(df, "predicted", "label").first().asDict() == {
        "true_negatives": 2,
        "false_positives": 1,
        "false_negatives": 1,
        "true_positives": 2,
    }
    rows = {r["label"]: r for r in evaluation.classification_report(df, "predicted", "label").collect()}
    assert rows[1]["precision"] == rows[1]["recall"] == rows[1]["f1"] == 0.6667
    assert rows[0]["support"] == 3 and rows[0]["accuracy"] == 0.6667


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "label int, predicted int")
    rows = {r["label"]: r for r in evaluation.classification_report(df, "predicted", "label").collect()}
    assert rows[1]["precision"] == rows[1]["recall"] == rows[1]["f1"] == 0.0
    assert rows[0]["precision"] == 0.0 and rows[0]["recall"] == 0.0


def test_class_weights_balance(cases):
    rows = records(splitting.class_weights(cases))
    assert sum(r["rows"] * r["weight"] for r in rows) == pytest.approx(10_000)
    assert rows[0]["rows"] * rows[0]["weight"] == pytest.approx(rows[1]["rows"] * rows[1]["weight"])


# --- training ---


def test_training_metrics_and_artifact(spark, cases, tmp_path):
    path = str(tmp_path / "forest")
    settings = Settings(trees=20)
    result = training.train(cases, path, settings, parallelism=5)
    assert result.metrics["roc_auc"] > 0.95 and result.metrics["cv_auc_mean"] > 0.95
    assert result.metrics["cv_auc_std"] < 0.05 and result.metrics["threshold"] == 0.45
    loaded = scoring.load_forest(spark, path)
    assert loaded.feature_names == result.forest.feature_names and loaded.levels == result.forest.levels
    first = scoring.score_batch(cases, result.forest).select("customer_id", "intervention_score")
    second = scoring.score_batch(cases, path=path).select("customer_id", "intervention_score")
    assert first.exceptAll(second).count() == 0


def test_the_forest_does_not_depend_on_the_layout(cases):
    settings = Settings(trees=5, depth=4)
    one = training.fit_forest(training.prepare(cases, settings), settings)
    other = training.fit_forest(training.prepare(cases.repartition(7), settings), settings)
    assert one.trees.toDebugString.split("\n", 1)[1] == other.trees.toDebugString.split("\n", 1)[1]


def test_folds_fitted_at_once_fit_in_memory_together(cases, monkeypatch):
    settings = Settings(trees=3, depth=3)
    training_set, fit = training.prepare(cases, settings), training.fit
    lock, running, peaks = Lock(), [0], []

    def counted(rows, settings):
        with lock:
            running[0] += 1
            peaks[-1] = max(peaks[-1], running[0])
        try:
            return fit(rows, settings)
        finally:
            with lock:
                running[0] -= 1

    def areas(at_once):
        peaks.append(0)
        return training.cross_validate(training_set, settings.override(rows_fitted_at_once=at_once), parallelism=5)

    monkeypatch.setattr(training, "fit", counted)
    # a fit reads four fifths of the 8,000 training rows
    one, five = areas(6_399), areas(32_000)
    assert peaks[0] == 1 and len(one) == 5 and one == five


def test_fits_at_once_follow_the_rows(cases):
    small = training.prepare(cases)
    # the session has 8 cores and a fit at least 8 tasks
    assert training.fits_at_once(small, parallelism=5) == 5 and training.fits_at_once(small) == 1
    gb, six_gb = replace(small, train_rows=4_800_000), replace(small, train_rows=28_800_000)
    assert training.fits_at_once(gb, parallelism=5) == 3 and training.fits_at_once(six_gb, parallelism=5) == 1
    # with fewer tasks than cores, idle cores take another fit
    few = Settings(min_fit_partitions=2, rows_fitted_at_once=1)
    assert training.fits_at_once(small, few, parallelism=5) == 4


def test_one_class_cannot_be_trained(spark):
    df = frame(spark, *[case(customer_id=f"C{i}") for i in range(10)])
    with pytest.raises(ValueError, match="both classes"):
        training.prepare(df)


def test_unlabelled_rows_cannot_be_trained(cases):
    with pytest.raises(ValueError, match="without a label"):
        training.prepare(cases.withColumn("needs_intervention", F.expr("nullif(needs_intervention, 1)")))


def test_importances(cases, forest):
    top = records(training.top_features(forest, cases))
    values = [r["importance"] for r in top]
    assert len(top) == 10 and values == sorted(values, reverse=True)


# --- scoring ---


def test_score_batch_keeps_rows_and_columns(cases, forest):
    scored = scoring.score_batch(cases, forest)
    assert scored.columns == [*cases.columns, "intervention_score", "predicted_intervention", "risk_band"]
    assert scored.count() == cases.count()
    bad = scored.where(
        ~F.col("intervention_score").between(0, 1) | ~F.col("risk_band").isin("Low", "Medium", "High")
    )
    assert bad.count() == 0
    unlabelled = scoring.score_batch(cases.drop("needs_intervention"), forest)
    assert "needs_intervention" not in unlabelled.columns
    assert unlabelled.drop("risk_band").exceptAll(scored.select(unlabelled.drop("risk_band").columns)).count() == 0


def test_risky_scores_high_and_safe_scores_low(spark, forest):
    risky = scoring.score_customer(spark, RISKY, forest)
    safe = scoring.score_customer(spark, SAFE, forest)
    assert risky.intervention_score > 0.5 and risky.needs_intervention == 1
    assert safe.intervention_score < 0.5 and safe.needs_intervention == 0
    assert scoring.score_customer(spark, COMPLAINT, forest).customer_id == "CASE_COMPLAINT"


def test_partial_records_get_defaults(spark, forest):
    partial = {k: v for k, v in COMPLAINT.items() if k not in ("premium_bucket", "sentiment_text", "campaign_id")}
    full = {**partial, "premium_bucket": "Mid", "sentiment_text": "neutral"}
    assert scoring.score_customer(spark, partial, forest) == scoring.score_customer(spark, full, forest)
    nameless = {k: v for k, v in partial.items() if k not in ("customer_id", "sent_date")}
    assert scoring.score_customer(spark, nameless, forest).customer_id == "UNKNOWN"


def test_single_segment_batch_is_not_zeroed(cases, forest):
    whole = scoring.score_batch(cases, forest).where(F.col("segment") == "Premium")
    alone = scoring.score_batch(cases.where(F.col("segment") == "Premium"), forest)
    assert whole.exceptAll(alone).count() == 0


def test_missing_numbers_still_score(spark, forest):
    scored = scoring.score_batch(frame(spark, case(engagement_score=None, tenure_months=None)), forest).first()
    assert 0 <= scored["intervention_score"] <= 1


def test_feature_name_resolution(spark, cases, forest, tmp_path):
    assert scoring.resolve_feature_names(spark, forest, None, ["a"]) == ["a"]
    assert scoring.resolve_feature_names(spark, forest, None, None) == forest.feature_names
    with pytest.raises(RuntimeError, match="Cannot resolve"):
        scoring.resolve_feature_names(spark, None, str(tmp_path / "nothing"), None)
    with pytest.raises(FileNotFoundError):
        scoring.load_forest(spark, str(tmp_path / "nothing"))
    fallback = scoring.score_or_unknown(cases, str(tmp_path / "nothing")).first()
    assert (fallback["intervention_score"], fallback["risk_band"]) == (0.0, "Unknown")


def test_records_frame(spark):
    df = from_records(spark, [COMPLAINT, {"customer_id": "X", "engagement_score": float("nan")}])
    rows = {r["customer_id"]: r for r in df.collect()}
    assert rows["X"]["engagement_score"] is None and rows["X"]["opened"] is None
    assert "needs_intervention" not in df.columns
    mixed = from_records(spark, [{"engagement_score": 1, "opened": 1.0, "tenure_months": float("nan")}]).first()
    assert (mixed["engagement_score"], mixed["opened"], mixed["tenure_months"]) == (1.0, 1, None)
    with pytest.raises(ValueError, match="not an integer"):
        from_records(spark, [{"opened": 0.5}])
