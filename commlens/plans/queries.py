"""The registered queries: (spark, folder of Parquet tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from commlens.functions.business import (
    engagement_score,
    needs_intervention,
    risk_band,
    sentiment_band,
    threshold_flag,
)
from commlens.functions.rounding import round_even
from commlens.operators import (
    admission,
    anomaly,
    cleaning,
    evaluation,
    features,
    narrative,
    quality,
    reports,
    scoring,
    splitting,
    training,
)
from commlens.plans import requests
from commlens.plans.ingest import ingest
from commlens.plans.run import sample_texts
from commlens.schema import COMMUNICATIONS, ID, TARGET
from commlens.session import durable
from commlens.settings import DEFAULTS, RULE_TREE, Settings
from commlens.sources import files, staging, tables
from commlens.sources.feeds import communications, raw_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def over_cases(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(communications(spark, folder))


def over_raw(name: str, build: Callable[[DataFrame], DataFrame], bad_dates: bool = False) -> None:
    QUERIES[name] = lambda spark, folder: build(raw_feed(spark, folder, bad_dates))


def with_stand_in_score(cases: DataFrame) -> DataFrame:
    """A score any engine can recompute, in place of the forest's: 1 - engagement_score."""
    score = round_even(F.lit(1.0) - F.col("engagement_score"))
    return cases.withColumns(
        {
            "intervention_score": score,
            "predicted_intervention": threshold_flag(score),
            "risk_band": risk_band(score),
        }
    )


def scratch_table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


def from_scratch_table(spark: SparkSession, table: str, result: DataFrame) -> DataFrame:
    """A small result, checkpointed; the table it was read from is dropped."""
    kept = durable(result)
    spark.sql(f"DROP TABLE {table}")
    return kept


# --- scans -----------------------------------------------------------------------------------------------------

over_cases("comm_scan", lambda cases: cases)
over_cases("row_count", tables.count_rows)
over_cases("limit_scan", lambda cases: tables.first_rows(cases, ID, 50))


@register
def param_query(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(
        spark,
        """
        SELECT campaign_id, count(*) AS n, count_if(opened = 1) AS opened
        FROM {cases} WHERE segment = ? AND engagement_score < ? GROUP BY campaign_id
        """,
        ["Basic", 0.25],
        cases=communications(spark, folder),
    )


@register
def csv_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases written as CSV and read again under the table's types."""
    path = f"{staging.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(communications(spark, folder), path)
    return spark.read.schema(COMMUNICATIONS).option("header", True).csv(path)


@register
def json_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases as JSON records, read under the fixed schema."""
    path = f"{staging.shared_folder(spark)}/json-{uuid.uuid4().hex}"
    communications(spark, folder).write.json(path)
    return files.read_records(spark, path)


@register
def append_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches appended, the first one twice, as by a job that was run again."""
    cases, table = communications(spark, folder), scratch_table("batches")
    for name, opened in (("opened", 1), ("unopened", 0), ("opened", 1)):
        tables.append_batch(cases.where(F.col("opened") == opened), table, name)
    counts = spark.table(table).groupBy("batch").agg(F.count("*").alias("n"), F.sum("tenure_months").alias("months"))
    return from_scratch_table(spark, table, counts)


@register
def bucket_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One case of a table that is bucketed by id: one bucket is read."""
    cases, table = communications(spark, folder), scratch_table("bucketed")
    tables.write_bucketed(cases, table, ID, 16)
    wanted = reports.sample_case(cases).select(ID).first()[0]
    return from_scratch_table(spark, table, reports.case_card(reports.case_lookup(spark.table(table), wanted)))


@register
def ingested_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ingest: staged, checked on the way, cleaned, published."""
    settings = DEFAULTS.override(table_name=scratch_table("ingested"))
    return ingest(communications(spark, folder), settings)


# --- quality, admission, cleaning: over the untidy feed ---------------------------------------------------------

over_raw("dq_nulls", quality.null_counts)
over_raw("dq_binary", quality.non_binary_values)
over_raw("dq_domain", quality.unexpected_values)
over_raw("dq_ranges", quality.range_counts)
over_raw("dq_stats", quality.stats)
over_raw("dq_report", quality.report)
over_raw(
    "admission_split",
    lambda feed: admission.admit(feed).select(
        ID,
        "sent_date",
        "opened",
        "engagement_score",
        (F.size("reasons") == 0).alias("admitted"),
        F.array_join("reasons", "; ").alias("reasons"),
    ),
    bad_dates=True,
)
over_raw("clean_rows", cleaning.normalise_rows)
over_raw("dedup_cases", cleaning.clean)
over_raw("dedup_few", lambda feed: cleaning.keep_first_of_few(cleaning.normalise_rows(feed)))
over_raw("dq_missing_columns", lambda feed: quality.report(feed.drop("segment", "channel")).drop("position"))
over_raw(
    "lenient_dates",
    lambda feed: feed.select(ID, "sent_date", cleaning.lenient_date(F.col("sent_date")).alias("day")),
    bad_dates=True,
)
over_cases("default_columns", lambda c: cleaning.add_missing(c.drop("product_type"), {"product_type": "Auto"}).select(ID, "product_type", "segment"))

# --- business columns ------------------------------------------------------------------------------------------

over_cases("engagement_score", lambda c: c.select(ID, engagement_score().alias("engagement_score")))
over_cases("intervention_rule", lambda c: c.select(ID, needs_intervention().alias(TARGET)))
over_cases("sentiment_band", lambda c: c.select(ID, sentiment_band(F.col("engagement_score")).alias("sentiment")))
over_cases(
    "risk_band",
    lambda c: with_stand_in_score(c).select(ID, "intervention_score", "predicted_intervention", "risk_band"),
)

# --- features --------------------------------------------------------------------------------------------------

over_cases("interaction_features", lambda c: features.add_interactions(c).select(ID, *features.INTERACTIONS))
over_cases("one_hot", lambda c: features.one_hot(c.select(ID, *features.CATEGORICALS)))
over_cases(
    "scoring_features",
    lambda c: features.with_features(c.drop("channel", TARGET), features.DECLARED_LEVELS).select(
        ID, *features.feature_names(features.DECLARED_LEVELS)
    ),
)
over_cases(
    "aligned_features",
    lambda c: cleaning.align(features.add_interactions(c), [ID, "opened", "no_such_feature", "high_risk_combo"]),
)
over_cases("features", lambda c: features.build_features(c, features.DECLARED_LEVELS))

# --- split and evaluation --------------------------------------------------------------------------------------

over_cases("stratified_split", lambda c: splitting.stratified_split(c).select(ID, TARGET, "part", "slot"))
over_cases(
    "cv_folds",
    lambda c: splitting.stratified_split(c)
    .where(F.col("part") == "train")
    .groupBy(F.col("slot").alias("fold"), F.col(TARGET).alias("label"))
    .agg(F.count("*").alias("n"), F.min(ID).alias("first_id"), F.max(ID).alias("last_id")),
)
over_cases(
    "class_weights",
    lambda c: splitting.class_weights(c).withColumn("weight", round_even(F.col("weight"), 6)),
)
over_cases(
    "roc_auc", lambda c: evaluation.roc_auc_frame(with_stand_in_score(c), "intervention_score", TARGET)
)
over_cases(
    "confusion_matrix",
    lambda c: evaluation.confusion_matrix(with_stand_in_score(c), "predicted_intervention", TARGET),
)
over_cases(
    "classification_report",
    lambda c: evaluation.classification_report(with_stand_in_score(c), "predicted_intervention", TARGET),
)
over_cases("risk_band_counts", lambda c: scoring.risk_band_counts(with_stand_in_score(c)))

# --- detectors -------------------------------------------------------------------------------------------------

over_cases("segment_weeks", anomaly.segment_weeks)
over_cases("segment_drop", anomaly.segment_drop)
over_cases(
    "complaint_days",
    lambda c: anomaly.complaint_days(c).drop("days", "mean_complaints", "std_complaints"),
)
over_cases("complaint_spike", anomaly.complaint_spike)
over_cases("campaign_scorecard", anomaly.campaign_scorecard)
over_cases("campaign_underperformance", anomaly.campaign_underperformance)


@register
def detector_status(spark: SparkSession, folder: str) -> DataFrame:
    """The status rows with every flagged item, and with the names of the compared segments in the metadata."""
    names = F.array_join("segments", ", ")
    named = F.transform_values("metadata", lambda k, v: F.when(k == "segments_compared", names).otherwise(v))
    return anomaly.detector_status(communications(spark, folder)).select(
        "detector",
        "flagged",
        "summary",
        F.to_json(named).alias("metadata"),
        "n_flagged",
        F.to_json("anomalies").alias("anomalies"),
    )


over_cases(
    "detector_items",
    lambda c: anomaly.detector_items(c).withColumn("fields", F.to_json("fields")),
)
over_cases(
    "detector_choice",
    lambda c: anomaly.detector_status(c, anomaly.COMPLAINT_SPIKE).select("detector", "flagged", "summary", "n_flagged"),
)


@register
def rollup_status(spark: SparkSession, folder: str) -> DataFrame:
    """The status from a stored rollup that took the days in three steps, one day twice."""
    cases, table = communications(spark, folder), scratch_table("rollup")
    day = F.dayofmonth("sent_date")
    for days in (day <= 12, day > 12, day == 15):
        anomaly.store_rollup(cases.where(days), table)
    status = anomaly.status_of(spark.table(table)).select("detector", "flagged", "summary", "n_flagged")
    return from_scratch_table(spark, table, status)


over_cases("detector_rollup", lambda c: anomaly.detector_rollup(anomaly.detector_status(c)))
over_cases("anomaly_text", lambda c: anomaly.anomaly_text(anomaly.detector_status(c)))

# --- reports ---------------------------------------------------------------------------------------------------

over_cases("kpis", reports.kpis)
over_cases("engagement_histogram", reports.engagement_histogram)
over_cases("segment_rate", reports.segment_rate)
over_cases("channel_breakdown", reports.channel_breakdown)
over_cases("sentiment_mix", reports.sentiment_mix)
over_cases("daily_complaints", reports.daily_complaints)
over_cases("open_rate_heatmap", reports.open_rate_heatmap)
over_cases("top_spikes", anomaly.top_spikes)
over_cases("distinct_values", reports.distinct_values)
over_cases(
    "case_filter",
    lambda c: reports.case_list(reports.filter_cases(c, ["Premium", "Basic"], ["Email", "Phone"], 1)),
)
over_cases("candidate_cases", reports.candidate_cases)
over_cases(
    "case_lookup",
    lambda c: reports.case_card(reports.case_lookup(c, reports.sample_case(c).select(ID).scalar())),
)

# --- case texts ------------------------------------------------------------------------------------------------


def _anomalies(cases: DataFrame):
    """The detectors' text as a scalar subquery."""
    return anomaly.anomaly_text(anomaly.detector_status(cases)).scalar()


over_cases("sample_texts", lambda c: sample_texts(with_stand_in_score(c)))
over_cases(
    "unscored_cases",
    lambda c: scoring.score_or_unknown(c, "/no/such/model").select(ID, "intervention_score", "risk_band"),
)
over_raw("case_context", lambda feed: narrative.case_context(feed, "none"))
over_cases(
    "case_prompts",
    lambda c: narrative.case_prompts(with_stand_in_score(c), _anomalies(c)),
)
over_cases("case_summaries", lambda c: narrative.case_summaries(with_stand_in_score(c), _anomalies(c)))

# --- the forest ------------------------------------------------------------------------------------------------

# The target of this feed follows a rule. A tree that separates the classes learns it, so SQL can say what every score has to be.
# The forest of the default settings has no such answer: ``forest_checks`` states what must hold for any.

_models: dict[tuple, dict] = {}


def _model(spark: SparkSession, folder: str) -> dict:
    """The training set and what was fitted on it, kept for the latest state of the tables, as a service loads its model once."""
    tables = [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("events", "customer")]
    files = [F.max("_metadata.file_modification_time").cast("string"), F.max("_metadata.file_size")]
    key = (spark.sparkContext.applicationId, folder, *[tuple(t.agg(*files).first()) for t in tables])
    if key not in _models:
        _models.clear()
        _models[key] = {"set": training.prepare(communications(spark, folder), RULE_TREE)}
    return _models[key]


def _training_set(spark: SparkSession, folder: str) -> training.TrainingSet:
    return _model(spark, folder)["set"]


def _forest(spark: SparkSession, folder: str, settings: Settings = RULE_TREE, all_rows: bool = True) -> scoring.Forest:
    known, kind = _model(spark, folder), (settings, all_rows)
    if kind not in known:
        known[kind] = training.fit_forest(known["set"], settings, all_rows)
    return known[kind]


@register
def train_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics on the test part of the tree fitted on the training part."""
    trees = _forest(spark, folder, all_rows=False).trees
    threshold = F.lit(RULE_TREE.probability_threshold).alias("threshold")
    return training.evaluation_frame(trees, _training_set(spark, folder).test, RULE_TREE).select("*", threshold)


@register
def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The five folds, each scored by the default forest fitted on the other four: counts, and whether it ranks well."""
    folds = training.fold_metrics(_training_set(spark, folder), parallelism=5)
    return reduce(DataFrame.unionByName, folds).select("fold", "rows", "positives", (F.col("roc_auc") > 0.95).alias("ranks_well"))


@register
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature with its place in the model, and whether the importances are shares of one."""
    forest = _forest(spark, folder, DEFAULTS, all_rows=False)
    shares = forest.importances(spark)
    total = F.sum("importance").over(Window.partitionBy())
    place = F.array_position(F.array(*[F.lit(n) for n in forest.feature_names]), F.col("feature"))
    valid = F.col("importance").between(0.0, 1.0) & (F.abs(total - 1.0) < 1e-9)
    return shares.select("feature", place.alias("position"), valid.alias("is_share"))


@register
def forest_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The default forest on the test part: counts, and what any good forest must reach."""
    forest = _forest(spark, folder, DEFAULTS, all_rows=False)
    found = training.evaluation_frame(forest.trees, _training_set(spark, folder).test)
    return found.select(
        F.lit(forest.trees.getNumTrees).alias("trees"),
        F.lit(len(forest.feature_names)).alias("features"),
        "rows",
        "positives",
        (F.col("roc_auc") > 0.95).alias("ranks_well"),
        (F.col("accuracy") > 0.9).alias("decides_well"),
    )


@register
def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_batch(communications(spark, folder), _forest(spark, folder))


@register
def scored_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The case list with the forest's scores: filtered and limited first, then scored."""
    chosen = reports.filter_cases(communications(spark, folder), ["Premium", "Basic"], ["Email", "Phone"])
    return reports.case_list(scoring.score_batch(reports.first_cases(chosen), _forest(spark, folder)))


@register
def score_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the admitted rows of the untidy feed, by a tree that learned the rule on such rows.

    Fields of this feed contradict each other, and a tree fitted on consistent rows may ask any of them.
    """
    feed, known = raw_feed(spark, folder, bad_dates=True), _model(spark, folder)
    if "requests" not in known:
        admitted = admission.split(feed)[0].withColumn(TARGET, needs_intervention())
        known["requests"] = training.fit_forest(
            training.prepare(admitted, RULE_TREE, features.DECLARED_LEVELS), RULE_TREE, all_rows=True
        )
    return requests.score_requests(feed, known["requests"]).answered


@register
def scored_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A text for every case from the forest's score and the detectors' text."""
    cases = communications(spark, folder)
    return narrative.case_summaries(scoring.score_batch(cases, _forest(spark, folder)), _anomalies(cases))
