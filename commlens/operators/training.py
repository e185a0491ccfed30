"""Random forest training: split, weights, fit, cross-validation, metrics, artifact."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import fmean, pstdev
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from commlens.functions.business import threshold_flag
from commlens.operators.evaluation import metrics as metrics_frame
from commlens.operators.evaluation import ranking
from commlens.operators.features import Levels, build_features, feature_names, feature_vector, fit_levels
from commlens.operators.scoring import VECTOR, Forest
from commlens.operators.splitting import assign_slots, cut_points
from commlens.schema import ID, TARGET
from commlens.session import durable
from commlens.settings import DEFAULTS, Settings

TOP_FEATURES = 10


@dataclass(frozen=True)
class TrainingSet:
    """Checkpointed rows: customer_id, label, slot (0 test, 1..folds), weight, feature vector."""

    rows: DataFrame
    levels: Levels
    train_rows: int

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("slot") > 0)

    @property
    def test(self) -> DataFrame:
        return self.rows.where(F.col("slot") == 0)


@dataclass(frozen=True)
class Training:
    forest: Forest
    metrics: dict[str, Any]


def _fit_partitions(train_rows: int, settings: Settings) -> int:
    return max(settings.min_fit_partitions, -(-train_rows // settings.rows_per_fit_partition))


def prepare(df: DataFrame, settings: Settings = DEFAULTS, levels: Levels | None = None) -> TrainingSet:
    """Features, split and balanced weights, laid out by id and checkpointed.

    The fits and evaluations read these narrow rows about twenty times; the checkpoint keeps each read from
    repeating the feature job. The layout (a partition count that follows the row count, rows sorted by id) makes
    the bootstrap, and so the forest, independent of how the input was laid out. ``levels`` are the table's own category
    levels where it has others than the declared ones.
    """
    levels = fit_levels(df) if levels is None else levels
    classes = cut_points(df, settings)
    # at most three rows, used as constants below
    found = classes.collect()
    if {r["label"] for r in found} != {0, 1}:
        raise ValueError("Training needs rows of both classes, 0 and 1, and no rows without a label.")
    kept = {r["label"]: r["rows"] - r["test_rows"] for r in found}
    if min(kept.values()) == 0:
        raise ValueError("Training needs more than one row of each class.")
    train_rows = sum(kept.values())
    weight = F.when(F.col("label") == 1, train_rows / (2 * kept[1])).otherwise(train_rows / (2 * kept[0]))

    cuts = df.sparkSession.createDataFrame(found, classes.schema)
    featured = build_features(df, levels)
    slotted = assign_slots(featured, cuts, settings)
    partitions = _fit_partitions(train_rows, settings)
    rows = (
        slotted.select(
            ID,
            F.col(TARGET).cast("double").alias("label"),
            "slot",
            feature_vector(feature_names(levels)).alias(VECTOR),
        )
        .withColumn("weight", weight)
        .repartition(partitions, ID)
        .sortWithinPartitions(ID)
    )
    return TrainingSet(durable(rows), levels, train_rows)


def fit(rows: DataFrame, settings: Settings = DEFAULTS) -> RandomForestClassificationModel:
    return RandomForestClassifier(
        featuresCol=VECTOR,
        labelCol="label",
        weightCol="weight",
        numTrees=settings.trees,
        maxDepth=settings.depth,
        maxBins=settings.max_bins,
        featureSubsetStrategy=settings.feature_subset,
        bootstrap=settings.bootstrap,
        seed=settings.seed,
    ).fit(rows)


def _scored(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    probability_only = model.copy().setPredictionCol("").setRawPredictionCol("")
    return probability_only.transform(rows).select("label", vector_to_array("probability")[1].alias("score"))


def cross_validate(
    training_set: TrainingSet, settings: Settings = DEFAULTS, parallelism: int = 1
) -> list[float]:
    """AUC of each fold, fitted on the other folds of the training part."""
    areas = [r.first()["roc_auc"] for r in fold_metrics(training_set, settings, parallelism)]
    return [float("nan") if area is None else area for area in areas]


def fits_at_once(training_set: TrainingSet, settings: Settings = DEFAULTS, parallelism: int = 1) -> int:
    """How many of ``parallelism`` fits to run at once: those whose rows fit in memory together, or as many as it takes to
    give every core a task.

    A fit keeps its rows, with a count per tree, in memory and reads them once per level of the trees. Five fits at
    once hold four times the training part; what does not fit is serialized to disk and read back at every level.
    """
    rows = max(1, training_set.train_rows * (settings.folds - 1) // settings.folds)
    cores = training_set.rows.sparkSession.sparkContext.defaultParallelism
    busy = -(-cores // _fit_partitions(training_set.train_rows, settings))
    return max(1, min(parallelism, max(busy, settings.rows_fitted_at_once // rows)))


def fold_metrics(training_set: TrainingSet, settings: Settings = DEFAULTS, parallelism: int = 1) -> list[DataFrame]:
    """One lazy row per fold: fold, rows, positives, roc_auc. The fits run now, at most ``parallelism`` at once, the scoring and
    ranking when a row is read."""

    def one(fold: int) -> DataFrame:
        model = fit(training_set.train.where(F.col("slot") != fold), settings)
        found = ranking(_scored(model, training_set.train.where(F.col("slot") == fold)), "score", "label")
        return found.select(F.lit(fold).alias("fold"), "*")

    with ThreadPoolExecutor(max_workers=fits_at_once(training_set, settings, parallelism)) as pool:
        return list(pool.map(one, range(1, settings.folds + 1)))


def evaluate(
    model: RandomForestClassificationModel, rows: DataFrame, settings: Settings = DEFAULTS
) -> dict[str, float]:
    """roc_auc, accuracy, and precision, recall, f1 of the positive class at the threshold."""
    found = evaluation_frame(model, rows, settings).drop("rows", "positives").first().asDict()
    area = found.pop("roc_auc")
    return {"roc_auc": float("nan") if area is None else area, **found, "threshold": settings.probability_threshold}


def evaluation_frame(
    model: RandomForestClassificationModel, rows: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The same as one lazy row, with the number of rows and of positives."""
    scored = _scored(model, rows).withColumn("predicted", threshold_flag(F.col("score"), settings))
    return metrics_frame(scored, "score", "predicted", "label")


def fit_forest(training_set: TrainingSet, settings: Settings = DEFAULTS, all_rows: bool = False) -> Forest:
    """The forest of the training part, or of all rows: for use after the settings are evaluated."""
    model = fit(training_set.rows if all_rows else training_set.train, settings)
    assembler = VectorAssembler(
        inputCols=feature_names(training_set.levels), outputCol=VECTOR, handleInvalid="keep"
    )
    return Forest(PipelineModel([assembler, model]), training_set.levels)


def train(
    df: DataFrame,
    path: str | None = None,
    settings: Settings = DEFAULTS,
    folds: bool = True,
    parallelism: int = 1,
) -> Training:
    """Split, fit, cross-validate, evaluate on the test part, and save when a path is given."""
    training_set = prepare(df, settings)
    forest = fit_forest(training_set, settings)
    metrics: dict[str, Any] = {}
    if folds:
        scores = cross_validate(training_set, settings, parallelism)
        metrics |= {"cv_auc_mean": round(fmean(scores), 4), "cv_auc_std": round(pstdev(scores), 4)}
    metrics |= evaluate(forest.trees, training_set.test, settings)
    if path is not None:
        forest.save(df.sparkSession, path)
    return Training(forest, metrics)


def top_features(forest: Forest, df: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The n most important features."""
    return forest.importances(df.sparkSession).orderBy(F.desc("importance"), "feature").limit(n)
