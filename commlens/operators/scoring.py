"""The fitted forest, its artifact, and batch scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from commlens.functions.business import risk_band, threshold_flag
from commlens.functions.rounding import round_even
from commlens.operators.features import Levels, feature_vector, with_features
from commlens.settings import DEFAULTS, Settings
from commlens.sources.files import from_records

VECTOR, PROBABILITY = "_features", "_probability"


@dataclass(frozen=True)
class Forest:
    """Assembler and trees as one Spark ML pipeline, plus the fitted category levels."""

    pipeline: PipelineModel
    levels: Levels

    @property
    def assembler(self) -> VectorAssembler:
        return self.pipeline.stages[0]

    @property
    def trees(self) -> RandomForestClassificationModel:
        return self.pipeline.stages[1]

    @property
    def feature_names(self) -> list[str]:
        return self.assembler.getInputCols()

    def importances(self, spark: SparkSession) -> DataFrame:
        """feature, importance"""
        pairs = zip(self.feature_names, [float(v) for v in self.trees.featureImportances.toArray()])
        return spark.createDataFrame(list(pairs), "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Model and feature schema under one folder of the cluster's file system."""
        self.pipeline.write().overwrite().save(f"{path}/model")
        schema = json.dumps({"feature_names": self.feature_names, "levels": self.levels})
        spark.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def load_schema(spark: SparkSession, path: str) -> dict[str, Any]:
    """feature_names and levels of a saved forest."""
    try:
        return json.loads(spark.read.text(f"{path}/features").first()["value"])
    except AnalysisException as error:
        raise FileNotFoundError(f"Feature names not found at '{path}'. Re-run training.") from error


def load_forest(spark: SparkSession, path: str) -> Forest:
    schema = load_schema(spark, path)
    return Forest(PipelineModel.load(f"{path}/model"), schema["levels"])


def resolve_feature_names(
    spark: SparkSession, forest: Forest | None, path: str | None, expected: list[str] | None
) -> list[str]:
    """The caller's names, else the model's, else the artifact's."""
    if expected is not None:
        return expected
    if forest is not None:
        return forest.feature_names
    try:
        return load_schema(spark, path)["feature_names"]
    except FileNotFoundError as error:
        raise RuntimeError(
            "Cannot resolve feature names. Provide expected names, a fitted model, or a saved artifact."
        ) from error


def with_probability(df: DataFrame, forest: Forest, names: list[str], column: str) -> DataFrame:
    """Add the forest's probability of the positive class; the frame's own columns stay as they are.

    Features the frame lacks count as 0. A missing number goes to the right-hand branch, as NaN does in Spark's
    trees. Only the probability is computed, once per row.
    """
    given = df.columns
    featured = with_features(df, forest.levels)
    featured = featured.withColumns({c: F.lit(0) for c in names if c not in featured.columns})
    trees = forest.trees.copy().setFeaturesCol(VECTOR).setProbabilityCol(PROBABILITY)
    trees = trees.setPredictionCol("").setRawPredictionCol("")
    scored = trees.transform(featured.withColumn(VECTOR, feature_vector(names)))
    return scored.select(*[F.col(f"`{c}`") for c in given], vector_to_array(PROBABILITY)[1].alias(column))


def score_batch(
    df: DataFrame,
    forest: Forest | None = None,
    path: str | None = None,
    expected: list[str] | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """All rows and columns, plus intervention_score, predicted_intervention, risk_band. The target is optional."""
    spark = df.sparkSession
    if forest is None:
        if path is None:
            raise FileNotFoundError("No model: pass a forest or the path of a saved one.")
        forest = load_forest(spark, path)
    names = resolve_feature_names(spark, forest, path, expected)
    p = F.col("_p")
    return (
        with_probability(df, forest, names, "_p")
        .withColumns(
            {
                "intervention_score": round_even(p),
                "predicted_intervention": threshold_flag(p, settings),
                "risk_band": risk_band(p, settings),
            }
        )
        .drop("_p")
    )


def score_or_unknown(df: DataFrame, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Scores when a model was saved; otherwise score 0.0 and band Unknown."""
    try:
        forest = load_forest(df.sparkSession, path)
    except FileNotFoundError:
        return df.withColumns({"intervention_score": F.lit(0.0), "risk_band": F.lit("Unknown")})
    return score_batch(df, forest, settings=settings)


@dataclass(frozen=True)
class ScoreResult:
    customer_id: str
    intervention_score: float
    needs_intervention: int
    risk_band: str


def score_records(
    spark: SparkSession, records: list[Mapping[str, Any]], forest: Forest, settings: Settings = DEFAULTS
) -> DataFrame:
    """customer_id, intervention_score, needs_intervention, risk_band for raw records."""
    frame = from_records(spark, records)
    if "customer_id" not in frame.columns:
        frame = frame.withColumn("customer_id", F.lit("UNKNOWN"))
    return score_batch(frame, forest, settings=settings).select(
        F.coalesce("customer_id", F.lit("UNKNOWN")).alias("customer_id"),
        "intervention_score",
        F.col("predicted_intervention").alias("needs_intervention"),
        "risk_band",
    )


def score_customer(
    spark: SparkSession, customer: Mapping[str, Any], forest: Forest, settings: Settings = DEFAULTS
) -> ScoreResult:
    """The batch of one."""
    return ScoreResult(**score_records(spark, [customer], forest, settings).first().asDict())


def risk_band_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_band").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "risk_band")
