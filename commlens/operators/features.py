"""Model features: passthrough numbers, interactions, one-hot levels.

Training and scoring share one path. The levels are fitted once, stored with the model, and encoded by comparison,
so a batch with a single segment gets the same columns as the training table.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from commlens.functions.business import true_only
from commlens.functions.rounding import round_even
from commlens.operators.cleaning import add_missing
from commlens.operators.quality import non_numeric
from commlens.schema import DOMAINS, ID, TARGET

# Feature groups, in model order, and the defaults of absent categoricals.
PASSTHROUGH = [
    "opened",
    "clicked",
    "response_flag",
    "complaint_flag",
    "escalation_flag",
    "engagement_score",
    "tenure_months",
    "days_since_last_contact",
    "opt_out_flag",
]
INTERACTIONS = [
    "contact_but_no_response",
    "high_risk_combo",
    "engagement_x_tenure",
    "low_engagement_long_silence",
]
CATEGORICALS = ["segment", "product_type", "channel", "premium_bucket", "sentiment_text"]
CATEGORICAL_DEFAULTS = {
    "segment": "Standard",
    "product_type": "Auto",
    "channel": "Email",
    "premium_bucket": "Mid",
    "sentiment_text": "neutral",
}

Levels = dict[str, list[str]]
DECLARED_LEVELS: Levels = {c: sorted(DOMAINS[c]) for c in CATEGORICALS}


def fit_levels(df: DataFrame) -> Levels:
    """Sorted levels that occur of each categorical. The first level is the baseline and gets no column.

    One aggregate row over the declared domains. A value outside them raises; pass ``levels`` where a table has its own.
    """
    present = [(c, level) for c in CATEGORICALS for level in DECLARED_LEVELS[c]]
    found = df.agg(
        *[F.bool_or(F.col(c) == level).alias(f"has{i}") for i, (c, level) in enumerate(present)],
        *[F.bool_or(~F.col(c).isin(DECLARED_LEVELS[c])).alias(f"other_{c}") for c in CATEGORICALS],
    ).first()
    undeclared = [c for c in CATEGORICALS if found[f"other_{c}"]]
    if undeclared:
        raise ValueError(f"Undeclared category levels in {undeclared}; validate the table or pass its levels.")
    return {c: [level for i, (name, level) in enumerate(present) if name == c and found[f"has{i}"]] for c in CATEGORICALS}


def interaction_columns() -> dict[str, Column]:
    days, score = F.col("days_since_last_contact"), F.col("engagement_score")

    def flag(condition: Column) -> Column:
        return true_only(condition).cast("int")

    values = [
        flag((days < 30) & (F.col("response_flag") == 0)),
        flag((F.col("complaint_flag") == 1) & (F.col("escalation_flag") == 1)),
        round_even(score * F.log1p(F.col("tenure_months"))),
        flag((score < 0.35) & (days > 60)),
    ]
    return dict(zip(INTERACTIONS, values))


def one_hot_columns(levels: Levels) -> dict[str, Column]:
    """``column_level`` indicators without the baseline; missing and unseen values are 0 everywhere."""
    return {
        f"{c}_{level}": true_only(F.col(c) == level).cast("int") for c in CATEGORICALS for level in levels[c][1:]
    }


def feature_names(levels: Levels) -> list[str]:
    return [*PASSTHROUGH, *INTERACTIONS, *one_hot_columns(levels)]


def get_feature_names(df: DataFrame) -> list[str]:
    return feature_names(fit_levels(df))


def add_interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(interaction_columns())


def one_hot(df: DataFrame, levels: Levels | None = None) -> DataFrame:
    """Replace the categoricals by their indicators."""
    levels = fit_levels(df) if levels is None else levels
    return df.withColumns(one_hot_columns(levels)).drop(*CATEGORICALS)


def with_features(df: DataFrame, levels: Levels) -> DataFrame:
    """The frame plus every feature; absent categoricals take their default, the target is not needed."""
    complete = add_missing(df, CATEGORICAL_DEFAULTS)
    return complete.withColumns({**interaction_columns(), **one_hot_columns(levels)})


def feature_vector(names: list[str]) -> Column:
    """The features as a dense vector, missing numbers as NaN.

    The assembler's sparse form would be a little smaller, but trees look features up by index, and a dense lookup
    makes scoring a third faster.
    """
    missing = F.lit(float("nan"))
    return array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), missing) for c in names]))


def build_features(df: DataFrame, levels: Levels | None = None) -> DataFrame:
    """customer_id, the features in model order, needs_intervention."""
    levels = fit_levels(df) if levels is None else levels
    names = feature_names(levels)
    featured = with_features(df, levels)
    wrong = non_numeric(featured, names)
    if wrong:
        raise ValueError(f"Non-numeric columns found after feature engineering: {wrong}")
    return featured.select(ID, *names, TARGET)


def build_features_from_table(spark: SparkSession, table: str) -> DataFrame:
    return build_features(spark.table(table))
