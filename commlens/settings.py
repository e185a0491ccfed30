"""Thresholds and model settings, passed to the operators as one frozen value."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    # Every default below is part of the result definition.
    table_name: str = "customer_communications"

    # target rule
    low_engagement: float = 0.25
    recent_days: int = 45
    dormant_days: int = 120
    dormant_engagement: float = 0.5

    # detectors
    engagement_drop_threshold: float = 0.15
    complaint_zscore_threshold: float = 2.0
    campaign_open_rate_ratio: float = 0.5

    # quality
    min_rows: int = 100
    min_intervention_rate: float = 0.05
    max_intervention_rate: float = 0.80

    # model
    test_fraction: float = 0.2
    folds: int = 5
    trees: int = 100
    depth: int = 6
    seed: int = 42
    probability_threshold: float = 0.45
    high_risk: float = 0.70
    medium_risk: float = 0.45
    # 256 bins keep every day (0..180) and tenure (1..120) value its own threshold
    max_bins: int = 256
    # rows per training partition; the partition count follows the data, never the cluster,
    # because the forest's bootstrap depends on the layout
    rows_per_fit_partition: int = 1_000_000
    min_fit_partitions: int = 8
    # rows that the folds' fits may hold in memory together (0.61 KB each with 100 trees): fits that overflow it
    # read their rows back from disk at every level. Changes the time only, never the result
    rows_fitted_at_once: int = 12_000_000
    bootstrap: bool = True
    feature_subset: str = "sqrt"

    def override(self, **changes: Any) -> "Settings":
        """Copy with the given values; an explicit 0 or 0.0 is kept, None means unchanged."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @staticmethod
    def from_mapping(values: dict[str, Any]) -> "Settings":
        known = {f.name for f in fields(Settings)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"Unknown settings: {unknown}")
        return Settings(**values)

    @staticmethod
    def load(path: str) -> "Settings":
        """Read a flat JSON file of setting names and values."""
        with open(path, encoding="utf-8") as handle:
            return Settings.from_mapping(json.load(handle))


DEFAULTS = Settings()
#: One tree on all rows and all features, deep enough to separate the classes: where the target follows a rule, every leaf
#: is pure and the probability is the rule, 0.0 or 1.0, whatever the seed and the layout.
RULE_TREE = DEFAULTS.override(trees=1, depth=12, bootstrap=False, feature_subset="all")
