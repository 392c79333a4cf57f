"""From labelled sources to a registered model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession

from riskweave.constants import (
    BOOST_ROUNDS, CONFIDENCE_MARGIN, DEMO_PER_CLASS, FEATURES, SEED, SOURCE_FILES,
)
from riskweave.operators.features import (
    account_features, split_count_columns, usable_accounts,
)
from riskweave.operators.merge import (
    account_groups, agreeing_accounts, summary_columns, union_sources,
)
from riskweave.operators.metrics import classification_metrics
from riskweave.operators.models import fit_baseline, fit_boosted, predict
from riskweave.operators.preprocess import fit_preprocessor, transform_columns
from riskweave.operators.split import demo_accounts, stratified_split
from riskweave.operators.thresholds import select_risk_thresholds
from riskweave.operators.weights import class_counts
from riskweave.session import stage
from riskweave.sources.registry import save_artifacts, save_metadata
from riskweave.sources.splits import SPLITS, read_split, write_demo, write_splits


@dataclass(frozen=True)
class PreparedData:
    """Features of all accounts with their split, what cleaning did, and rows per split."""

    features: DataFrame
    summary: dict
    counts: dict[str, dict[str, int]]

    def split(self, name: str) -> DataFrame:
        """Usable rows of one split."""
        return usable_accounts(self.features.where(self.features["split"] == name))


def prepare(sources: Sequence[DataFrame], generated: str, demo_per_class: int = DEMO_PER_CLASS,
            seed: int = SEED) -> PreparedData:
    """Clean, split, write splits and demo accounts, derive features.

    The sources are read and shuffled once; every later step reads a stored table.  Rows are
    counted while they are written.
    """
    cleaning, splitting = Observation("cleaning"), Observation("splitting")
    groups = stage(
        account_groups(union_sources(sources)).observe(cleaning, *summary_columns()), "accounts")
    spark = groups.sparkSession
    clean = agreeing_accounts(groups)
    write_splits(stratified_split(clean, seed), f"{generated}/splits")
    # the demo sample may contain accounts with too few features
    test = read_split(spark, f"{generated}/splits", "test").drop("split")
    write_demo(demo_accounts(test, demo_per_class, seed), f"{generated}/demo_accounts")
    features = account_features(
        read_split(spark, f"{generated}/splits"), keep=("account_id", "label", "split")
    )
    stored = stage(features.observe(splitting, *split_count_columns(SPLITS)), "features",
                   partition_by=("split",))
    counted = splitting.get
    counts = {name: {of: counted[f"{name}:{of}"] for of in ("row_count", "removed_count")}
              for name in SPLITS if counted[f"{name}:row_count"]}
    return PreparedData(stored, dict(cleaning.get), counts)


def train(sources: Sequence[DataFrame], artifacts: str, generated: str,
          demo_per_class: int = DEMO_PER_CLASS, seed: int = SEED,
          rounds: int = BOOST_ROUNDS, source_names: Sequence[str] = SOURCE_FILES) -> DataFrame:
    """Fit baseline and boosted model, choose cut-offs, evaluate, save.

    Returns the registered metadata row.
    """
    data = prepare(sources, generated, demo_per_class, seed)
    spark: SparkSession = data.features.sparkSession
    train_rows = data.split("train")
    preprocessor = fit_preprocessor(train_rows)
    counts = class_counts(train_rows)
    parts = {
        name: preprocessor.transform(data.split(name))
        for name in ("train", "validation", "test")
    }
    baseline = fit_baseline(parts["train"], counts)
    boosted = fit_boosted(parts["train"], counts, rounds=rounds, seed=seed)

    keep = ("label", "probability")
    thresholds = select_risk_thresholds(predict(boosted, parts["validation"]).select(*keep))
    boosted_test = stage(predict(boosted, parts["test"]).select(*keep), "boosted-test")
    baseline_test = stage(predict(baseline, parts["test"]).select(*keep), "baseline-test")

    created = datetime.now(timezone.utc)
    metadata = {
        "model_id": f"gbt_{created:%Y%m%dT%H%M%SZ}",
        "created_at": created.isoformat(),
        "random_state": seed,
        "source_files": list(source_names),
        "feature_names": list(FEATURES),
        "transformed_feature_names": transform_columns(),
        "thresholds": {
            "medium": thresholds.medium,
            "high": thresholds.high,
            "validation_mean_cost": thresholds.validation_mean_cost,
        },
        "confidence_margin": CONFIDENCE_MARGIN,
        "cleaning": data.summary,
        "split_counts": {s: c["row_count"] for s, c in data.counts.items()},
        "below_completeness_threshold_removed": {
            s: c["removed_count"] for s, c in data.counts.items()
        },
        "metrics": {
            "baseline_test": classification_metrics(baseline_test),
            "boosted_test": classification_metrics(boosted_test, thresholds.medium),
        },
        "library_versions": {"pyspark": pyspark.__version__, "spark": spark.version},
    }
    save_artifacts(spark, artifacts, metadata["model_id"], boosted, preprocessor, baseline)
    return save_metadata(spark, artifacts, metadata)
