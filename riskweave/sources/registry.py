"""Model artifacts: preprocessor, models and one metadata row per model.

Every artifact lies in a folder ``model_id=<id>`` of its kind.  The metadata row is written
last, and only models that have one are known: a training run that fails half-way leaves
earlier models as they are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.constants import CONFIDENCE_MARGIN, FEATURES, UNKNOWN_MODEL
from riskweave.operators.explain import read_leaf_tables
from riskweave.operators.models import BoostedScorer
from riskweave.operators.preprocess import Preprocessor
from riskweave.operators.thresholds import Thresholds
from riskweave.schemas import REGISTRY
from riskweave.session import path_exists
from riskweave.sources.commits import CommitLog

MODEL, PREPROCESSOR, METADATA, BASELINE = (
    "boosted_model", "preprocessor", "model_metadata", "baseline_model",
)
REQUIRED = (MODEL, PREPROCESSOR, METADATA)


@dataclass(frozen=True)
class LoadedModel:
    """A scorer, or the reason why there is none."""

    scorer: BoostedScorer | None
    error: str | None = None
    missing: tuple[str, ...] = ()
    explainer_error: str | None = None

    @property
    def ready(self) -> bool:
        return self.scorer is not None

    @property
    def model_id(self) -> str:
        return self.scorer.model_id if self.scorer else UNKNOWN_MODEL


def artifact_path(root: str, name: str, model_id: str) -> str:
    return f"{root}/{name}/model_id={model_id}"


def _claims(spark: SparkSession, root: str, model_id: str) -> CommitLog:
    return CommitLog(spark, f"{root}/claims/model_id={model_id}")


def claim_model(spark: SparkSession, root: str, model_id: str) -> None:
    """Make the caller the only writer of a model; whoever comes second gets
    ``CommitConflict``, also after the first has failed."""
    _claims(spark, root, model_id).publish(1, {"state": "claimed"})


def save_artifacts(spark: SparkSession, root: str, model_id: str,
                   boosted: GBTClassificationModel, preprocessor: Preprocessor,
                   baseline: LogisticRegressionModel) -> None:
    """Write a model's artifacts, which nobody else can then write; ``save_metadata`` makes it
    known."""
    claim_model(spark, root, model_id)
    boosted.write().overwrite().save(artifact_path(root, MODEL, model_id))
    baseline.write().overwrite().save(artifact_path(root, BASELINE, model_id))
    preprocessor.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(
        artifact_path(root, PREPROCESSOR, model_id)
    )


def metadata_frame(spark: SparkSession, metadata: dict) -> DataFrame:
    return spark.createDataFrame([metadata], REGISTRY)


def save_metadata(spark: SparkSession, root: str, metadata: dict) -> DataFrame:
    """Write the metadata row of its model (again, if it is there) and return it.

    Every time is a version in the model's log; of two writers at a time one gets
    ``CommitConflict``.
    """
    model_id = metadata["model_id"]
    log = _claims(spark, root, model_id)
    version = log.latest()[0] + 1
    log.publish(version, {"state": "published", "metadata": json.loads(
        metadata_frame(spark, metadata).toJSON().first())})
    metadata_frame(spark, metadata).coalesce(1).write.mode("overwrite").json(
        artifact_path(root, METADATA, model_id)
    )
    return read_metadata(spark, root).where(F.col("model_id") == model_id)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row per known model."""
    return spark.read.schema(REGISTRY).json(f"{root}/{METADATA}")


def newest_model(spark: SparkSession, root: str) -> str | None:
    """Id of the known model that was created last."""
    if not path_exists(spark, f"{root}/{METADATA}"):
        return None
    row = read_metadata(spark, root).select("model_id", "created_at").orderBy(
        F.desc_nulls_last("created_at"), F.desc("model_id")).first()
    return row["model_id"] if row else None


def missing_artifacts(spark: SparkSession, root: str, model_id: str | None) -> tuple[str, ...]:
    if model_id is None:
        return REQUIRED
    return tuple(
        n for n in REQUIRED if not path_exists(spark, artifact_path(root, n, model_id)))


def load_model(spark: SparkSession, root: str, model_id: str | None = None) -> LoadedModel:
    """Load and check a model, by default the newest; what is wrong is reported, not raised."""
    try:
        model_id = model_id or newest_model(spark, root)
    except Exception as exc:
        return LoadedModel(None, str(exc))
    missing = missing_artifacts(spark, root, model_id)
    if missing:
        return LoadedModel(None, f"Not found: {', '.join(missing)}", missing)
    try:
        metadata = read_metadata(spark, root).where(F.col("model_id") == model_id).first()
        if metadata is None or list(metadata["feature_names"] or ()) != list(FEATURES):
            raise ValueError("The saved features are not the ones this version uses.")
        cuts = metadata["thresholds"]
        thresholds = Thresholds(cuts["medium"], cuts["high"], cuts["validation_mean_cost"])
        preprocessor = Preprocessor.from_frame(
            spark.read.parquet(artifact_path(root, PREPROCESSOR, model_id))
        )
        model = GBTClassificationModel.load(artifact_path(root, MODEL, model_id))
    except Exception as exc:
        return LoadedModel(None, str(exc))
    try:
        leaves, explainer_error = read_leaf_tables(
            spark, artifact_path(root, MODEL, model_id)), None
    except Exception as exc:   # the score survives without its explanation
        leaves, explainer_error = None, str(exc)
    margin = metadata["confidence_margin"]
    scorer = BoostedScorer(
        model_id=metadata["model_id"] or UNKNOWN_MODEL,
        preprocessor=preprocessor,
        thresholds=thresholds,
        margin=CONFIDENCE_MARGIN if margin is None else margin,
        feature_names=tuple(metadata["transformed_feature_names"] or FEATURES),
        model=model,
        leaves=leaves,
    )
    return LoadedModel(scorer, explainer_error=explainer_error)


def training_summary(metadata: DataFrame) -> DataFrame:
    """Model id, clean accounts, cut-offs and metrics of each registered model."""
    return metadata.select(
        "model_id", "cleaning.clean_account_count", "thresholds", "metrics"
    )


def as_document(metadata: DataFrame) -> dict:
    """The metadata row as a nested document."""
    return json.loads(metadata.toJSON().first())
