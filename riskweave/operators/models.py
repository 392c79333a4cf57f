"""Fitting and scoring: a weighted linear baseline and a boosted-tree classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.constants import (
    BASELINE_MAX_ITER, BOOST_COLUMN_SHARE, BOOST_DEPTH, BOOST_RATE, BOOST_ROUNDS,
    BOOST_ROW_SHARE, CONFIDENCE_MARGIN, FEATURES, SEED,
)
from riskweave.operators.explain import (
    LeafTable, contribution_column, linear_contributions,
)
from riskweave.operators.preprocess import Preprocessor
from riskweave.operators.thresholds import Thresholds
from riskweave.operators.weights import ClassCounts
from riskweave.session import shared_dir


# A fit uses every core once its tasks have so many rows, and gives no task more than the most.
FIT_ROWS_LEAST = 5_000
FIT_ROWS_MOST = 1_000_000


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def without_noise(train: DataFrame) -> DataFrame:
    """Features that are constant but for rounding become exactly 0.

    Their spread of 1e-16 would be taken for a scale and divided by, and the line search
    of the fit would stop at its start.  A coefficient for them is 0 anyway.
    """
    spread = train.agg(*[(F.max(f) - F.min(f)).alias(f) for f in FEATURES]).first()
    flat = [f for f in FEATURES if not (spread[f] or 0.0) > 1e-9]
    return train.withColumns({f: F.lit(0.0) for f in flat})


def in_even_tasks(train: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows dealt evenly over the cluster's cores, in an order that is always the same.

    A fit passes over its rows hundreds of times with the tasks it was given.  Rows as they are
    read come in as many tasks as there are files: a few, since twelve numbers a row make small
    files of many rows.  The order inside a task decides which rows a round samples.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, -(-rows // FIT_ROWS_LEAST)), -(-rows // FIT_ROWS_MOST), 1)
    keys = ["account_id"] if "account_id" in train.columns else train.columns
    return train.repartition(tasks, *keys).sortWithinPartitions(*keys)


def fit_baseline(train: DataFrame, counts: ClassCounts,
                 max_iter: int = BASELINE_MAX_ITER) -> LogisticRegressionModel:
    """L2 logistic regression with balanced weights and unit inverse regularisation."""
    rows = counts.negative + counts.positive
    weighted = assemble(in_even_tasks(without_noise(train), rows)).withColumns({
        "weight": counts.balanced_weight(F.col("label")),
        "label": F.col("label").cast("double"),
    })
    model = LogisticRegression(
        weightCol="weight", maxIter=max_iter, tol=1e-9, standardization=False,
        # the average loss is minimised; balanced weights sum to the row count
        regParam=1.0 / rows, elasticNetParam=0.0,
    ).fit(weighted.select("features", "label", "weight"))
    # the summary holds the session, which does not travel to tasks once rows are observed
    model._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return model


def fit_boosted(train: DataFrame, counts: ClassCounts, rounds: int = BOOST_ROUNDS,
                depth: int = BOOST_DEPTH, seed: int = SEED) -> GBTClassificationModel:
    """Boosted trees; rows are cached and lineage is cut every ten rounds."""
    shared_dir(train.sparkSession)   # gives the boosting loop a checkpoint folder
    even = in_even_tasks(train, counts.negative + counts.positive)
    weighted = assemble(even).withColumns({
        "weight": counts.boosting_weight(F.col("label")),
        "label": F.col("label").cast("double"),
    })
    return GBTClassifier(
        weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=BOOST_RATE,
        subsamplingRate=BOOST_ROW_SHARE, featureSubsetStrategy=str(BOOST_COLUMN_SHARE),
        maxBins=256, checkpointInterval=10, seed=seed,
    ).fit(weighted.select("features", "label", "weight"))


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``probability`` of the suspicious class; ``df`` holds transformed features.

    Works on a copy of the model, whose own output columns stay as they are.
    """
    quiet = {"probabilityCol": "_probability", "rawPredictionCol": "", "predictionCol": ""}
    return (
        model.copy({model.getParam(name): value for name, value in quiet.items()})
        .transform(assemble(df))
        .withColumn("probability", F.get(vector_to_array("_probability"), F.lit(1)))
        .drop("features", "_probability")
    )


@dataclass(frozen=True)
class Scorer:
    """What an assessment needs: parameters, cut-offs, a probability, an explanation."""

    model_id: str
    preprocessor: Preprocessor
    thresholds: Thresholds
    margin: float = CONFIDENCE_MARGIN
    feature_names: Sequence[str] = field(default=tuple(FEATURES))

    def score(self, features: DataFrame) -> DataFrame:
        """Replace features by transformed ones; add probability and contributions."""
        transformed = self.preprocessor.transform(features)
        return self._explained(self._predicted(transformed))

    def _predicted(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _explained(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class BoostedScorer(Scorer):
    model: GBTClassificationModel | None = None
    # None: the explanation is unavailable, the score is not
    leaves: list[LeafTable] | None = None

    def _predicted(self, df: DataFrame) -> DataFrame:
        return predict(self.model, df)

    def _explained(self, df: DataFrame) -> DataFrame:
        if not self.leaves or len(self.feature_names) != len(FEATURES):
            return df.withColumn("contributions", F.lit(None).cast("array<double>"))
        column = contribution_column(self.leaves, FEATURES)
        return df.withColumn("contributions", column)


@dataclass(frozen=True)
class LinearScorer(Scorer):
    """Logistic score as plain column arithmetic."""

    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    digits: int | None = None    # round the probability before any decision

    @staticmethod
    def coefficients_of(model: LogisticRegressionModel) -> dict[str, float]:
        return dict(zip(FEATURES, (float(v) for v in model.coefficients)))

    def _predicted(self, df: DataFrame) -> DataFrame:
        margin = F.lit(self.intercept)
        for name in FEATURES:
            margin = margin + F.col(name) * F.lit(self.coefficients[name])
        p = 1 / (1 + F.exp(-F.col("_margin")))
        if self.digits is not None:
            p = F.round(p, self.digits)
        return df.withColumn("_margin", margin).withColumn("probability", p).drop("_margin")

    def _explained(self, df: DataFrame) -> DataFrame:
        return df.withColumn(
            "contributions", linear_contributions(FEATURES, self.coefficients)
        )
