"""Choice of the medium and high cut-off by expected cost.

Scores are folded into one cell per (label, interval between neighbouring grid
edges) in a single aggregate; every candidate pair is then priced from running
totals at its two edges, found by equi-joins on at most 118 edges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.constants import (
    COST_FALSE_HIGH, COST_FALSE_MEDIUM, COST_MISSED_LOW, COST_MISSED_MEDIUM,
    GRID_STEP, HIGH_RANGE, MEDIUM_RANGE, MIN_BAND_WIDTH,
)


@dataclass(frozen=True)
class Thresholds:
    medium: float
    high: float
    validation_mean_cost: float | None = None

    def __post_init__(self):
        if not 0.0 < self.medium < self.high < 1.0:
            raise ValueError("Cut-offs must satisfy 0 < medium < high < 1.")


def candidate_pairs() -> list[tuple[float, float]]:
    """All (medium, high) pairs, with the floating-point drift of stepped ranges."""
    pairs = []
    for medium in np.arange(*MEDIUM_RANGE, GRID_STEP).tolist():
        lowest_high = max(HIGH_RANGE[0], medium + MIN_BAND_WIDTH)
        highs = np.arange(lowest_high, HIGH_RANGE[1], GRID_STEP).tolist()
        pairs.extend((medium, high) for high in highs)
    return pairs


def _grid(spark: SparkSession, index: dict[float, int]) -> DataFrame:
    """The candidate pairs and their edge numbers as a constant table."""
    rows = ", ".join(
        f"({m!r}D, {h!r}D, {index[m]}, {index[h]})" for m, h in candidate_pairs()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(medium, high, medium_cell, high_cell)")


def grid_costs(scored: DataFrame, label: str = "label",
               probability: str = "probability") -> DataFrame:
    """One row per candidate pair: mean cost, recall at medium and scored rows."""
    spark = scored.sparkSession
    edges = sorted({edge for pair in candidate_pairs() for edge in pair})
    index = {e: i + 1 for i, e in enumerate(edges)}

    # cell k holds edge[k] <= p < edge[k+1]: exactly the comparisons of a band rule
    to_cell = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol=probability,
        outputCol="cell", handleInvalid="error",
    )
    counted = (
        to_cell.transform(scored.select(label, probability))
        .groupBy(F.col("cell").cast("int").alias("cell"))
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) == 0).alias("negatives"),
        )
    )
    # at most 118 rows from here on, so an unpartitioned window is harmless
    cells = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("cell"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("cell").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    below = (
        cells.join(counted, "cell", "left").na.fill(0, ["positives", "negatives"])
        .select(
            "cell",
            F.coalesce(F.sum("positives").over(before), F.lit(0)).alias("positives_below"),
            F.coalesce(F.sum("negatives").over(before), F.lit(0)).alias("negatives_below"),
            F.sum("positives").over(everything).alias("positives"),
            F.sum("negatives").over(everything).alias("negatives"),
        )
    )
    grid = _grid(spark, index)
    at_medium = below.withColumnsRenamed({
        "cell": "medium_cell", "positives_below": "positives_low",
        "negatives_below": "negatives_low",
    })
    at_high = below.select(
        F.col("cell").alias("high_cell"),
        F.col("positives_below").alias("positives_upto_high"),
        F.col("negatives_below").alias("negatives_upto_high"),
    )
    cost = (
        F.col("positives_low") * COST_MISSED_LOW
        + (F.col("positives_upto_high") - F.col("positives_low")) * COST_MISSED_MEDIUM
        + (F.col("negatives_upto_high") - F.col("negatives_low")) * COST_FALSE_MEDIUM
        + (F.col("negatives") - F.col("negatives_upto_high")) * COST_FALSE_HIGH
    )
    rows = F.col("positives") + F.col("negatives")
    found = F.col("positives") - F.col("positives_low")
    return (
        grid.join(at_medium, "medium_cell").join(at_high, "high_cell")
        .select(
            "medium", "high",
            F.try_divide(cost, rows).alias("mean_cost"),
            F.coalesce(F.try_divide(found, F.col("positives")), F.lit(0.0)).alias("recall"),
            rows.alias("scored_rows"),
        )
    )


def best_pair(costs: DataFrame) -> DataFrame:
    """The cheapest pair; ties by higher recall, lower medium, lower high."""
    return (
        costs.where(F.col("scored_rows") > 0)
        .orderBy("mean_cost", F.desc("recall"), "medium", "high").limit(1)
        .select(
            F.bround("medium", 4).alias("medium"),
            F.bround("high", 4).alias("high"),
            F.bround("mean_cost", 6).alias("validation_mean_cost"),
        )
    )


def select_risk_thresholds(scored: DataFrame, label: str = "label",
                           probability: str = "probability") -> Thresholds:
    row = best_pair(grid_costs(scored, label, probability)).first()
    if row is None:
        raise ValueError("There are no scored validation rows to choose cut-offs from.")
    return Thresholds(row["medium"], row["high"], row["validation_mean_cost"])
