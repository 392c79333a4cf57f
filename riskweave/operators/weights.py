"""Class counts and the row weights derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClassCounts:
    negative: int
    positive: int

    @property
    def positive_ratio(self) -> float:
        """Weight of a positive row for boosting; empty classes count as one row."""
        return max(self.negative, 1) / max(self.positive, 1)

    def balanced(self) -> tuple[float, float]:
        """n / (2 x class size) for (negative, positive)."""
        n = self.negative + self.positive
        return n / (2 * max(self.negative, 1)), n / (2 * max(self.positive, 1))

    def balanced_weight(self, label: Column) -> Column:
        negative, positive = self.balanced()
        return F.when(label == 1, F.lit(positive)).otherwise(F.lit(negative))

    def boosting_weight(self, label: Column) -> Column:
        return F.when(label == 1, F.lit(self.positive_ratio)).otherwise(F.lit(1.0))


def class_count_frame(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("label") == 0).alias("negative_count"),
        F.count_if(F.col("label") == 1).alias("positive_count"),
    )


def class_counts(df: DataFrame) -> ClassCounts:
    row = class_count_frame(df).first()
    return ClassCounts(row["negative_count"], row["positive_count"])


def class_weights(df: DataFrame) -> DataFrame:
    """One row: class counts, boosting ratio and balanced weights."""
    negative = F.greatest("negative_count", F.lit(1))
    positive = F.greatest("positive_count", F.lit(1))
    total = F.col("negative_count") + F.col("positive_count")
    return class_count_frame(df).select(
        "negative_count", "positive_count",
        (negative / positive).alias("positive_ratio"),
        (total / (2 * negative)).alias("negative_weight"),
        (total / (2 * positive)).alias("positive_weight"),
    )
