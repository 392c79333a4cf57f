"""Classification metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import stage


def confusion(scored: DataFrame, threshold, label: str = "label",
              probability: str = "probability") -> DataFrame:
    """One row: tn, fp, fn, tp at ``probability >= threshold``."""
    flagged = F.col(probability) >= F.lit(threshold)
    positive = F.col(label) == 1
    return scored.agg(
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(positive & flagged).alias("tp"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_report(scored: DataFrame, threshold=0.5, label: str = "label",
                          probability: str = "probability") -> DataFrame:
    """One row: confusion counts, precision, recall and F1; empty ratios are 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(scored, threshold, label, probability).select(
        F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp",
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(scored: DataFrame, label: str = "label", probability: str = "probability"
            ) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; NULL with one class only.

    A distributed prefix sum: equal scores are counted map-side and dealt to tasks by ranges of
    the score.  Each range is ranked by itself; what lies below it, one total per range, is
    added afterwards.
    """
    spark = scored.sparkSession
    by_score = stage(scored.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")),
        "scores")
    # ranges follow one another as the partitions do
    ranged = stage(by_score.repartitionByRange("score").withColumn(
        "range", F.spark_partition_id()), "ranges")
    lower = Window.partitionBy("range").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1)
    # products of counts outgrow BIGINT long before the counts do
    pos, neg = F.col("pos").cast("decimal(18,0)"), F.col("neg").cast("decimal(18,0)")
    twice_wins = pos * (
        2 * F.coalesce(F.sum("neg").over(lower), F.lit(0)) + F.col("neg")
    ).cast("decimal(19,0)")
    totals = ranged.withColumn("twice_wins", twice_wins).groupBy("range").agg(
        F.sum("twice_wins").alias("inside"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    twice, positives, negatives = 0, 0, 0
    # one row per shuffle partition
    for r in sorted(totals.collect(), key=lambda r: r["range"]):
        twice += int(r["inside"]) + 2 * r["pos"] * negatives
        positives, negatives = positives + r["pos"], negatives + r["neg"]
    pairs = positives * negatives
    return spark.createDataFrame(
        [(twice / (2 * pairs) if pairs else None,)], "roc_auc double")


def classification_metrics(scored: DataFrame, threshold: float = 0.5,
                           label: str = "label", probability: str = "probability") -> dict:
    """All metrics as one document; a single-class table has no ROC-AUC and is an error."""
    row = classification_report(scored, threshold, label, probability).first()
    auc = roc_auc(scored, label, probability).first()["roc_auc"]
    if auc is None:
        raise ValueError("ROC-AUC needs rows of both classes.")
    return {
        "threshold": float(threshold),
        "f1": row["f1"],
        "precision": row["precision"],
        "recall": row["recall"],
        "roc_auc": auc,
        "confusion_matrix": [[row["tn"], row["fp"]], [row["fn"], row["tp"]]],
    }
