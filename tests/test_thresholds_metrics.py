import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators.metrics import classification_metrics, classification_report, roc_auc
from riskweave.operators.thresholds import (
    Thresholds, best_pair, candidate_pairs, grid_costs, select_risk_thresholds,
)


def scored(spark, labels, p):
    return spark.createDataFrame(
        [(int(y), float(v)) for y, v in zip(labels, p)], "label int, probability double"
    )


def brute_force(labels, p):
    labels, p = np.asarray(labels), np.asarray(p)
    best = None
    for m, h in candidate_pairs():
        cost = np.select(
            [(labels == 1) & (p < m), (labels == 1) & (p < h), labels == 1, p < m, p < h],
            [5.0, 1.0, 0.0, 0.0, 0.25], 1.0,
        ).mean()
        positives = (labels == 1).sum()
        recall = ((labels == 1) & (p >= m)).sum() / positives if positives else 0.0
        key = (cost, -recall, m, h)
        best = key if best is None or key < best else best
    return best


def test_grid():
    pairs = candidate_pairs()
    assert len(pairs) == 104
    assert len({m for m, _ in pairs}) == 12
    assert min(h for _, h in pairs) == 0.40
    assert all(h - m > 0.0999 for m, h in pairs)


def test_small_case_is_ordered(spark):
    t = select_risk_thresholds(
        scored(spark, [0, 0, 0, 1, 1, 1], [0.05, 0.2, 0.7, 0.3, 0.75, 0.95])
    )
    assert 0 < t.medium < t.high < 1


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [e for pair in candidate_pairs() for e in pair]
    p = np.concatenate([rng.random(300), rng.choice(edges, 100), rng.integers(0, 100, 100) / 100])
    labels = (rng.random(500) < p * (0.3 + 0.2 * seed)).astype(int)
    cost, recall, medium, high = brute_force(labels, p)
    t = select_risk_thresholds(scored(spark, labels, p))
    assert (t.medium, t.high) == (round(medium, 4), round(high, 4))
    assert t.validation_mean_cost == round(cost, 6)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    labels, p = [label] * 4, [0.1, 0.4, 0.6, 0.9]
    _, _, medium, high = brute_force(labels, p)
    t = select_risk_thresholds(scored(spark, labels, p))
    assert (t.medium, t.high) == (round(medium, 4), round(high, 4))


def test_empty_input_is_an_error(spark):
    empty = spark.createDataFrame([], "label int, probability double")
    with pytest.raises(ValueError, match="no scored validation rows"):
        select_risk_thresholds(empty)
    assert grid_costs(empty).count() == 104 and best_pair(grid_costs(empty)).count() == 0


def test_no_cross_join(spark):
    plan = grid_costs(scored(spark, [0, 1], [0.1, 0.9]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_threshold_order_is_checked():
    for bad in ((0.0, 0.5), (0.6, 0.5), (0.5, 0.5), (0.5, 1.0)):
        with pytest.raises(ValueError, match="0 < medium < high"):
            Thresholds(*bad)


def auc_by_pairs(labels, p):
    pos = [v for y, v in zip(labels, p) if y == 1]
    neg = [v for y, v in zip(labels, p) if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 12])
def test_auc_with_ties(spark, digits):
    rng = np.random.default_rng(digits)
    p = np.round(rng.random(400), digits)
    labels = (rng.random(400) < p).astype(int)
    got = roc_auc(scored(spark, labels, p)).first().roc_auc
    assert math.isclose(got, auc_by_pairs(labels, p), rel_tol=1e-12)


def test_auc_when_one_score_owns_a_third(spark):
    df = spark.range(9000).select(
        (F.col("id") % 5 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 0.5)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("probability"),
    )
    rows = df.collect()
    pos = np.sort([r.probability for r in rows if r.label == 1])
    neg = np.sort([r.probability for r in rows if r.label == 0])
    wins = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
    assert math.isclose(roc_auc(df).first().roc_auc, wins / (len(pos) * len(neg)))


def test_report(spark):
    df = scored(spark, [0, 0, 1, 1, 1], [0.1, 0.5, 0.5, 0.9, 0.2])
    m = classification_metrics(df, 0.5)
    assert m["confusion_matrix"] == [[1, 1], [1, 2]]
    assert m["precision"] == m["recall"] == 2 / 3 and math.isclose(m["f1"], 2 / 3)


def test_empty_ratios_are_zero_and_matrix_stays_two_by_two(spark):
    row = classification_report(scored(spark, [0, 0], [0.1, 0.2]), 0.5).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 0, 0, 0)
    assert row.precision == row.recall == row.f1 == 0.0
    with pytest.raises(ValueError, match="both classes"):
        classification_metrics(scored(spark, [0, 0], [0.1, 0.2]))


def test_auc_over_many_ranges(spark):
    """More shuffle partitions than the default, few of them crowded; no window over all rows."""
    rng = np.random.default_rng(5)
    p = np.concatenate((rng.random(3000) ** 8, np.full(2000, 0.25)))
    labels = (rng.random(5000) < 0.3).astype(int)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = roc_auc(scored(spark, labels, p)).first().roc_auc
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    pos, neg = np.sort(p[labels == 1]), np.sort(p[labels == 0])
    wins = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
    assert math.isclose(got, wins / (len(pos) * len(neg)), rel_tol=1e-12)
    assert roc_auc(scored(spark, [1, 1], [0.1, 0.2])).first().roc_auc is None
