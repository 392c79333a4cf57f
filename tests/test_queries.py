"""Every driver query against its SQL at the smallest scale, and plan checks."""

import pytest

import __spark_entry__ as driver
from checks import queries as Q
from checks.compare import connect, difference
from checks.oracle import ORACLE

FITTED = {
    "baseline_scores", "boosted_scores", "boosted_top_factors", "boosted_assess_batch",
    "model_metrics", "train_report",
}


@pytest.fixture(scope="module")
def duck(sample):
    return connect(sample)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sample, duck, name):
    assert difference(Q.QUERIES[name](spark, sample), duck, ORACLE[name]) \
        is None


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_queries_return_rows(spark, sample, name):
    assert Q.QUERIES[name](spark, sample).count() > 0


def test_only_fitted_queries_lack_sql():
    assert set(Q.QUERIES) - set(ORACLE) == FITTED


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() == 144 and df.columns[:2] == ["account_id", "label"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["assess_batch", "clean_accounts", "fixed_scores", "risk_bands",
                                  "threshold_grid_costs", "roc_auc", "override_intake"])
def test_no_python_and_no_cross_join(spark, sample, name):
    text = plan(Q.QUERIES[name](spark, sample))
    for word in ("Python", "Cartesian", "NestedLoop"):
        assert word not in text


def test_boosted_explanation_is_the_only_python_step(spark, sample):
    text = plan(Q.QUERIES["boosted_top_factors"](spark, sample))
    assert text.count("ArrowEvalPython") == 1


def test_scans_read_only_what_a_query_needs(spark, sample):
    text = plan(Q.QUERIES["feature_completeness"](spark, sample))
    assert "l_orderkey" in text and "l_extendedprice" not in text
    text = plan(Q.usable_split(spark, sample, "train").select("label"))
    assert "PartitionFilters: [isnotnull(split" in text
    assert "GreaterThanOrEqual(usable,6)" in text
