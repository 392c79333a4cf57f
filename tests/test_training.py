import pytest

from riskweave.operators.assess import assess_accounts
from riskweave.plans.training import train
from riskweave.sources import profiles, registry
from riskweave.sources.accounts import load_accounts


@pytest.fixture(scope="module")
def run(spark, sample, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("training"))
    metadata = train(profiles.labelled_sources(spark, sample), f"{root}/artifacts",
                     f"{root}/generated", demo_per_class=3, rounds=3,
                     source_names=("crm", "events"))
    return root, metadata


def test_metadata(run):
    root, metadata = run
    m = registry.as_document(metadata)
    assert m["cleaning"] == {
        "invalid_rows_removed": 3, "conflicting_account_ids_removed": 6,
        "duplicate_rows_removed": 6, "clean_account_count": 144,
    }
    # 144 accounts: 44 held out, half of them for test
    assert m["split_counts"] == {"train": 100, "validation": 22, "test": 22}
    assert 0 < m["thresholds"]["medium"] < m["thresholds"]["high"] < 1
    assert m["model_id"].startswith("gbt_") and m["model_id"].endswith("Z")
    assert m["metrics"]["baseline_test"]["threshold"] == 0.5
    assert m["metrics"]["boosted_test"]["threshold"] == m["thresholds"]["medium"]
    removed = m["below_completeness_threshold_removed"]
    for name in ("baseline_test", "boosted_test"):
        matrix = m["metrics"][name]["confusion_matrix"]
        assert sum(map(sum, matrix)) == 22 - removed["test"]
    summary = registry.training_summary(metadata).first()
    assert summary.clean_account_count == 144


def test_artifacts_serve_requests(spark, sample, run):
    root, metadata = run
    loaded = registry.load_model(spark, f"{root}/artifacts")
    assert loaded.ready and loaded.explainer_error is None
    demo = load_accounts(spark, f"{root}/generated/demo_accounts")
    assert demo.ready and demo.count() == 6
    decided = assess_accounts(demo.accounts, loaded.scorer).collect()
    for r in decided:
        if r.status == "completed":
            assert 0 <= r.risk_probability <= 1 and len(r.top_factors) == 3
        else:
            assert r.status == "insufficient_data" and r.risk_probability is None


def test_baseline_is_saved_too(spark, run):
    from pyspark.ml.classification import LogisticRegressionModel

    root, metadata = run
    path = registry.artifact_path(f"{root}/artifacts", registry.BASELINE,
                                  metadata.first()["model_id"])
    assert LogisticRegressionModel.load(path).numFeatures == 12
