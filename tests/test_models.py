import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.constants import BOOLEAN_FEATURES, FEATURES
from riskweave.operators import explain
from riskweave.operators.models import (
    BoostedScorer, LinearScorer, assemble, fit_baseline, fit_boosted, predict,
)
from riskweave.operators.preprocess import fit_preprocessor
from riskweave.operators.thresholds import Thresholds
from riskweave.operators.weights import class_counts
from riskweave.sources import registry

SCHEMA = ", ".join(f"{f} double" for f in FEATURES) + ", label int, usable int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(0.1, 20, (300, 12))
    x[:, 9:] = rng.integers(0, 2, (300, 3))
    y = ((x[:, 1] + 6 * x[:, 9] + rng.normal(0, 3, 300)) > 12).astype(int)
    data = [(*map(float, r), int(c), 12) for r, c in zip(x, y)]
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    p = fit_preprocessor(rows)
    train = p.transform(rows)
    counts = class_counts(rows)
    return p, train, counts, fit_boosted(train, counts, rounds=6, depth=3)


@pytest.fixture(scope="module")
def saved(spark, fitted, tmp_path_factory):
    p, train, counts, model = fitted
    root = str(tmp_path_factory.mktemp("artifacts"))
    registry.save_artifacts(spark, root, "fixture_model", model, p, fit_baseline(train, counts))
    registry.save_metadata(spark, root, {
        "model_id": "fixture_model", "feature_names": list(FEATURES),
        "transformed_feature_names": list(FEATURES),
        "thresholds": {"medium": 0.3, "high": 0.7}, "confidence_margin": 0.08,
    })
    return root


def matrix(df):
    return df.select(*FEATURES).toPandas().to_numpy()


def test_baseline_reaches_the_regularised_optimum(fitted):
    p, train, counts, _ = fitted
    model = fit_baseline(train, counts)
    pdf = train.toPandas()
    x, y = pdf[list(FEATURES)].to_numpy(), pdf["label"].to_numpy()
    w = np.where(y == 1, counts.balanced()[1], counts.balanced()[0])
    beta, b = model.coefficients.toArray(), model.intercept
    residual = w * (1 / (1 + np.exp(-(x @ beta + b))) - y)
    # gradient of sum of weighted losses + |beta|^2 / 2, intercept unpenalised
    assert np.abs(x.T @ residual + beta).max() < 1e-3
    assert abs(residual.sum()) < 1e-3
    scored = predict(model, train).toPandas()
    want = 1 / (1 + np.exp(-(scored[list(FEATURES)].to_numpy() @ beta + b)))
    assert np.allclose(scored["probability"], want)


def test_boosted_scores_rank_the_training_rows(fitted):
    _, train, _, model = fitted
    scored = predict(model, train).select("label", "probability").toPandas()
    assert scored.probability.between(0, 1).all()
    pos = scored.probability[scored.label == 1]
    neg = scored.probability[scored.label == 0]
    assert (pos.to_numpy()[:, None] > neg.to_numpy()[None, :]).mean() > 0.85


def test_contributions_add_up_to_the_margin(spark, fitted, saved):
    _, train, _, _ = fitted
    scorer = registry.load_model(spark, saved).scorer
    base = explain.expected_margin(scorer.leaves)
    out = scorer._explained(scorer._predicted(train)).select(
        "probability", "contributions").collect()
    for r in out:
        logit = math.log(r.probability / (1 - r.probability))
        assert math.isclose(base + sum(r.contributions), logit, abs_tol=1e-9)


def conditional_margin(nodes, weights, x, known):
    """Expected log-odds when only the features in ``known`` are seen."""
    def walk(tree, node):
        if node["leftChild"] < 0:
            return node["prediction"]
        left, right = tree[node["leftChild"]], tree[node["rightChild"]]
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return walk(tree, left if x[f] <= cut else right)
        a, b = left["impurityStats"][0], right["impurityStats"][0]
        return (a * walk(tree, left) + b * walk(tree, right)) / node["impurityStats"][0]

    trees = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return sum(2 * weights[t] * walk(tree, tree[0]) for t, tree in trees.items())


def test_contributions_equal_brute_force_shapley(spark, fitted, saved):
    _, train, _, _ = fitted
    path = registry.artifact_path(saved, registry.MODEL, "fixture_model")
    nodes = spark.read.parquet(f"{path}/data").collect()
    weights = explain.read_tree_weights(spark, path)
    used = sorted({r["nodeData"]["split"]["featureIndex"] for r in nodes
                   if r["nodeData"]["leftChild"] >= 0})
    # the twelve features give 4096 coalitions; unused ones contribute nothing
    used = used[:12]
    x = matrix(train.limit(2))
    got = explain.contributions(x, explain.read_leaf_tables(spark, path))
    for row, phi in zip(x, got):
        value = {
            s: conditional_margin(nodes, weights, row, set(s))
            for k in range(len(used) + 1) for s in combinations(used, k)
        }
        n = len(used)
        for i in used:
            rest = [j for j in used if j != i]
            want = sum(
                math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                * (value[tuple(sorted((*s, i)))] - value[s])
                for k in range(n) for s in combinations(rest, k)
            )
            assert math.isclose(phi[i], want, abs_tol=1e-9)


def test_loaded_model_scores_and_explains(spark, rows, fitted, saved):
    loaded = registry.load_model(spark, saved)
    assert loaded.ready and loaded.model_id == "fixture_model" and loaded.missing == ()
    _, train, _, model = fitted
    a = loaded.scorer.score(rows).select(*FEATURES, "probability").toPandas()
    b = predict(model, train).select(*FEATURES, "probability").toPandas()
    assert np.allclose(np.sort(a.probability), np.sort(b.probability))
    from riskweave.operators.assess import decide

    scored = loaded.scorer.score(rows).withColumns(
        {"account_id": F.lit("1"), "completeness": F.lit(1.0)})
    for r in decide(scored, loaded.scorer).collect():
        assert 0 <= r.risk_probability <= 1 and r.risk_band in {"low", "medium", "high"}
        assert len(r.top_factors) == 3 and r.status == "completed"


def test_missing_artifacts(spark, tmp_path):
    loaded = registry.load_model(spark, str(tmp_path))
    assert not loaded.ready and loaded.model_id == "unknown_model"
    assert sorted(loaded.missing) == sorted(registry.REQUIRED)
    assert loaded.error.startswith("Not found: boosted_model, preprocessor")


@pytest.mark.parametrize("change,message", [
    ({"feature_names": ["a"]}, "saved features"),
    ({"thresholds": {"medium": 0.7, "high": 0.3}}, "0 < medium < high"),
])
def test_bad_metadata_is_reported(spark, saved, tmp_path, change, message):
    import shutil

    root = str(tmp_path / "copy")
    shutil.copytree(saved, root)
    document = {**registry.as_document(registry.read_metadata(spark, saved)), **change}
    registry.save_metadata(spark, root, document)
    loaded = registry.load_model(spark, root)
    assert not loaded.ready and message in loaded.error


def test_score_survives_a_broken_explainer(spark, rows, fitted):
    p, _, _, model = fitted
    scorer = BoostedScorer("m", p, Thresholds(0.3, 0.7), model=model, leaves=None)
    out = scorer.score(rows).select("probability", "contributions").first()
    assert out.probability is not None and out.contributions is None
    short = BoostedScorer("m", p, Thresholds(0.3, 0.7), model=model,
                          leaves=[object()], feature_names=("a",))
    assert short.score(rows).first().contributions is None


def test_explanation_code_travels_with_the_plan(saved):
    """Executors need numpy and pandas, not this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    shares = np.array([[-0.1, 0.2]])
    table = (np.array([0]), np.array([-np.inf]), np.array([0.5]), shares)
    blob = cloudpickle.dumps((explain.batch_explainer(), [table]))
    code = (
        "import sys, pickle, numpy as np\n"
        "f, t = pickle.loads(bytes.fromhex(sys.stdin.read()))\n"
        "assert not any(m.startswith('riskweave') for m in sys.modules)\n"
        "print(f(np.array([[0.0], [1.0]]), t).ravel().tolist())"
    )
    done = subprocess.run([sys.executable, "-c", code], input=blob.hex(), cwd="/",
                          capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "[0.2, -0.1]"


def test_linear_scorer_equals_the_fitted_baseline(rows, fitted):
    p, train, counts, _ = fitted
    model = fit_baseline(train, counts)
    scorer = LinearScorer("lin", p, Thresholds(0.3, 0.7),
                          coefficients=LinearScorer.coefficients_of(model),
                          intercept=model.intercept)
    a = scorer.score(rows).select("probability").toPandas().probability
    b = predict(model, train).select("probability").toPandas().probability
    assert np.allclose(a, b)


def test_assembled_order(fitted):
    _, train, _, _ = fitted
    row = assemble(train).first()
    assert row.features.toArray().tolist() == [row[f] for f in FEATURES]
    assert len(BOOLEAN_FEATURES) == 3


def test_the_saved_model_keeps_its_output_columns(spark, saved, fitted):
    predict(fitted[3], fitted[1]).count()
    loaded = registry.load_model(spark, saved).scorer.model
    assert (loaded.getPredictionCol(), loaded.getRawPredictionCol(), loaded.getProbabilityCol()) \
        == ("prediction", "rawPrediction", "probability")


def test_a_column_that_is_constant_but_for_rounding_does_not_stop_the_fit(fitted):
    _, train, counts, _ = fitted
    noisy = train.withColumn("username_length", F.lit(1e-17) * F.rand(1))
    model = fit_baseline(noisy, counts)
    assert model.coefficients[list(FEATURES).index("username_length")] == 0.0
    assert max(abs(c) for c in model.coefficients) > 0.1


def test_models_are_kept_side_by_side(spark, saved, fitted, tmp_path):
    import shutil

    p, train, counts, model = fitted
    root = str(tmp_path / "two")
    shutil.copytree(saved, root)
    row = {"feature_names": list(FEATURES), "transformed_feature_names": list(FEATURES),
           "thresholds": {"medium": 0.2, "high": 0.8}, "confidence_margin": 0.08}
    baseline = fit_baseline(train, counts)
    # artifacts without a metadata row: a run that did not come to its end
    registry.save_artifacts(spark, root, "later", model, p, baseline)
    assert registry.load_model(spark, root).model_id == "fixture_model"
    registry.save_metadata(spark, root, {**row, "model_id": "later", "created_at": "2024"})
    assert registry.load_model(spark, root).model_id == "later"
    assert registry.load_model(spark, root, "fixture_model").scorer.thresholds.high == 0.7
    assert registry.training_summary(registry.read_metadata(spark, root)).count() == 2


def test_an_explanation_that_fails_in_a_task_leaves_the_score(rows, fitted):
    p, _, _, model = fitted
    broken = explain.LeafTable(features=(99,), above=np.array([0.0]), upto=np.array([1.0]),
                               shares=np.zeros((2, 1)), expected=0.0)
    scorer = BoostedScorer("m", p, Thresholds(0.3, 0.7), model=model, leaves=[broken])
    out = scorer.score(rows).select("probability", "contributions").collect()
    assert all(r.probability is not None and r.contributions is None for r in out)


def test_fits_use_the_cores_whatever_the_files(spark):
    from riskweave.operators.models import in_even_tasks

    train = spark.range(20_000).selectExpr("cast(id as string) account_id", "id * 1.5 x", "0 label")
    even = in_even_tasks(train.coalesce(1), 20_000)
    sizes = even.rdd.glom().map(len).collect()
    assert len(sizes) == 4 and max(sizes) < 5_400
    # what a round samples follows from the order inside a task
    ids = [r.account_id for r in even.collect()]
    assert ids == [r.account_id for r in in_even_tasks(train.repartition(3), 20_000).collect()]
    assert sorted(ids) == sorted(str(i) for i in range(20_000))
