import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.constants import (
    ERROR_MESSAGES, EXPLANATION_WARNING, INSUFFICIENT_WARNING, TRIAGE_WARNING,
)
from riskweave.operators import lookup
from riskweave.operators.assess import assess, read_request_bodies, request_problem, to_record
from riskweave.operators.models import Scorer
from riskweave.operators.overrides import decide_overrides, read_override_bodies
from riskweave.operators.reports import list_accounts, listing_response, readiness_report
from riskweave.operators.thresholds import Thresholds
from riskweave.plans.serving import assessment_batch, override_batch
from riskweave.sources.accounts import load_accounts
from riskweave.sources.store import FeedbackStore

NOW = dt.datetime(2024, 5, 1)
ACCOUNTS = (
    "source_dataset string, account_id string, username string, description string, "
    "location string, account_age_days int, followers_count int, following_count int, "
    "tweet_count int, verified boolean, default_profile_image boolean, "
    "description_length int, username_length int"
)


class FixedScorer(Scorer):
    """Same probability for everyone; the posting frequency explains it."""

    def __init__(self, probability=0.82, explains=True, thresholds=(0.3, 0.7)):
        super().__init__("fixture_model", None, Thresholds(*thresholds))
        object.__setattr__(self, "probability", probability)
        object.__setattr__(self, "explains", explains)

    def score(self, features):
        impact = F.array(*[F.lit(0.1 * (i == 5)) for i in range(12)])
        return features.withColumns({
            "probability": F.lit(self.probability),
            "contributions": impact if self.explains else F.lit(None).cast("array<double>"),
        })


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([
        ("fixture", "100", "demo_user", "A complete demo profile", "Melbourne", 365, 500,
         100, 2000, False, False, 23, 9),
        ("fixture", "200", *[None] * 11),
        ("fixture", "007", *[None] * 11),
    ], ACCOUNTS)


def ask(spark, *pairs):
    return spark.createDataFrame(
        [(f"r{i}", p, a, NOW) for i, (p, a) in enumerate(pairs)],
        "request_id string, platform string, account_id string, requested_at timestamp",
    )


def answers(spark, accounts, scorer, *pairs, **kw):
    out = assess(ask(spark, *pairs), accounts, scorer, id_width=8, **kw)
    return [r for r in out.orderBy("request_id").collect()]


def test_scored_request(spark, accounts):
    r, = answers(spark, accounts, FixedScorer(), ("x", "100"))
    assert (r.status, r.platform, r.account_id, r.data_source) == (
        "completed", "x", "100", "dataset")
    assert (r.risk_band, r.recommendation, r.warning) == ("high", "prioritise", TRIAGE_WARNING)
    assert r.risk_probability == 0.82 and r.data_completeness == 1.0
    assert (r.confidence.level, r.confidence.basis) == ("high", "clear_of_decision_thresholds")
    assert r.top_factors[0].evidence == "Posting frequency increased the estimated risk."
    assert len(r.assessment_id) == 13 and r.assessment_id.startswith("asmt_")
    assert r.error is None


def test_rejected_and_insufficient_requests(spark, accounts):
    got = answers(
        spark, accounts, FixedScorer(), ("twitter", "100"), ("x", "999"), ("x", "200"),
        ("x", "abc"), (None, "abc"), ("x", None), ("x", "7"), ("x", "1" * 20),
    )
    codes = [r.error and r.error.code for r in got]
    assert codes == ["invalid_request", "account_not_found", None, "invalid_request",
                     "invalid_request", "invalid_request", "account_not_found",
                     "invalid_request"]
    assert got[0].error.message == "Invalid value for platform."
    assert got[3].error.message == "Invalid value for account_id."
    assert got[4].error.message == "Invalid value for platform."
    assert got[1].error.message == ERROR_MESSAGES["account_not_found"]
    assert not got[0].error.retryable and got[0].assessment_id is None
    r = got[2]
    assert (r.status, r.warning) == ("insufficient_data", INSUFFICIENT_WARNING)
    assert r.risk_probability is None and r.risk_band is None and r.recommendation is None
    assert r.top_factors == [] and r.assessment_id is not None
    assert r.data_completeness == round(2 / 12, 3)


def test_failed_explanation_degrades(spark, accounts):
    r, = answers(spark, accounts, FixedScorer(explains=False), ("x", "100"))
    assert (r.status, r.recommendation) == ("completed_with_warning", "monitor")
    assert r.top_factors == [] and r.warning == EXPLANATION_WARNING
    assert r.risk_probability == 0.82


def test_low_confidence_means_monitor(spark, accounts):
    r, = answers(spark, accounts, FixedScorer(0.75), ("x", "100"))
    assert (r.risk_band, r.confidence.basis) == ("high", "close_to_decision_thresholds")
    assert r.recommendation == "monitor"


def test_unavailable_parts(spark, accounts):
    got = answers(spark, accounts, None, ("x", "100"), ("y", "100"), ("x", "999"))
    assert [r.error.code for r in got] == [
        "model_unavailable", "invalid_request", "model_unavailable"]
    got = answers(spark, None, FixedScorer(), ("x", "100"))
    assert got[0].error.code == "data_adapter_unavailable"
    got = answers(spark, None, None, ("x", "100"))
    assert got[0].error.code == "model_unavailable"


def test_a_score_that_is_not_finite_is_an_error(spark, accounts):
    got = answers(spark, accounts, FixedScorer(float("nan")), ("x", "100"), ("x", "200"))
    assert got[0].error.code == "internal_error" and got[0].status is None
    assert got[1].status == "insufficient_data"


def test_unknown_request_columns_are_refused(spark, accounts):
    with pytest.raises(ValueError, match="Invalid value for note."):
        assess(ask(spark, ("x", "100")).withColumn("note", F.lit(1)), accounts, FixedScorer())


def test_json_bodies(spark, accounts):
    bodies = [
        '{"platform": "x", "account_id": "100"}',
        '{"platform": "x", "account_id": 100}',
        '{"platform": "x", "account_id": "100", "note": 1}',
        '{"account_id": "100"}',
        'not json', None, '["x"]',
        '{"platform": "twitter", "account_id": "abc", "note": 1}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    parsed = read_request_bodies(df)
    got = [r.p for r in parsed.withColumn("p", request_problem(parsed))
           .orderBy("request_id").collect()]
    assert got == [
        None, "Invalid value for account_id.", "Invalid value for note.",
        "Invalid value for platform.", *["The request is invalid."] * 3,
        "Invalid value for platform.",
    ]
    out = assess(parsed, accounts, FixedScorer()).orderBy("request_id").collect()
    assert out[0].status == "completed" and out[2].error.code == "invalid_request"


def test_hot_and_hopeless_keys_give_the_same_answers(spark, accounts, monkeypatch):
    pairs = [("x", ["100", "999", "abc", "200"][i % 4 if i % 3 else 0]) for i in range(120)]
    plain = answers(spark, accounts, FixedScorer(), *pairs)
    from riskweave.operators import assess as module

    seen = []

    def eager_hot(facts, key):
        seen.extend(lookup.hot_keys(facts, key, partitions=4))
        return seen

    monkeypatch.setattr(module, "hot_keys", eager_hot)
    assert answers(spark, accounts, FixedScorer(), *pairs) == plain
    assert seen == ["100"]


def test_hot_keys_own_more_than_an_even_partition(spark):
    df = spark.range(1000).select((F.col("id") % 10 % 4).cast("string").alias("k"))
    rows = df.union(spark.sql("SELECT CAST(NULL AS STRING) UNION ALL SELECT 'x'"))
    demand = lookup.key_demand(rows, "k", F.col("k") != "x")
    assert {r.k: r.row_count for r in demand.collect()} == {
        "0": 300, "1": 300, "2": 200, "3": 200}
    assert lookup.hot_keys(demand, "k", partitions=4) == ["0", "1"]
    assert lookup.hot_keys(demand, "k", partitions=1) == []
    assert lookup.hot_keys(demand.where("false"), "k") == []


def test_thousands_of_hot_keys(spark):
    rows = spark.range(12_000).select(
        F.col("id").cast("string").alias("row"), (F.col("id") % 3000).cast("string").alias("k"))
    demand = lookup.key_demand(rows, "k", F.lit(True))
    hot = lookup.hot_keys(demand, "k", partitions=3001)
    assert len(hot) == 3000
    names = spark.range(3000).select(
        F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("twice"))
    found = lookup.attach(rows, "k", "row", names, "r", hot=hot)
    assert found.where("r.twice = CAST(k AS BIGINT) * 2").count() == 12_000


def test_each_account_is_scored_once(spark, accounts):
    """The account side joins distinct requested ids; requests join decided accounts."""
    plan = assess(ask(spark, ("x", "100")), accounts, FixedScorer())
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and "Python" not in text


# ---- store, overrides -------------------------------------------------------

@pytest.fixture()
def store(spark, tmp_path):
    return FeedbackStore(spark, str(tmp_path / "store")).initialise()


def override(spark, *rows):
    return spark.createDataFrame(
        [(a, label, reason, i) for i, (a, label, reason) in enumerate(rows)],
        "assessment_id string, override_label string, reason_code string, seq int",
    )


def outcomes(df):
    return [r.outcome or r.error.code for r in df.orderBy("seq").collect()]


def test_full_flow(spark, accounts, store, tmp_path):
    requests = ask(spark, ("x", "100"), ("x", "200"), ("y", "1"))
    done = assessment_batch(requests, accounts, FixedScorer(), store,
                            str(tmp_path / "responses"), "b1", id_width=8)
    by_id = {r.request_id: r for r in done.collect()}
    stored = store.assessments().collect()
    # the insufficient one is answered but not recorded
    assert [r.assessment_id for r in stored] == [by_id["r0"].assessment_id]
    assert (stored[0].model_id, stored[0].risk_band, stored[0].status) == (
        "fixture_model", "high", "completed")
    scored, thin = by_id["r0"].assessment_id, by_id["r1"].assessment_id
    asked = override(
        spark, (thin, "uncertain", "manual_review"), (scored, "fine", "ok"),
        (scored, "uncertain", "Not OK"), ("x" * 13, "uncertain", "ok"),
        (scored, "legitimate", "known_official_account"),
        (scored, "uncertain", "manual_review"), ("asmt_00000000", "uncertain", "ok"),
    )
    got = override_batch(asked, store, str(tmp_path / "out"), "o1", ["seq"], id_width=8)
    assert outcomes(got) == [
        "assessment_not_found", "invalid_request", "invalid_request", "invalid_request",
        "recorded", "override_already_recorded", "assessment_not_found",
    ]
    messages = [r.error and r.error.message for r in got.orderBy("seq").collect()]
    assert messages[1:4] == ["Invalid value for override_label.",
                             "Invalid value for reason_code.", "Invalid assessment ID."]
    row, = store.overrides().collect()
    assert (row.override_label, row.reason_code) == ("legitimate", "known_official_account")
    later = override(spark, (scored, "suspicious", "second_look"))
    got = override_batch(later, store, str(tmp_path / "out"), "o2", ["seq"], id_width=8)
    assert outcomes(got) == ["override_already_recorded"]
    assert store.overrides().count() == 1


def test_replayed_batches_leave_one_copy(spark, accounts, store, tmp_path):
    requests = ask(spark, ("x", "100"))
    for _ in range(2):
        assessment_batch(requests, accounts, FixedScorer(), store,
                         str(tmp_path / "responses"), "b1")
    assert store.assessments().count() == 1
    scored = store.assessments().first().assessment_id
    asked = override(spark, (scored, "legitimate", "a"), (scored, "uncertain", "b"))
    for _ in range(2):
        got = override_batch(asked, store, str(tmp_path / "out"), "o1", ["seq"])
        assert outcomes(got) == ["recorded", "override_already_recorded"]
    assert store.overrides().count() == 1


def test_repeated_assessment_ids_are_refused(spark, accounts, store, tmp_path):
    requests = ask(spark, ("x", "100"))
    answered = assess(requests, accounts, FixedScorer())
    rows = to_record(answered, "fixture_model", F.col("requested_at"))
    assert store.append_assessments(rows.union(rows), "b1").count() == 1
    assert store.append_assessments(rows, "b2").count() == 1
    assert store.assessments().count() == 1
    assert store.assessments().first().created_at == NOW


def test_store_is_created_once_and_must_exist(spark, store, tmp_path):
    assert store.ready and store.initialise().assessments().count() == 0
    absent = FeedbackStore(spark, str(tmp_path / "absent"))
    assert not absent.ready
    with pytest.raises(RuntimeError, match="no feedback store"):
        absent.assessments()


def test_without_a_store_nothing_is_scored_or_recorded(spark, accounts, tmp_path):
    absent = FeedbackStore(spark, str(tmp_path / "absent"))
    requests = ask(spark, ("x", "100"), ("x", "200"), ("y", "1"))
    done = assessment_batch(requests, accounts, FixedScorer(), absent,
                            str(tmp_path / "responses"), "b1")
    got = [(r.status, r.error and r.error.code) for r in done.orderBy("request_id").collect()]
    assert got == [(None, "feedback_store_unavailable"), ("insufficient_data", None),
                   (None, "invalid_request")]
    asked = override(spark, ("asmt_" + "0" * 32, "uncertain", "ok"), ("x", "uncertain", "ok"))
    done = override_batch(asked, absent, str(tmp_path / "out"), "o1", ["seq"])
    rows = done.orderBy("seq").collect()
    assert [r.error.code for r in rows] == ["feedback_store_unavailable", "invalid_request"]
    assert rows[0].error.message == "The override could not be recorded safely."
    assert not absent.ready


def test_override_bodies(spark):
    scored = "asmt_" + "0" * 32
    bodies = [
        '{"override_label": "uncertain", "reason_code": "ok", "note": 1}',
        '{"override_label": "uncertain", "reason_code": 5}',
        "nothing",
        '{"override_label": "uncertain", "reason_code": "ok"}',
    ]
    df = spark.createDataFrame([(scored, b, i) for i, b in enumerate(bodies)],
                               "assessment_id string, body string, seq int")
    known = spark.createDataFrame([(scored,)], "assessment_id string")
    decided = decide_overrides(read_override_bodies(df), known, known.limit(0), ["seq"])
    rows = decided.orderBy("seq").collect()
    assert [r.error and r.error.message for r in rows] == [
        "Invalid value for note.", "Invalid value for reason_code.",
        "The request is invalid.", None,
    ]
    assert rows[3].outcome == "recorded" and "extra_fields" not in decided.columns


def test_hot_assessment(spark, monkeypatch):
    from riskweave.operators import overrides as module

    asked = override(spark, *[(f"asmt_{i % 3:08d}", "uncertain", "r") for i in range(60)])
    known = spark.createDataFrame([("asmt_00000000",), ("asmt_00000001",)],
                                  "assessment_id string")
    taken = spark.createDataFrame([("asmt_00000001",)], "assessment_id string")
    plain = outcomes(decide_overrides(asked, known, taken, ["seq"], 8))
    assert plain.count("recorded") == 1 and plain[0] == "recorded"
    assert plain.count("assessment_not_found") == 20
    monkeypatch.setattr(module, "hot_keys",
                        lambda df, key: lookup.hot_keys(df, key, partitions=6))
    assert outcomes(decide_overrides(asked, known, taken, ["seq"], 8)) == plain


# ---- reports ----------------------------------------------------------------

def test_listing(spark):
    rows = [("10", " a ", "s"), ("9", "  ", None), ("100", None, "t")]
    df = spark.createDataFrame(rows, "account_id string, username string, source_dataset string")
    got = [tuple(r) for r in list_accounts(df, 2).collect()]
    assert got == [("10", "s", "a"), ("100", "t", None)]
    response = listing_response(list_accounts(df, 100)).first()
    assert response["count"] == 3 and response.accounts[2].account_id == "9"
    assert "TakeOrderedAndProject" in (
        list_accounts(df, 2)._jdf.queryExecution().executedPlan().toString())
    for limit in (0, 101):
        with pytest.raises(ValueError, match="between 1 and 100"):
            list_accounts(df, limit)
    assert list_accounts(df.select("account_id"), 1).first().username is None


def test_readiness(spark, accounts):
    ok = readiness_report(accounts, True, True, True).first()
    assert (ok.status, ok.model, ok.data_adapter, ok.feedback_store) == (
        "ok", "loaded", "loaded", "ready")
    assert ok.demo_account_count == 3 and ok.missing_artifacts == []
    bad = readiness_report(accounts.limit(0), False, False, True, ["boosted_model"]).first()
    assert (bad.status, bad.model, bad.demo_account_count) == ("degraded", "unavailable", 0)
    assert bad.missing_artifacts == ["boosted_model"]


# ---- nothing is lost ----------------------------------------------------------

def test_rows_that_share_an_id_in_a_batch(spark, store):
    late = NOW + dt.timedelta(seconds=5)
    rows = spark.createDataFrame(
        [("asmt_a", late, "m", "high", "completed"), ("asmt_a", NOW, "m", "low", "completed"),
         ("asmt_b", NOW, "m", "low", "completed")],
        "assessment_id string, created_at timestamp, model_id string, risk_band string, "
        "status string")
    refused = store.append_assessments(rows, "b1").collect()
    assert [(r.assessment_id, r.risk_band) for r in refused] == [("asmt_a", "high")]
    assert {(r.assessment_id, r.risk_band) for r in store.assessments().collect()} == {
        ("asmt_a", "low"), ("asmt_b", "low")}


def test_exactly_one_of_tied_overrides_wins(spark):
    asked = spark.createDataFrame(
        [("asmt_00000000", "uncertain", f"r{i % 2}", 1) for i in range(6)],
        "assessment_id string, override_label string, reason_code string, seq int")
    known = spark.createDataFrame([("asmt_00000000",)], "assessment_id string")
    out = outcomes(decide_overrides(asked, known, known.where("false"), ["seq"], 8))
    assert out.count("recorded") == 1 and out.count("override_already_recorded") == 5


def test_a_corrupt_account_file_is_reported(spark, tmp_path):
    folder = tmp_path / "people"
    spark.createDataFrame([("1",)], "account_id string").coalesce(1).write.parquet(str(folder))
    (folder / "part-broken.parquet").write_bytes(b"no parquet at all")
    source = load_accounts(spark, str(folder))
    assert not source.ready and source.error


def test_overrides_meet_their_assessments_in_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "asked")
    override(spark, *[(f"asmt_{i % 64:08d}", "uncertain", "Bad!" if i % 5 == 0 else "r")
                      for i in range(128)]).write.parquet(path)
    known = spark.range(40).selectExpr("concat('asmt_', lpad(cast(id as string), 8, '0')) assessment_id")
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    decided = decide_overrides(spark.read.parquet(path), known, known.where("false"), ["seq"], 8)
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2      # requests, what is known
    got = outcomes(decided)
    first = {}
    for i in range(128):
        if i % 5:
            first.setdefault(i % 64, i)
    assert got == ["invalid_request" if i % 5 == 0 else "assessment_not_found" if i % 64 >= 40
                   else "recorded" if first[i % 64] == i else "override_already_recorded"
                   for i in range(128)]
