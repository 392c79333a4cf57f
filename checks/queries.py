"""One query per operator; each reads whole sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixed_score
from riskweave.constants import FEATURES
from riskweave.functions import decisions, ids, numbers, text
from riskweave.operators import (
    assess, explain, features, merge, metrics, models, overrides, preprocess, reports, split,
    thresholds, weights,
)
from riskweave.operators.explain import expected_margin
from riskweave.plans import serving, training
from riskweave.session import stage, stage_path
from riskweave.sources import profiles, registry
from riskweave.sources.accounts import check_accounts, load_accounts
from riskweave.sources.labelled import load_sources
from riskweave.sources.splits import export_csv, read_split, write_demo, write_splits
from riskweave.sources.store import FeedbackStore
from riskweave.streaming import intake

_kept: dict[tuple, object] = {}


def _once(name: str, spark: SparkSession, folder: str, build: Callable):
    """Intermediate results are stored tables or fitted parameters, built once."""
    key = (name, spark.sparkContext.applicationId, folder)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


# ---- shared steps -----------------------------------------------------------

def bronze(spark: SparkSession, folder: str) -> DataFrame:
    return merge.union_sources(profiles.labelled_sources(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return _once("clean", spark, folder,
                 lambda: stage(merge.clean_accounts(bronze(spark, folder)), "clean"))


def split_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return _once("split", spark, folder,
                 lambda: split.stratified_split(clean(spark, folder)))


def split_features(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        rows = features.account_features(
            split_accounts(spark, folder), keep=("account_id", "label", "split")
        )
        return stage(rows, "features", partition_by=("split",))

    return _once("features", spark, folder, build)


def usable_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = split_features(spark, folder)
    return features.usable_accounts(rows.where(F.col("split") == name))


def preprocessor(spark: SparkSession, folder: str) -> preprocess.Preprocessor:
    return _once(
        "preprocessor", spark, folder,
        lambda: preprocess.fit_preprocessor(usable_split(spark, folder, "train")),
    )


def fixed_scorer(spark: SparkSession, folder: str) -> models.LinearScorer:
    def build() -> models.LinearScorer:
        fitted = preprocessor(spark, folder)
        unset = models.LinearScorer(
            model_id=fixed_score.MODEL_ID, preprocessor=fitted,
            thresholds=thresholds.Thresholds(0.3, 0.7),
            coefficients=fixed_score.COEFFICIENTS, intercept=fixed_score.INTERCEPT,
            digits=fixed_score.DIGITS,
        )
        chosen = thresholds.select_risk_thresholds(
            unset.score(usable_split(spark, folder, "validation"))
        )
        return replace(unset, thresholds=chosen)

    return _once("fixed scorer", spark, folder, build)


def scored_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return fixed_scorer(spark, folder).score(usable_split(spark, folder, name))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table that requests are looked up in."""
    return _once("accounts", spark, folder,
                 lambda: stage(profiles.account_table(spark, folder), "accounts"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.requests_from_orders(profiles.table(spark, folder, "orders"))


def override_requests(items: DataFrame) -> DataFrame:
    return profiles.overrides_from_items(
        items, lambda key: ids.assessment_id(key, F.lit(fixed_score.MODEL_ID))
    )


def _flat_factors():
    return F.array_join(
        F.transform("top_factors", lambda f: F.concat_ws(
            ":", f["feature"], f["direction"], f["evidence"]
        )), "|",
    )


def _flat_responses(responses: DataFrame) -> DataFrame:
    return responses.select(
        "request_id", "assessment_id", "status", "platform", "account_id", "data_source",
        "data_completeness", "risk_probability", "risk_band",
        F.col("confidence.level").alias("confidence_level"),
        F.col("confidence.basis").alias("confidence_basis"),
        F.when(F.col("assessment_id").isNotNull(), _flat_factors()).alias("top_factors"),
        "recommendation", "warning",
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
    )


def _flat_outcomes(decided: DataFrame) -> DataFrame:
    return decided.select(
        "assessment_id", "override_label", "reason_code", *profiles.ARRIVAL, "outcome",
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
    )


# ---- cleaning and splitting -------------------------------------------------

def normalise_ids(spark, folder):
    rows = bronze(spark, folder).withColumnRenamed("account_id", "raw_id")
    known = merge.with_identity(rows.withColumn("account_id", F.col("raw_id")))
    return known.select(
        F.col(merge.SOURCE_ORDER).alias("source_order"),
        F.col(merge.ROW_ORDER).alias("row_order"),
        "raw_id", "account_id", "label",
        ids.is_account_id(F.col("account_id")).alias("valid_id"),
        merge.valid_row().alias("valid_row"),
    )


def text_fields(spark, folder):
    docs = profiles.table(spark, folder, "documents")
    n_chars = F.col("n_chars").cast("string")
    return docs.select(
        "doc_id",
        F.md5(text.strip(F.col("text"))).alias("stripped_md5"),
        text.stripped_length(F.col("text")).alias("text_length"),
        text.present(F.col("text")).alias("has_text"),
        text.present(F.col("lang"), unknown_is_missing=True).alias("has_lang"),
        F.md5(text.optional_text(F.col("text"))).alias("optional_md5"),
        numbers.number(n_chars, positive=True).alias("n_chars_number"),
        numbers.flag((F.col("doc_id") % 3).cast("string")).alias("doc_flag"),
        text.missing_to_null(F.col("lang")).alias("lang"),
    )


def line_break_ids(spark, folder):
    """Ids and reason codes with white space after them: no id, no code."""
    key = F.col("c_custkey")
    tail = F.when(key % 3 == 1, "\n").when(key % 3 == 2, " ").otherwise("")
    raw = F.concat(key.cast("string"), tail)
    return profiles.table(spark, folder, "customer").select(
        "c_custkey",
        ids.is_account_id(raw).alias("valid_id"),
        ids.is_reason_code(F.concat(F.lower("c_mktsegment"), tail)).alias("valid_code"),
        ids.normalise_account_id(raw).alias("normalised"),
    )


def union_sources(spark, folder):
    return bronze(spark, folder).withColumnsRenamed(
        {merge.SOURCE_ORDER: "source_order", merge.ROW_ORDER: "row_order"}
    )


def clean_accounts(spark, folder):
    return merge.clean_accounts(bronze(spark, folder))


def cleaning_summary(spark, folder):
    return merge.cleaning_summary(bronze(spark, folder))


def label_conflicts(spark, folder):
    return merge.label_conflicts(bronze(spark, folder))


def repeated_ids(spark, folder):
    return merge.repeated_ids(merge.with_identity(bronze(spark, folder)))


def stratified_split(spark, folder):
    return split_accounts(spark, folder).select("account_id", "label", "split")


def split_counts(spark, folder):
    return features.split_counts(split_features(spark, folder))


def demo_accounts(spark, folder):
    test = split_accounts(spark, folder).where(F.col("split") == "test").drop("split")
    return split.demo_accounts(test)


def _written(spark, folder) -> str:
    """Folder with the split files and the demo accounts."""
    def build() -> str:
        root = stage_path(spark, "generated")
        write_splits(split_accounts(spark, folder), f"{root}/splits")
        test = read_split(spark, f"{root}/splits", "test").drop("split")
        write_demo(split.demo_accounts(test), f"{root}/demo")
        return root

    return _once("written", spark, folder, build)


def written_splits(spark, folder):
    rows = read_split(spark, f"{_written(spark, folder)}/splits")
    return rows.select("account_id", "label", "split", "source_dataset")


def demo_listing(spark, folder):
    demo = load_accounts(spark, f"{_written(spark, folder)}/demo")
    return reports.list_accounts(demo.accounts)


# ---- features and preprocessing ---------------------------------------------

def account_features(spark, folder):
    rows = merge.clean_accounts(bronze(spark, folder))
    out = features.account_features(rows, keep=("account_id", "label"))
    return out.withColumn("completeness", F.bround("completeness", 3))


def csv_features(spark, folder):
    """The same features when the sources arrive as delimited text."""
    root, names = stage_path(spark, "csv"), ["crm", "events"]
    for name, source in zip(names, profiles.labelled_sources(spark, folder)):
        export_csv(source.drop(merge.ROW_ORDER), f"{root}/{name}", ordered=False)
    rows = merge.clean_accounts(merge.union_sources(load_sources(spark, root, names)))
    out = features.account_features(rows, keep=("account_id", "label"))
    return out.withColumn("completeness", F.bround("completeness", 3))


def fallback_features(spark, folder):
    """Accounts that bring ratio, rate and lengths themselves and lack what they are made of."""
    key = F.col("c_custkey")
    rows = profiles.table(spark, folder, "customer").select(
        key.cast("string").alias("account_id"),
        F.when(key % 2 == 0, key).alias("followers_count"),
        F.when(key % 3 == 0, key % 7).alias("following_count"),
        (key % 11).alias("followers_following_ratio"),
        F.when(key % 4 == 0, F.lit(8)).alias("tweet_count"),
        (key % 5).alias("account_age_days"),
        (key / 4).alias("tweets_per_day"),
        F.when(key % 5 != 0, key % 13).alias("description_length"),
        F.when(key % 6 == 0, F.length("c_name")).alias("username_length"),
        F.col("c_name").alias("username"),
        F.lit(None).cast("string").alias("location"),
    )
    out = features.account_features(rows)
    return out.withColumn("completeness", F.bround("completeness", 3))


def feature_completeness(spark, folder):
    rows = features.account_features(profiles.account_table(spark, folder))
    return rows.groupBy("usable").agg(
        F.count("*").alias("account_count"),
        F.count_if(decisions.is_sufficient(F.col("usable"))).alias("sufficient_count"),
        F.bround(F.max("completeness"), 3).alias("completeness"),
    )


def usable_accounts(spark, folder):
    # filter a stored table: on computed features the filter would repeat their work
    return features.usable_accounts(split_features(spark, folder)).select(
        "account_id", "split", "usable"
    )


def prep_parameters(spark, folder):
    frame = preprocessor(spark, folder).to_frame(spark)
    return frame.select("feature", *[F.round(c, 9).alias(c) for c in ("fill", "mean", "std")])


def prep_transform(spark, folder):
    rows = preprocessor(spark, folder).transform(split_features(spark, folder))
    # adding zero turns a rounded -0.0 into 0.0
    return rows.select(
        "account_id", "split", *[(F.round(f, 9) + 0.0).alias(f) for f in FEATURES]
    )


def class_weights(spark, folder):
    return weights.class_weights(usable_split(spark, folder, "train"))


# ---- scores, cut-offs and metrics -------------------------------------------

def fixed_scores(spark, folder):
    rows = fixed_scorer(spark, folder).score(split_features(spark, folder))
    return rows.select("account_id", "split", "probability")


def threshold_grid_costs(spark, folder):
    costs = thresholds.grid_costs(scored_split(spark, folder, "validation"))
    return costs.select(
        "medium", "high", "scored_rows",
        F.round("mean_cost", 9).alias("mean_cost"), F.round("recall", 9).alias("recall"),
    )


def risk_thresholds(spark, folder):
    return thresholds.best_pair(
        thresholds.grid_costs(scored_split(spark, folder, "validation"))
    )


def classification_report(spark, folder):
    scorer = fixed_scorer(spark, folder)
    report = metrics.classification_report(
        scored_split(spark, folder, "test"), scorer.thresholds.medium
    )
    return report.select(
        "threshold", "tn", "fp", "fn", "tp",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
    )


def roc_auc(spark, folder):
    rows = fixed_scorer(spark, folder).score(split_features(spark, folder))
    return metrics.roc_auc(rows).select(F.round("roc_auc", 9).alias("roc_auc"))


# ---- decisions --------------------------------------------------------------

def _decided(spark, folder) -> DataFrame:
    return assess.assess_accounts(accounts(spark, folder), fixed_scorer(spark, folder))


def risk_bands(spark, folder):
    return _decided(spark, folder).select(
        "account_id", "status", "data_completeness", "risk_probability", "risk_band"
    )


def confidence(spark, folder):
    return _decided(spark, folder).select(
        "account_id", F.col("confidence.level").alias("level"),
        F.col("confidence.basis").alias("basis"),
    )


def recommendations(spark, folder):
    return _decided(spark, folder).groupBy("risk_band", "recommendation", "warning").agg(
        F.count("*").alias("account_count")
    )


def top_factors(spark, folder):
    # no filter on the score: it would be pushed down and work out the score twice
    return _decided(spark, folder).select(
        "account_id", _flat_factors().alias("top_factors")
    )


def _responses(spark, folder) -> DataFrame:
    return assess.assess(
        requests(spark, folder), accounts(spark, folder),
        fixed_scorer(spark, folder),
    )


def assess_batch(spark, folder):
    return _flat_responses(_responses(spark, folder))


def assess_without_model(spark, folder):
    answers = assess.assess(
        requests(spark, folder), accounts(spark, folder), None
    )
    return _flat_responses(answers).select("request_id", "error_code", "error_message")


def assess_without_accounts(spark, folder):
    answers = assess.assess(requests(spark, folder), None, fixed_scorer(spark, folder))
    return _flat_responses(answers).select("request_id", "error_code", "error_message")


def assess_without_store(spark, folder):
    """Scores that cannot be recorded are errors; insufficient accounts are answered."""
    answers = assess.assess(
        requests(spark, folder), accounts(spark, folder), fixed_scorer(spark, folder),
        store_ready=False,
    )
    return _flat_responses(answers).select(
        "request_id", "status", "error_code", "error_message")


class Unexplained(models.LinearScorer):
    """A scorer whose explanation is not available."""

    def _explained(self, df):
        return df.withColumn("contributions", F.lit(None).cast("array<double>"))


def degraded_scores(spark, folder):
    scorer = fixed_scorer(spark, folder)
    silent = Unexplained(**{f.name: getattr(scorer, f.name) for f in fields(scorer)})
    return assess.assess_accounts(accounts(spark, folder), silent).select(
        "account_id", "status", "risk_probability", "risk_band", "recommendation", "warning",
        F.size(F.coalesce("top_factors", F.array())).alias("factor_count"),
    )


class BrokenLeaves(models.LinearScorer):
    """A scorer whose explanation fails in its tasks: a leaf names a feature there is not."""

    def _explained(self, df):
        leaf = explain.LeafTable(features=(99,), above=np.array([0.0]), upto=np.array([1.0]),
                                 shares=np.zeros((2, 1)), expected=0.0)
        return df.withColumn("contributions", explain.contribution_column([leaf], FEATURES))


class Unfinished(models.LinearScorer):
    """A scorer without a finite score for every fifth account id."""

    def score(self, features):
        lost = F.col("account_id").cast("bigint") % 5 == 2
        return super().score(features).withColumn("probability", F.when(
            lost, F.lit(float("nan"))).otherwise(F.col("probability")))


def _as(kind, spark, folder):
    scorer = fixed_scorer(spark, folder)
    return kind(**{f.name: getattr(scorer, f.name) for f in fields(scorer)})


def failed_explanations(spark, folder):
    """An explanation that fails while tasks run leaves the scores."""
    decided = assess.assess_accounts(accounts(spark, folder), _as(BrokenLeaves, spark, folder))
    return decided.select(
        "account_id", "status", "risk_probability", "risk_band", "recommendation", "warning",
        F.size(F.coalesce("top_factors", F.array())).alias("factor_count"))


def failed_scores(spark, folder):
    """Requests for accounts whose score fails are answered with ``internal_error``."""
    answers = assess.assess(requests(spark, folder), accounts(spark, folder),
                            _as(Unfinished, spark, folder))
    return _flat_responses(answers).select(
        "request_id", "status", "risk_band", "error_code", "error_message")


def _message(call: Callable) -> str:
    try:
        call()
    except Exception as exc:
        return f"{type(exc).__name__}: {exc}"
    return "fine"


def argument_checks(spark, folder):
    """What jobs say to arguments and tables that they do not take, with the tables' size."""
    source = profiles.labelled_sources(spark, folder)[0]
    people = profiles.account_table(spark, folder)
    said = {
        "required": _message(lambda: merge.union_sources([source.drop("label", "account_id")])),
        "labelled": str(check_accounts(source).error),
        "without_id": str(check_accounts(people.drop("account_id")).error),
        "repeated": str(check_accounts(people.unionByName(people)).error),
        "limit_0": _message(lambda: reports.list_accounts(people, 0)),
        "limit_100": _message(lambda: reports.list_accounts(people, 100)),
        "limit_101": _message(lambda: reports.list_accounts(people, 101)),
        "extra_column": _message(lambda: assess.check_request_columns(
            requests(spark, folder).withColumn("note", F.lit(1)))),
        "private": _message(lambda: write_demo(source, stage_path(spark, "private"))),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).alias("said"))
                               for k, v in said.items()]))
    return people.agg(F.count("*").alias("account_count")).select(
        "account_count", rows.alias("r")).select("account_count", "r.*")


def registered_counts(spark, folder):
    """The report on the trained model, but for what its scores decide."""
    metadata = registry.read_metadata(spark, f"{_trained(spark, folder)}/artifacts")
    return registry.training_summary(metadata).select(
        "clean_account_count", F.col("model_id").startswith("gbt_").alias("named"),
        (F.col("thresholds.medium") < F.col("thresholds.high")).alias("ordered"))


def parse_requests(spark, folder):
    """Requests as JSON bodies: some ids are numbers, some bodies have a field too many."""
    key = F.col("request_id").cast("bigint")
    body = F.concat(
        F.lit('{"platform":"'), F.col("platform"), F.lit('","account_id":'),
        F.when(key % 19 == 0, F.lit("12")).otherwise(
            F.concat(F.lit('"'), F.col("account_id"), F.lit('"'))
        ),
        F.when(key % 23 == 0, F.lit(',"note":"hello"')).otherwise(F.lit("")),
        F.lit("}"),
    )
    bodies = requests(spark, folder).select("request_id", body.alias("body"))
    parsed = assess.read_request_bodies(bodies)
    return parsed.select(
        "request_id", "platform", "account_id",
        assess.request_problem(parsed).alias("problem"),
    )


def recorded_assessments(spark, folder):
    scorer = fixed_scorer(spark, folder)
    return assess.to_record(_responses(spark, folder), scorer.model_id).drop("created_at")


def _shared_store(spark, folder) -> FeedbackStore:
    """One store for the queries that only read it."""
    return _once("store", spark, folder, lambda: _stored_assessments(spark, folder))


def _stored_assessments(spark, folder) -> FeedbackStore:
    """A new store holding the assessments of all requests."""
    root = stage_path(spark, "store")
    store = FeedbackStore(spark, root).initialise()
    serving.assessment_batch(
        requests(spark, folder), accounts(spark, folder),
        fixed_scorer(spark, folder), store, f"{root}/responses", "requests",
        created_at=serving.request_time(),
    )
    return store


def repeated_assessments(spark, folder):
    """Records the store refuses when the same requests come in a second batch."""
    store = _stored_assessments(spark, folder)
    return store.append_assessments(store.assessments(), "again").select(
        "assessment_id", "risk_band", "status"
    )


def duplicate_assessments(spark, folder):
    """Records the store refuses when a batch has every record twice."""
    rows = _shared_store(spark, folder).assessments()
    store = FeedbackStore(spark, stage_path(spark, "store")).initialise()
    refused = store.append_assessments(rows.union(rows), "twice")
    return refused.join(store.assessments().select("assessment_id"), "assessment_id").select(
        "assessment_id", "risk_band", "status")


def tied_overrides(spark, folder):
    """Arrivals that tie in the ship date alone: exactly one override is recorded."""
    store = _shared_store(spark, folder)
    decided = overrides.decide_overrides(
        override_requests(profiles.table(spark, folder, "lineitem")), store.assessments(),
        store.overrides(), ["l_shipdate"])
    return decided.groupBy("assessment_id").agg(
        F.count("*").alias("request_count"),
        F.count_if(F.col("outcome") == "recorded").alias("recorded_count"))


def bad_overrides(spark, folder):
    """Labels and assessment ids that no override may have."""
    line = F.col("l_linenumber")
    rows = override_requests(profiles.table(spark, folder, "lineitem")).withColumns({
        "override_label": F.when(line % 3 == 0, "guilty").otherwise(F.col("override_label")),
        "assessment_id": F.when(line % 4 == 0, F.substring("assessment_id", 1, 20))
        .otherwise(F.col("assessment_id")),
    })
    return rows.select(*profiles.ARRIVAL, "assessment_id",
                       overrides.override_problem(rows, 32).alias("problem"))


def override_intake(spark, folder):
    store = _shared_store(spark, folder)
    items = profiles.table(spark, folder, "lineitem")
    return _flat_outcomes(overrides.decide_overrides(
        override_requests(items), store.assessments(), store.overrides(), profiles.ARRIVAL
    ))


def recorded_overrides(spark, folder):
    store = _stored_assessments(spark, folder)
    items = profiles.table(spark, folder, "lineitem")
    serving.override_batch(
        override_requests(items), store, f"{store.root}/outcomes", "items",
        profiles.ARRIVAL, created_at=F.col("l_shipdate"),
    )
    return store.overrides().drop("created_at")


def list_accounts(spark, folder):
    return reports.list_accounts(profiles.account_table(spark, folder), 100)


def listing_response(spark, folder):
    listing = reports.listing_response(
        reports.list_accounts(profiles.account_table(spark, folder), 100))
    return listing.select("count", F.array_join("accounts.account_id", ",").alias("account_ids"))


def degraded_readiness(spark, folder):
    report = reports.readiness_report(accounts(spark, folder), False, True, False,
                                      registry.REQUIRED)
    return report.withColumn("missing_artifacts", F.array_join("missing_artifacts", ","))


def readiness_report(spark, folder):
    source = check_accounts(accounts(spark, folder))
    store = _shared_store(spark, folder)
    scorer = fixed_scorer(spark, folder)
    report = reports.readiness_report(
        source.accounts, scorer is not None, source.ready, store.ready
    )
    return report.withColumn("missing_artifacts", F.array_join("missing_artifacts", ","))


# ---- streams ----------------------------------------------------------------

def _table_stream(spark, folder, name) -> DataFrame:
    schema = profiles.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}*.parquet")


def assess_stream(spark, folder):
    root = stage_path(spark, "assess-stream")
    store = FeedbackStore(spark, root).initialise()
    stream = profiles.requests_from_orders(_table_stream(spark, folder, "orders"))
    query = intake.assess_stream(
        stream, accounts(spark, folder),
        fixed_scorer(spark, folder), store, f"{root}/responses", f"{root}/checkpoint",
    )
    query.awaitTermination()
    return _flat_responses(spark.read.parquet(f"{root}/responses"))


def stream_restart(spark, folder):
    """Two streams of several micro-batches over the same requests: both answer all of them."""
    root = stage_path(spark, "restart")
    store = FeedbackStore(spark, root).initialise()
    wanted = requests(spark, folder)
    wanted.repartition(3).write.parquet(f"{root}/inbox")
    for name in ("first", "second"):
        stream = spark.readStream.schema(wanted.schema).option("maxFilesPerTrigger", 1)
        intake.assess_stream(
            stream.parquet(f"{root}/inbox"), accounts(spark, folder),
            fixed_scorer(spark, folder), store, f"{root}/responses",
            f"{root}/checkpoint-{name}", created_at=serving.request_time(),
        ).awaitTermination()
    answers = spark.read.parquet(f"{root}/responses")
    kept = store.assessments().groupBy("assessment_id").agg(F.count("*").alias("record_count"))
    return (
        answers.groupBy("request_id", "assessment_id").agg(F.count("*").alias("answer_count"))
        .join(kept, "assessment_id", "left")
        .select("request_id", "answer_count",
                F.coalesce("record_count", F.lit(0).cast("long")).alias("record_count"))
    )


def override_stream(spark, folder):
    store = _stored_assessments(spark, folder)
    stream = override_requests(_table_stream(spark, folder, "lineitem"))
    query = intake.override_stream(
        stream, store, f"{store.root}/outcomes", f"{store.root}/checkpoint",
        profiles.ARRIVAL,
    )
    query.awaitTermination()
    return _flat_outcomes(spark.read.parquet(f"{store.root}/outcomes"))


def repeated_and_late_requests(spark, folder):
    """Requests in three waves, some repeated in the next wave, some a wave too late: each is
    answered once, by the stream or afterwards."""
    root = stage_path(spark, "waves")
    store = FeedbackStore(spark, root).initialise()
    key, day = F.col("request_id").cast("bigint"), F.unix_seconds(F.col("requested_at").cast("timestamp"))
    wanted = stage(requests(spark, folder).withColumn("_day", day), "requests")
    low, high = wanted.agg(F.min("_day"), F.max("_day")).first()
    home = F.when(F.col("_day") < low + (high - low) // 3, 0).when(
        F.col("_day") < low + 2 * ((high - low) // 3), 1).otherwise(2)
    first = F.when(key % 11 == 0, 2).otherwise(home)
    waves = wanted.withColumn("_wave", F.explode(F.when(
        key % 7 == 0, F.array(first, F.least(first + 1, F.lit(2)))).otherwise(F.array(first))))
    for wave in range(3):
        waves.where(F.col("_wave") == wave).drop("_wave", "_day").write.mode("append").parquet(
            f"{root}/inbox")
        intake.assess_stream(
            spark.readStream.schema(requests(spark, folder).schema).parquet(f"{root}/inbox"),
            accounts(spark, folder), fixed_scorer(spark, folder), store, f"{root}/responses",
            f"{root}/checkpoint", created_at=serving.request_time(), unique_within="30 days",
        ).awaitTermination()
    inbox = spark.read.parquet(f"{root}/inbox")
    intake.answer_late(inbox, accounts(spark, folder), fixed_scorer(spark, folder), store,
                       f"{root}/responses", "late", created_at=serving.request_time())
    return spark.read.parquet(f"{root}/responses").groupBy("request_id").agg(
        F.count("*").alias("answer_count"), F.max(F.col("batch") == "late").alias("late"))


# ---- fitted models ----------------------------------------------------------

def _trained(spark, folder) -> str:
    """Folder of the artifacts of a training run over the whole tables."""
    def build() -> str:
        root = stage_path(spark, "model")
        training.train(
            profiles.labelled_sources(spark, folder), f"{root}/artifacts",
            f"{root}/generated", source_names=("crm", "events"),
        )
        return root

    return _once("trained", spark, folder, build)


def _boosted(spark, folder) -> models.BoostedScorer:
    loaded = registry.load_model(spark, f"{_trained(spark, folder)}/artifacts")
    if not loaded.ready:
        raise RuntimeError(loaded.error)
    return loaded.scorer


def baseline_scores(spark, folder):
    train_rows = usable_split(spark, folder, "train")
    fitted = preprocessor(spark, folder)
    model = models.fit_baseline(fitted.transform(train_rows), weights.class_counts(train_rows))
    rows = models.predict(model, fitted.transform(split_features(spark, folder)))
    return rows.select("account_id", "split", "label", "probability")


def boosted_scores(spark, folder):
    rows = _boosted(spark, folder).score(split_features(spark, folder))
    return rows.select("account_id", "split", "label", "probability")


def boosted_top_factors(spark, folder):
    decided = assess.assess_accounts(accounts(spark, folder), _boosted(spark, folder))
    return decided.select(
        "account_id", "status", "risk_band", _flat_factors().alias("top_factors")
    )


def boosted_assess_batch(spark, folder):
    return _flat_responses(assess.assess(
        requests(spark, folder), accounts(spark, folder),
        _boosted(spark, folder),
    ))


def baseline_gradient(spark, folder):
    """Slope of the linear objective at the fitted optimum, per coefficient and intercept."""
    train_rows = usable_split(spark, folder, "train")
    counts = weights.class_counts(train_rows)
    rows = preprocessor(spark, folder).transform(train_rows)
    model = models.fit_baseline(rows, counts)
    n = counts.negative + counts.positive
    scored = models.predict(model, rows).withColumn(
        "pull", counts.balanced_weight(F.col("label")) * (F.col("probability") - F.col("label")))
    slopes = scored.agg(
        F.avg("pull").alias("intercept"), *[F.avg(F.col("pull") * F.col(f)).alias(f)
                                            for f in FEATURES])
    held = dict(zip(FEATURES, (float(v) for v in model.coefficients)))
    return slopes.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("term"),
                 (F.abs(F.col(f) + F.lit(held.get(f, 0.0) / n)) < 1e-5).alias("flat"))
        for f in ("intercept", *FEATURES)])).alias("t")).select("t.*")


def boosted_additivity(spark, folder):
    """Contributions and base add up to the log-odds of every account's score."""
    scorer = _boosted(spark, folder)
    base = expected_margin(scorer.leaves)
    rows = scorer.score(features.account_features(accounts(spark, folder)))
    total = F.aggregate("contributions", F.lit(base), lambda a, x: a + x)
    odds = F.log(F.col("probability") / (1 - F.col("probability")))
    return rows.select("account_id", (F.abs(total - odds) < 1e-6).alias("adds_up"))


def boosted_shape(spark, folder):
    """Size of the saved ensemble, and its output columns as they were fitted."""
    model = _boosted(spark, folder).model
    saved = registry.artifact_path(f"{_trained(spark, folder)}/artifacts", registry.MODEL,
                                   _boosted(spark, folder).model_id)
    nodes = spark.read.parquet(f"{saved}/data")
    trees = nodes.groupBy("treeID").agg(F.max("nodeData.id").alias("last_node"))
    shape = trees.agg(F.count("*").alias("tree_count"),
                      (F.max("last_node") < 2 ** 5 - 1).alias("depth_kept"))
    steps = sorted({round(w, 12) for w in model.treeWeights[1:]})
    return shape.select(
        "tree_count", "depth_kept", F.lit(float(model.treeWeights[0])).alias("first_weight"),
        F.lit(str(steps)).alias("other_weights"), F.lit(model.getPredictionCol()).alias("predicted"),
        F.lit(model.getRawPredictionCol()).alias("raw"),
        F.lit(model.getProbabilityCol()).alias("probability"))


def metric_totals(spark, folder):
    """Rows that the confusion counts of both models add up to."""
    found = model_metrics(spark, folder)
    counts = F.split(F.regexp_replace("confusion", "[\\[\\] ]", ""), ",")
    return found.select("model", F.aggregate(
        counts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("row_count"))


def model_metrics(spark, folder):
    metadata = registry.read_metadata(spark, f"{_trained(spark, folder)}/artifacts")
    return metadata.select(F.expr(
        "stack(2, 'baseline', metrics.baseline_test, 'boosted', metrics.boosted_test)"
        " AS (model, m)"
    )).select("model", "m.threshold", "m.f1", "m.precision", "m.recall", "m.roc_auc",
              F.flatten("m.confusion_matrix").cast("string").alias("confusion"))


def train_report(spark, folder):
    metadata = registry.read_metadata(spark, f"{_trained(spark, folder)}/artifacts")
    return registry.training_summary(metadata).select(
        "model_id", "clean_account_count", "thresholds.medium", "thresholds.high",
        "thresholds.validation_mean_cost",
    )


def training_cleaning(spark, folder):
    """What the training job registered about cleaning and splitting."""
    metadata = registry.read_metadata(spark, f"{_trained(spark, folder)}/artifacts")
    return metadata.select(
        "cleaning.*",
        *[F.col("split_counts")[s].alias(f"{s}_count")
          for s in ("train", "validation", "test")],
        *[F.col("below_completeness_threshold_removed")[s].alias(f"{s}_removed")
          for s in ("train", "validation", "test")],
    )


# what several queries build on, in the order of dependence
SHARED_STEPS: dict[str, Callable[[SparkSession, str], object]] = {
    "clean": clean, "split": split_accounts, "features": split_features,
    "preprocessor": preprocessor, "fixed_scorer": fixed_scorer, "accounts": accounts,
    "written": _written, "store": _shared_store, "train_full": _trained,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        # cleaning and splitting
        normalise_ids, line_break_ids, text_fields, union_sources, clean_accounts, cleaning_summary,
        label_conflicts, repeated_ids, stratified_split, split_counts, demo_accounts,
        written_splits, demo_listing,
        # features and preprocessing
        account_features, csv_features, fallback_features, feature_completeness, usable_accounts,
        prep_parameters, prep_transform, class_weights,
        # scores, cut-offs and metrics
        fixed_scores, threshold_grid_costs, risk_thresholds, classification_report,
        roc_auc,
        # decisions, store and reports
        risk_bands, confidence, recommendations, top_factors, assess_batch,
        assess_without_model, assess_without_accounts, assess_without_store, degraded_scores,
        failed_explanations, failed_scores, argument_checks, registered_counts,
        parse_requests, recorded_assessments, repeated_assessments, duplicate_assessments,
        override_intake, tied_overrides, bad_overrides, recorded_overrides, list_accounts,
        listing_response, readiness_report, degraded_readiness,
        # streams
        assess_stream, override_stream, stream_restart, repeated_and_late_requests,
        # fitted models
        baseline_scores, boosted_scores, boosted_top_factors, boosted_assess_batch,
        model_metrics, train_report, training_cleaning, baseline_gradient,
        boosted_additivity, boosted_shape, metric_totals,
    )
}
