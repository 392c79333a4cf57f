import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from riskweave.operators.assess import assess
from riskweave.operators.overrides import decide_overrides
from riskweave.plans import serving
from riskweave.schemas import REQUESTS
from riskweave.session import stage_path
from riskweave.sources.store import FeedbackStore, _bucket
from riskweave.streaming import intake
from riskweave.streaming.intake import (
    answer_late, assess_stream, dropped_as_late, late_requests, override_stream,
)
from tests.test_serving import ACCOUNTS, NOW, FixedScorer

ITEM = "assessment_id string, override_label string, reason_code string, seq long"


def accounts(spark):
    return spark.createDataFrame([
        ("s", str(i), "n", "d", "Rome", 10, 5, 5, 5, False, False, 1, 1) for i in range(20)
    ], ACCOUNTS)


def requests(spark, first, last):
    rows = [(f"r{i}", "x" if i % 7 else "y", str(i % 25), NOW + dt.timedelta(seconds=i))
            for i in range(first, last)]
    return spark.createDataFrame(rows, REQUESTS)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    people = accounts(spark)

    def start():
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(inbox)
        return run(assess_stream(
            stream, people, FixedScorer(), store, f"{root}/responses", f"{root}/checkpoint",
            created_at=F.col("requested_at"),
        ))

    requests(spark, 0, 40).coalesce(1).write.mode("append").parquet(inbox)
    requests(spark, 40, 70).coalesce(1).write.mode("append").parquet(inbox)
    start()
    # a restart continues where the last run stopped
    requests(spark, 70, 100).coalesce(1).write.mode("append").parquet(inbox)
    start()

    got = spark.read.parquet(f"{root}/responses").drop("batch")
    want = assess(requests(spark, 0, 100), people, FixedScorer())
    order = sorted(want.columns)
    key = lambda r: r.request_id
    assert sorted(got.select(order).collect(), key=key) == sorted(
        want.select(order).collect(), key=key)
    assert spark.read.parquet(f"{root}/responses").select("batch").distinct().count() == 3
    scored = want.where("status = 'completed'").count()
    assert store.assessments().count() == scored
    # a request that is sent again does not add a second record
    requests(spark, 0, 10).coalesce(1).write.mode("append").parquet(inbox)
    start()
    assert store.assessments().count() == scored


def test_earlier_micro_batches_win(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    known = spark.createDataFrame(
        [(f"asmt_{i:032d}", NOW, "m", "low", "completed") for i in range(3)],
        "assessment_id string, created_at timestamp, model_id string, risk_band string, "
        "status string",
    )
    store.append_assessments(known, "seed")

    def send(rows):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(inbox)

    def start():
        stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(inbox)
        run(override_stream(stream, store, f"{root}/outcomes", f"{root}/checkpoint", ["seq"]))

    send([(f"asmt_{i % 4:032d}", "uncertain", f"first_{i}", i) for i in range(8)])
    start()
    send([(f"asmt_{i % 3:032d}", "suspicious", f"second_{i}", i) for i in range(6)])
    start()
    assert {r.reason_code for r in store.overrides().collect()} == {
        "first_0", "first_1", "first_2"
    }
    out = spark.read.parquet(f"{root}/outcomes")
    assert out.count() == 14 and out.where("outcome = 'recorded'").count() == 3
    codes = {r["code"]: r["count"] for r in out.groupBy("error.code").count().collect()}
    assert codes["assessment_not_found"] == 2 and codes["override_already_recorded"] == 9


def test_a_second_stream_replaces_nothing(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    requests(spark, 0, 30).coalesce(1).write.parquet(inbox)
    for name in ("one", "two"):
        stream = spark.readStream.schema(REQUESTS).parquet(inbox)
        run(assess_stream(stream, accounts(spark), FixedScorer(), store, f"{root}/responses",
                          f"{root}/checkpoint-{name}", created_at=F.col("requested_at")))
    answers = spark.read.parquet(f"{root}/responses")
    assert answers.count() == 60 and answers.select("batch").distinct().count() == 2
    stored = store.assessments()
    assert stored.count() == stored.select("assessment_id").distinct().count() > 0


def test_batches_leave_no_staged_tables(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    staged = Path(stage_path(spark, "x")).parent
    for i in range(4):
        requests(spark, 10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(inbox)
    people = accounts(spark)
    before = len(list(staged.iterdir())) if staged.exists() else 0
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    run(assess_stream(stream, people, FixedScorer(), store, f"{root}/responses",
                      f"{root}/checkpoint"))
    after = len(list(staged.iterdir())) if staged.exists() else 0
    assert after == before


def test_recorded_overrides_are_not_read_again(spark, tmp_path, monkeypatch):
    """Claims of earlier micro-batches, runs and batch jobs are state."""
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    known = spark.createDataFrame(
        [(f"asmt_{i:032d}", NOW, "m", "low", "completed") for i in range(6)],
        "assessment_id string, created_at timestamp, model_id string, risk_band string, "
        "status string")
    store.append_assessments(known, "seed")
    earlier = spark.createDataFrame([(f"asmt_{5:032d}", NOW, "uncertain", "by_hand")],
                                    "assessment_id string, created_at timestamp, "
                                    "override_label string, reason_code string")
    store.append_overrides(earlier, "hand")
    read = []
    plain = FeedbackStore._read
    monkeypatch.setattr(FeedbackStore, "_read", lambda self, name, runs, buckets=None: (
        read.append(buckets if runs else set()), plain(self, name, runs, buckets))[1])

    def send(rows):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(inbox)

    def start():
        stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(inbox)
        run(override_stream(stream, store, f"{root}/outcomes", f"{root}/checkpoint", ["seq"]))

    send([(f"asmt_{i:032d}", "uncertain", "first", i) for i in (0, 1, 5)])
    send([(f"asmt_{i:032d}", "suspicious", "second", i) for i in (0, 2, 9)])
    send([("no id", "uncertain", "x", 1), (None, "uncertain", "x", 2)] * 20)
    start()
    send([(f"asmt_{i:032d}", "suspicious", "third", 2 ** 53 + 1) for i in (0, 1, 2, 3)])
    start()
    # nothing but the bucket of the one id that no table has
    strange = spark.createDataFrame([("asmt_" + "9".zfill(32),)], "assessment_id string")
    bucket = strange.select(_bucket(store.buckets)).first()[0]
    assert read and all(buckets is not None and buckets <= {bucket} for buckets in read)
    reasons = {int(r.assessment_id[5:]): r.reason_code for r in store.overrides().collect()}
    assert reasons == {0: "first", 1: "first", 5: "by_hand", 2: "second", 3: "third"}
    out = spark.read.parquet(f"{root}/outcomes")
    codes = {r["code"]: r["count"] for r in out.groupBy("error.code").count().collect()}
    assert codes == {None: 4, "override_already_recorded": 5, "assessment_not_found": 1,
                     "invalid_request": 40}


def test_a_micro_batch_is_decided_some_ids_at_a_time(spark, tmp_path, monkeypatch):
    """Nothing of it is cached, the pieces share no id and leave nothing behind."""
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    known = spark.createDataFrame(
        [(f"asmt_{i:032d}", NOW, "m", "low", "completed") for i in range(40)],
        "assessment_id string, created_at timestamp, model_id string, risk_band string, "
        "status string")
    store.append_assessments(known, "seed")
    store.append_overrides(spark.createDataFrame(
        [(f"asmt_{5:032d}", NOW, "uncertain", "by_hand")],
        "assessment_id string, created_at timestamp, override_label string, "
        "reason_code string"), "hand")

    # ids that repeat, one of them often, unknown ones, ties, and requests with a fault
    ids = [f"asmt_{i % 50:032d}" for i in range(200)] + [f"asmt_{7:032d}"] * 80
    rows = [(key, "uncertain" if i % 9 else "guilty", f"r{i}", i // 3)
            for i, key in enumerate(ids)]
    rows += [(None, "uncertain", "x", 1), ("no id", "uncertain", "x", 2)] * 10
    sent = spark.createDataFrame(rows, ITEM)
    sent.coalesce(4).write.parquet(inbox)
    want = decide_overrides(sent, store.assessments(), store.overrides(), ["seq"]).collect()
    staged = Path(stage_path(spark, "x")).parent
    before = sorted(staged.iterdir())

    asked, cached = [], []

    def spy(requests, *args):
        asked.append([r.assessment_id for r in requests.collect()])
        cached.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return decide_overrides(requests, *args)

    monkeypatch.setattr(serving, "decide_overrides", spy)
    monkeypatch.setattr(intake, "PIECE_ROWS", 60, raising=False)

    def start():
        stream = spark.readStream.schema(ITEM).parquet(inbox)
        run(override_stream(stream, store, f"{root}/outcomes", f"{root}/checkpoint", ["seq"]))

    start()
    assert len(asked) > 2 and sum(map(len, asked)) == len(rows)
    assert sum(len(set(some)) for some in asked) == len({r[0] for r in rows})
    assert all(len(some) <= 60 for some in asked if f"asmt_{7:032d}" not in some)
    assert not any(cached)
    got = spark.read.parquet(f"{root}/outcomes").drop("batch")
    assert sorted(map(str, got.select(*want[0].__fields__).collect())) == sorted(map(str, want))
    assert store.overrides().count() == 40

    # what comes later is known by its packed id; a run without requests has no outcomes
    spark.createDataFrame([(f"asmt_{i:032d}", "uncertain", "late", 999) for i in (3, 5, 45)],
                          ITEM).write.mode("append").parquet(inbox)
    start()
    assert sorted(staged.iterdir()) == before
    store.append_assessments(known.limit(1).withColumn("assessment_id", F.lit("asmt_" + "a" * 32)),
                             "more")
    start()
    out = spark.read.parquet(f"{root}/outcomes")
    assert out.count() == len(rows) + 3 and store.overrides().count() == 40
    assert sorted(r.code for r in out.where("reason_code = 'late'").select(
        "error.code").collect()) == ["assessment_not_found", *["override_already_recorded"] * 2]


def test_overrides_that_come_before_their_assessment(spark, tmp_path):
    """They are refused; a later request is recorded, once."""
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    asked = "asmt_" + "0" * 32
    for n in range(4):
        spark.createDataFrame([(asked, "uncertain", f"r{n}", n)], ITEM).coalesce(
            1).write.mode("append").parquet(inbox)
        if n == 1:
            store.append_assessments(spark.createDataFrame(
                [(asked, NOW, "m", "low", "completed")],
                "assessment_id string, created_at timestamp, model_id string, "
                "risk_band string, status string"), "seed")
        stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(inbox)
        run(override_stream(stream, store, f"{root}/outcomes", f"{root}/checkpoint", ["seq"]))
    assert [r.reason_code for r in store.overrides().collect()] == ["r1"]
    out = spark.read.parquet(f"{root}/outcomes").orderBy("seq").collect()
    assert [r.outcome or r.error.code for r in out] == [
        "assessment_not_found", "recorded", *["override_already_recorded"] * 2]


def test_state_is_in_rocksdb_and_the_setting_is_put_back(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    spark.createDataFrame([("x", "uncertain", "r", 1)], ITEM).write.parquet(inbox)
    stream = spark.readStream.schema(ITEM).parquet(inbox)
    run(override_stream(stream, store, f"{root}/outcomes", f"{root}/checkpoint", ["seq"]))
    assert spark.conf.get(name) == before
    kept = [p.name for p in (tmp_path / "store" / "checkpoint" / "state").rglob("*.zip")]
    changes = [p.name for p in (tmp_path / "store" / "checkpoint" / "state").rglob("*.changelog")]
    assert kept or changes


def test_repeated_and_late_requests(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    store = FeedbackStore(spark, root).initialise()
    people = accounts(spark)

    def send(*pairs):
        rows = [(f"r{i}", "x", "1", NOW + dt.timedelta(seconds=s)) for i, s in pairs]
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(inbox)

    def start():
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(inbox)
        return run(assess_stream(
            stream, people, FixedScorer(), store, f"{root}/responses", f"{root}/checkpoint",
            created_at=F.col("requested_at"), unique_within="60 seconds"))

    send((1, 0), (1, 0), (2, 5))
    start()
    send((1, 10), (3, 200))          # repeated within the time, across a restart
    start()
    send((4, 20), (5, 150), (2, 6))  # r4 and r2 come later than the watermark (140 s)
    dropped = dropped_as_late(start())
    answers = spark.read.parquet(f"{root}/responses")
    assert sorted(r.request_id for r in answers.collect()) == ["r1", "r2", "r3", "r5"]
    assert dropped == 2
    table = spark.read.schema(REQUESTS).parquet(inbox)
    late = answer_late(table, people, FixedScorer(), store, f"{root}/responses", "late",
                       created_at=F.col("requested_at"))
    assert [r.request_id for r in late.collect()] == ["r4"]
    again = late_requests(table, f"{root}/responses")
    assert again.count() == 0
    assert store.assessments().count() == 5
