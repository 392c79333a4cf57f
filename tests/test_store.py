import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from riskweave.sources import store as module
from riskweave.sources.commits import CommitConflict, CommitLog
from riskweave.sources.store import FeedbackStore

NOW = dt.datetime(2024, 5, 1)
SCHEMA = ("assessment_id string, created_at timestamp, model_id string, risk_band string, "
          "status string")


def records(spark, ids, band="low"):
    return spark.createDataFrame(
        [(f"asmt_{i:032d}", NOW, "m", band, "completed") for i in ids], SCHEMA)


def ids_of(rows):
    return sorted(int(r.assessment_id[5:]) for r in rows.collect())


def bucket_of(spark, i):
    return records(spark, [i]).select(module._bucket(module.BUCKETS)).first()[0]


def test_ten_batches_read_only_the_buckets_of_their_keys(spark, tmp_path, monkeypatch):
    store = FeedbackStore(spark, str(tmp_path / "s"), max_runs=100).initialise()
    store.append_assessments(records(spark, range(2000)), "history")
    read = []
    plain = FeedbackStore._read
    monkeypatch.setattr(FeedbackStore, "_read", lambda self, name, runs, buckets=None: (
        read.append(buckets), plain(self, name, runs, buckets))[1])
    for n in range(10):
        mine = [5000 + n, 6000 + n]
        read.clear()
        assert store.append_assessments(records(spark, mine), f"b{n}").count() == 0
        assert read[0] == {bucket_of(spark, i) for i in mine}
        found = store._found("assessments", records(spark, mine))
        touched = {int(f.split("bucket=")[1].split("/")[0]) for f in found.inputFiles()}
        assert touched == {bucket_of(spark, i) for i in mine}
        assert len(found.inputFiles()) < len(store.files("assessments")) / 4
    assert len(ids_of(store.assessments())) == 2020


def test_few_keys_reach_the_files_as_equalities(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s")).initialise()
    store.append_assessments(records(spark, range(500)), "history")
    few = store.assessments_of(records(spark, [3, 7, 900]))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(assessment_id" in plan and "Join" not in plan and ids_of(few) == [3, 7]
    many = store.assessments_of(records(spark, range(300, 700)))
    assert ids_of(many) == list(range(300, 500))


def test_runs_stay_few(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s"), buckets=4, max_runs=3).initialise()
    counts = []
    for n in range(14):
        rows = records(spark, range(10 * n, 10 * n + 12))   # two are repeated
        refused = store.append_assessments(rows, f"b{n}")
        assert ids_of(refused) == ([10 * n, 10 * n + 1] if n else [])
        counts.append(len(store.files("assessments")))
    assert ids_of(store.assessments()) == list(range(142))
    # at most max_runs and the newest batch on a level, two levels, one file a bucket
    assert max(counts) <= 2 * 4 * 4
    state = store._state("assessments")[1]
    assert max(r["level"] for r in state["runs"]) >= 1
    assert {r["batch"] for r in state["runs"] if r["level"]} == {None}


def test_a_merged_batch_written_again_changes_nothing(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s"), buckets=2, max_runs=1).initialise()
    for n in range(4):
        store.append_assessments(records(spark, [n]), f"b{n}")
    again = store.append_assessments(records(spark, [0]), "b0")
    assert again.count() == 0 and ids_of(store.assessments()) == [0, 1, 2, 3]
    other = store.append_assessments(records(spark, [0, 9], "high"), "b9")
    assert ids_of(other) == [0]
    bands = {int(r.assessment_id[5:]): r.risk_band for r in store.assessments().collect()}
    assert bands[0] == "low" and bands[9] == "high"


def test_an_open_batch_written_again_replaces_itself(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s")).initialise()
    store.append_assessments(records(spark, [1, 2]), "a")
    store.append_assessments(records(spark, [3]), "b")
    store.append_assessments(records(spark, [2, 3, 4]), "a")
    assert ids_of(store.assessments()) == [2, 3, 4]
    store.append_assessments(records(spark, []), "a")
    assert ids_of(store.assessments()) == [3]


def test_an_earlier_read_survives_merges(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s"), buckets=2, max_runs=1).initialise()
    store.append_assessments(records(spark, [1]), "a")
    held = store.assessments()
    for n in range(4):
        store.append_assessments(records(spark, [10 + n]), f"b{n}")
    assert ids_of(held) == [1]


def test_old_files_go_in_the_end(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s"), buckets=1, max_runs=1).initialise()
    for n in range(14):
        store.append_assessments(records(spark, [n]), f"b{n}")
    folders = list((tmp_path / "s" / "assessments" / "data").iterdir())
    state = store._state("assessments")[1]
    assert len(folders) == len(state["runs"]) + len(state["retired"])
    assert len(store._log("assessments").versions()) <= 10


def test_null_ids_and_a_key_with_most_rows(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s")).initialise()
    rows = records(spark, [1] * 50 + [2]).union(
        spark.createDataFrame([(None, NOW, "m", "low", "completed")] * 3, SCHEMA))
    refused = store.append_assessments(rows, "a")
    assert refused.count() == 51 and store.assessments().count() == 3


def test_one_of_two_writers_gets_an_error(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.publish(1, {"by": "first"})
    outcomes, start = [], threading.Barrier(6)

    def write(n):
        start.wait()
        try:
            log.publish(2, {"by": n})
            outcomes.append(n)
        except CommitConflict:
            outcomes.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [n for n in outcomes if n is not None]
    assert len(winners) == 1 and len(outcomes) == 6
    assert log.latest() == (2, {"by": winners[0]})
    assert log.versions() == [1, 2]


def test_a_writer_that_lost_can_try_again(spark, tmp_path, monkeypatch):
    store = FeedbackStore(spark, str(tmp_path / "s")).initialise()
    log = CommitLog(spark, f"{tmp_path}/s/assessments/commits")
    plain, raced = FeedbackStore._write, []

    def late(self, *args):
        if not raced:
            raced.append(store._state("assessments"))
            log.publish(raced[0][0] + 1, raced[0][1])
        return plain(self, *args)

    monkeypatch.setattr(FeedbackStore, "_write", late)
    with pytest.raises(CommitConflict):
        store.append_assessments(records(spark, [1]), "a")
    assert store.assessments().count() == 0
    store.append_assessments(records(spark, [1]), "a")
    assert store.assessments().count() == 1


def test_rows_that_are_all_stored_write_no_run(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "s")).initialise()
    store.append_assessments(records(spark, range(50)), "first")
    refused = store.append_assessments(records(spark, range(50), "high"), "second")
    assert ids_of(refused) == list(range(50))
    assert len(list((tmp_path / "s" / "assessments" / "data").glob("run=*"))) == 1
    mixed = records(spark, [49, 50, 51, 51])
    assert ids_of(store.append_assessments(mixed, "third")) == [49, 51]
    assert ids_of(store.assessments()) == list(range(52))
