import hashlib
import random
import time

import duckdb
import numpy as np
import pytest
import xxhash

from checks.compare import difference
from riskweave.llm import chat_events as C
from riskweave.llm import queries as Q

EVENTS = "conv_id long, turn long, message long, seq long, kind string, role string, text string"


def brute(events):
    """Fold one conversation's events by their sequence, keeping everything."""
    messages = {}
    for e in sorted(events, key=lambda e: (e[3], e[4], e[6] or "")):
        _, turn, message, _, kind, role, text = e
        if kind != "delta":
            for key in [k for k in messages if k[0] > turn]:
                del messages[key]
        old = messages.get((turn, message), (None, ""))[1]
        new = {"delta": old + (text or ""), "edit": text or "", "regenerate": ""}[kind]
        messages[turn, message] = (role or "", new)
    return [messages[k] for k in sorted(messages)]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_fold_equals_brute_force(spark):
    rng = random.Random(3)
    logs, events = {}, []
    for conv in range(60):
        rows = []
        for seq in range(rng.randrange(1, 30)):
            turn = rng.randrange(5)
            kind = rng.choice(["delta"] * 6 + ["edit", "regenerate"])
            text = rng.choice(["a", "b ", "</s>", "[INST]", "<\\s>", None, "é🙂", "\n"])
            rows.append((conv, turn, 0, seq, kind, rng.choice(["user", "assistant"]), text))
        logs[conv] = rows
        events += rows
    rng.shuffle(events)
    pieces = C.fold(spark.createDataFrame(events, EVENTS)).cache()
    found = {r["conv_id"]: r for r in C.read_back(pieces).collect()}
    for conv, rows in logs.items():
        turns = brute(rows)
        learned = "".join(t for r, t in turns if r == "assistant")
        got = found[conv]
        assert (got["n_turns"], got["turns_sha256"]) == (len(turns), digest(turns))
        assert got["loss_chars"] == len(learned)
        assert got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got["formatted_chars"] == sum(len(C.render(r, t)[0]) for r, t in turns)


def test_escape_is_undone_exactly():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "<s>", "</s>", " ", "x"])
                       for _ in range(rng.randrange(12)))
        shown = C.escape(text)
        assert C.unescape(shown) == text
        assert not any(mark in shown for mark in ("<s>", "</s>", "[INST]", "[/INST]"))
        assert C.parse(C.render(text, text)[0] * 2) == [(text, text)] * 2


def test_odd_rows(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "y"), (1, 1, "assistant", "same", "x"),
            (1, 1, "assistant", "same", "x"), (1, 1, "assistant", "other", "x"),
            (None, None, "user", "</s>" * 30_000, "x"), (2, 5, "tool [/INST]\n", "", "x")]
    table = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, message string")
    found = {r["conv_id"]: r for r in C.read_back(C.fold(C.as_events(table))).collect()}
    key = lambda t: np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64)
    tied = sorted(["other", "same", "same"], key=key)
    assert found[1]["turns_sha256"] == digest(
        [("", ""), ("", ""), *(("assistant", t) for t in tied)])
    assert found[1]["loss_chars"] == 13
    assert found[None]["turns_sha256"] == digest([("user", "</s>" * 30_000)])
    assert found[2]["turns_sha256"] == digest([("tool [/INST]\n", "")])
    none = C.as_events(table.where("false"))
    assert C.read_back(C.fold(none)).collect() == []


def test_tied_and_null_turns_equal_the_sql(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", "a", "B", "b", "same", "other", "é", "🙂", "\uffff", "</s>[INST]", "x" * 600,
             "x" * 600 + "a", "x" * 599 + "y", None]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([0, 1, 1, None]),
             rng.choice(["user", "assistant", "assistant", None]), rng.choice(texts))
            for _ in range(400)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM "
                f"read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    name = "op8_chat_formatting"
    assert difference(Q.QUERIES[name](spark, str(tmp_path)), con, Q.ORACLE[name]) is None


def test_a_long_conversation_is_streamed(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(30_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found, = C.read_back(C.fold(C.as_events(table))).collect()
    assert found["n_turns"] == 30_000
    assert found["turns_sha256"] == digest([(r, t) for _, _, r, t in rows])


def test_unknown_events_are_an_error(spark):
    log = spark.createDataFrame([(1, 0, 0, 0, "undo", "user", "x")], EVENTS)
    with pytest.raises(Exception, match="Unknown kind"):
        C.fold(log).collect()


def test_large_turn_numbers(spark):
    """Times in milliseconds, and the ends of what a number may be."""
    turns = [-(1 << 63), 1_700_000_000_000, 1_700_000_000_001, (1 << 63) - 1]
    rows = spark.createDataFrame(
        [(1, t, "assistant", f"text {i} " * 100) for i, t in enumerate(turns)],
        "conv_id long, turn long, role string, text string")
    events = C.as_events(C.in_order(rows), order_col="place")
    got = C.read_back(C.fold(events)).first()
    text = "".join(f"text {i} " * 100 for i in range(4))
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_a_message_of_many_megabytes(spark):
    """Cutting takes time in proportion to the text; two- and four-byte characters stay whole."""
    for text in ("é" * 8_000_000, "ab🙂\n" * 2_000_000, "x" * 257):
        rows = spark.createDataFrame([(1, 0, "assistant", text)],
                                     "conv_id long, turn long, role string, text string")
        events = C.as_events(C.in_order(rows), order_col="place")
        start = time.monotonic()
        got = C.read_back(C.fold(events)).first()
        assert time.monotonic() - start < 60
        assert got["loss_chars"] == len(text)
        assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_parts_are_of_the_length_asked_for(spark):
    rows = spark.createDataFrame([(1, 0, "user", "é🙂" * 5), (1, 1, "user", "")],
                                 "conv_id long, turn long, role string, text string")
    events = C.as_events(rows, delta_chars=4).orderBy("turn", "seq").collect()
    assert [r["text"] for r in events] == ["é🙂é🙂", "é🙂é🙂", "é🙂", ""]
    assert [int(r["seq"]) for r in events] == [0, 1, 2, 1 << 24]
