import random
import zlib

import numpy as np
import pytest
import xxhash

from riskweave.llm import toxicity as X

from .conftest import TEXTS


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randrange(2, 8)))
    rude = ("vexmorlu", "vexmorda", "grolnak")
    docs, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(rude))
        docs.append((i, " ".join(text), "label", 0.5))
        labels.append((i, int(toxic), "x"))
    return (spark.createDataFrame(docs, "doc_id long, text string, fold string, score double"),
            spark.createDataFrame(labels, "doc_id long, toxic int, text string"), labels)


def test_held_out_rows_are_told_apart(labelled):
    docs, labels, truth = labelled
    found = {r["doc_id"]: r for r in X.toxicity_scores(docs, labels).collect()}
    assert len(found) == 900
    held = [(found[i]["score"], y, found[i]["predicted"]) for i, y, _ in truth
            if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
               for i, *_ in truth)
    toxic, clean = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert auc > 0.97 and sum(p == y for _, y, p in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
               for r in found.values())


def test_held_out_labels_are_not_learned_from(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn("toxic", (X.fold(labels["doc_id"]) == 0).cast("int")
                               .bitwiseXOR(labels["toxic"]))
    a, b = (sorted(map(tuple, X.toxicity_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_rejection_keeps_clean_rows(labelled):
    docs, labels, truth = labelled
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i in ids for i, y, _ in truth if not y) > 0.97 * sum(not y for _, y, _ in truth)
    assert sum(i in ids for i, y, _ in truth if y) < 0.1 * sum(y for _, y, _ in truth)


def test_odd_rows_and_missing_labels(spark, edge_docs, no_docs, labelled):
    _, labels, _ = labelled
    none = labels.where("false")
    assert {r["score"] for r in X.toxicity_scores(edge_docs, none).collect()} == {0.0}
    assert X.toxicity_scores(edge_docs, none).count() == len(TEXTS)
    assert X.toxicity_scores(no_docs, labels).collect() == []
    mixed = spark.createDataFrame(
        [(1, 1), (2, 0), (3, None), (None, 1), (7, 1), (8, 0), (8, 1), (9, 7), (10, 0), (11, 1),
         (12, 0)], "doc_id long, toxic int")
    found = X.toxicity_scores(edge_docs, mixed).collect()
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert X.drop_toxic(edge_docs, mixed).columns == edge_docs.columns


def test_features():
    make = X.feature_maker({"idio": 4.0, "idiot|": 5.0})
    names = dict(zip(X.FEATURES, make("YOU are an 1d10t, an IDIOT!! sooo")))
    assert names["hits"] == 2 and names["top_weight"] == 5.0 and names["distinct_hits"] == 1
    assert names["hits_near_second_person"] > 0 and names["disguised_hits"] > 0
    assert names["shouted_words"] > 0 and names["stretched"] > 0 and names["exclamations"] > 0
    assert make("") == [0.0] * len(X.FEATURES)
    once, long = make("idiot word "), make("idiot word " * 300_000)
    assert long[2] == pytest.approx(once[2]) and long[1] == 300_000


def test_the_sample_is_bounded(labelled):
    docs, labels, _ = labelled
    sample = X.labelled_sample(docs, labels, "doc_id", "text", "toxic", "doc_id", 100)
    assert sample.count() == 100


def test_documents_that_repeat_an_id_count_once(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    rows += [(1, f"text {k % 7}") for k in range(1500)] + [(None, "x"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    # most labelled ids have no document
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    key = lambda t: np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64)
    for bound in (10_000, 300, 100):
        found = X.labelled_sample(docs, labels, "doc_id", "text", "toxic", "doc_id", bound)
        got = {r["id"]: r["text"] for r in found.collect()}
        usable = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
        assert found.count() == len(got) == min(bound, len(usable)) and set(got) <= set(usable)
        for i, text in got.items():
            assert text == min((t or "" for d, t in rows if d == i), key=key)
    assert zlib.crc32(b"1") % 5
