import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as driver
from riskweave.llm import positional_index as P

from .conftest import TEXTS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=10):
    windows = [("" if i is None else str(i), tuple(w[k:k + size]))
               for i, t in items for w in [words(t)] if w
               for k in range(max(1, len(w) - size + 1))]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SHORT = [(i, t) for i, t in TEXTS if not t or len(t) < 1000]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "quick BROWN fox"), (2, None), (3, "!!"), (None, "no id"), (4, "a"),
            (5, "the quick brown fox jumps over the lazy dog near the river bank"),
            (5, "other text"), (6, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "chunk_windows": 3}])
def test_equals_brute_force_on_odd_rows(edge_docs, items, options):
    found = P.contamination(edge_docs.where("length(text) < 1000 OR text IS NULL"), items[0],
                            **options)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == brute(SHORT, items[1])


def test_long_texts(edge_docs, items):
    found = P.contamination(edge_docs, items[0]).where("doc_id IN (7, 8)").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in found] == [(60_000, 59_998, 1)] * 2


def test_equals_brute_force_on_random_words(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    tests = [(i, text(rng.randrange(8))) for i in range(12)]
    found = P.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame(tests, "item_id long, text string"),
                            window_words=5, block_bytes=100, chunk_windows=7)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == brute(docs, tests, 5)


def test_near_matches_in_any_order(spark):
    filler = " ".join(f"f{i}" for i in range(60))
    docs = [(1, f"gamma x beta y alpha {filler}"), (2, f"alpha {filler} beta gamma"), (3, filler)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    for chunk in (100, 1):
        found = P.contamination(rows, tests, slop=10, chunk_windows=chunk)
        assert {r["doc_id"]: (r["n_near"], r["contaminated"]) for r in found.collect()} == {
            1: (1, False), 2: (0, False), 3: (0, False)}


def brute_near(docs, items, slop=P.SLOP, near_terms=P.NEAR_TERMS):
    """Per document: items whose rarest words of the corpus are close together."""
    said = [words(t) for _, t in docs]
    count = Counter(w for ws in said for w in ws)
    spots = []
    for ws in said:
        at = {}
        for k, w in enumerate(ws):
            at.setdefault(w, []).append(k)
        spots.append(at)
    known = {}
    for i, t in items:
        known.setdefault("" if i is None else str(i), set()).update(words(t))
    out = [0] * len(docs)
    for terms in known.values():
        best = sorted((w for w in terms if count[w]), key=lambda w: (count[w], w))[:near_terms]
        for d, at in enumerate(spots):
            out[d] += bool(best) and any(
                all(any(abs(p - q) <= slop for q in at.get(w, ())) for w in best)
                for p in at.get(best[0], ()))
    return sorted(((i, n) for (i, _), n in zip(docs, out)), key=str)


def test_a_word_that_no_document_has(spark):
    docs = [(1, "alpha one beta two gamma"), (2, "beta")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    tests = [(1, "gamma unseen beta alpha"), (2, "never seen"), (3, None)]
    items = spark.createDataFrame(tests, "item_id long, text string")
    for chunk in (100, 1):
        found = P.contamination(rows, items, chunk_windows=chunk).select("doc_id", "n_near")
        assert sorted(map(tuple, found.collect())) == brute_near(docs, tests) == [(1, 1), (2, 0)]


def test_near_matches_equal_brute_force_on_random_words(spark):
    rng = random.Random(5)
    text = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    docs = [(i, text(rng.randrange(60), "abcdefghijklmnop")) for i in range(40)]
    tests = [(i % 9, text(rng.randrange(7), "abcdefghijklmnopxyz")) for i in range(12)]
    found = P.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame(tests, "item_id long, text string"),
                            window_words=5, slop=6, block_bytes=100, chunk_windows=7)
    got = sorted(map(tuple, found.select("doc_id", "n_near").collect()), key=str)
    assert got == brute_near(docs, tests, slop=6) and any(n for _, n in got)


def test_registered_query_gives_near_matches(spark, sample, texts):
    tests = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    found = driver.queries()["decontamination_near"](spark, sample)
    got = sorted(map(tuple, found.select("doc_id", "n_near").collect()), key=str)
    assert got == brute_near(texts, tests) and any(n for _, n in got)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == sorted(
        map(tuple, driver.queries()["op3_decontamination"](spark, sample).select(
            COLUMNS).collect()), key=str)


def test_only_hit_rows_go(edge_docs, no_docs, items):
    kept = P.drop_contaminated(edge_docs.where("length(text) < 1000 OR text IS NULL"), items[0])
    assert kept.columns == edge_docs.columns
    want = sorted(str(r[0]) for r in brute(SHORT, items[1]) if not r[5])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert P.contamination(no_docs, items[0]).collect() == []
    assert P.drop_contaminated(no_docs, items[0]).collect() == []
    none = items[0].where("false")
    assert P.contamination(edge_docs, none).where("contaminated").count() == 0
    assert P.drop_contaminated(edge_docs, none).count() == len(TEXTS)


def test_every_word_is_indexed(documents, texts):
    index = P.build_index(documents, block_bytes=50_000)
    total = index.where("term IS NOT NULL").agg({"n": "sum"}).first()[0]
    assert total == sum(len(words(t)) for _, t in texts)


def test_packing():
    rng = np.random.default_rng(1)
    for top in (1, 127, 128, 1 << 14, 1 << 40):
        values = rng.integers(0, top + 1, 1000)
        packed, begin = P.pack(values)
        assert (P.unpack(packed.tobytes()) == values).all() and begin[-1] == len(packed)
    assert len(P.unpack(b"")) == 0


def test_index_is_read_as_often_for_many_chunks(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(30)]
    tests = [(i, text(rng.randrange(1, 9))) for i in range(10)]
    index = P.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame(tests, "item_id long, text string")
    place = set(index.inputFiles())
    plain, reads, found = P.stage, [], []

    def counted(df, name, *rest):
        reads.append(bool(place & set(df.inputFiles())))
        return plain(df, name, *rest)

    monkeypatch.setattr(P, "stage", counted)
    for size in (10_000, 4):
        reads.clear()
        rows = P.find_matches(index, items, window_words=4, near_terms=0, chunk_windows=size)
        assert sum(reads) == 2
        hit = {(r["block"], r["place"], r["item"], k)
               for r in rows.collect() for k in range(r["start"], r["end"])}
        found.append(hit)
    assert found[0] == found[1] != set()
