import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ranked_search as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document against every item."""
    lists = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in lists)
    n_terms = sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in lists:
            m = 10 + (90 * sum(counts.values()) * n_docs) // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in set(words(text)) if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score)
                for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    rows = rs.best_documents(docs, items, **options).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)] + ["é", "日本", "Z9"]

    def text(n):
        return " ".join(rng.choice(vocabulary[:rng.choice([10, 40, 123])]) for _ in range(n))

    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (7, docs[7][1])]
    docs += [(400, None), (401, ""), (402, "... --"), (403, text(20_000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    items += [(30, docs[7][1]), (31, None), (32, ""), (33, "unheard of"), (None, "w1 w2"),
              (30, "w3")]
    return docs, items


def frames(spark, planted):
    docs, items = planted
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
            spark.createDataFrame(items, "item_id long, text string").repartition(2))


@pytest.mark.parametrize("options", [
    {}, {"max_wanted": 3}, {"block_bytes": 500, "leaf_docs": 1, "leaf_items": 1},
    {"chunk_items": 4, "tile_cells": 300, "block_bytes": 3000}, {"chunk_terms": 20}, {"k": 1},
    {"k": 1000}])
def test_against_brute_force(spark, planted, options):
    docs, items = planted
    assert found(*frames(spark, planted), **options) == brute(docs, items, options.get("k", 10))


def test_sample(spark, sample, texts, documents):
    items = spark.read.parquet(f"{sample}/benchmark.parquet")
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    assert found(documents, items) == brute(texts, rows)


def test_edge_documents(edge_docs, no_docs, spark):
    items = spark.createDataFrame(
        [(1, "the quick brown fox", "x", 1), (2, "same odd dolor lorem", "y", 2)],
        "item_id long, text string, term string, item long")
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    want = brute(rows, [(1, "the quick brown fox"), (2, "same odd dolor lorem")])
    assert found(edge_docs, items) == want
    assert found(no_docs, items) == []
    assert found(edge_docs, items.where("false")) == []


def test_pairs_are_pruned():
    """Documents that share nothing with an item, or too little, are not scored."""
    rng = np.random.default_rng(2)
    n = 640
    matrix = np.zeros((8, n), np.float32)
    half = rng.permutation(n)
    matrix[:4, half[:n // 2]] = rng.integers(1, 10, (4, n // 2))
    matrix[4:, half[n // 2:]] = rng.integers(1, 10, (4, n // 2))
    matrix[:4, half[:12]] = 900
    items = rs.ItemTree([(1, list("abcd"), [5, 5, 5, 5], 0), (2, list("efgh"), [9, 9, 9, 9], 0)],
                        10, 1)
    scored = rs.search_tile(items, np.arange(8), matrix, list(range(n)), [0] * n, 16)
    assert scored < n // 16  # of twice as many pairs
    totals = (matrix[:4].sum(0) * 5).astype(int)
    want = sorted((-int(s), i) for i, s in enumerate(totals))[:10]
    assert [(-s, d) for i, s, d, _ in items.found() if i == 1] == want


def test_a_floor_prunes_whole_tiles():
    matrix = np.full((2, 100), 7, np.float32)
    items = rs.ItemTree([(1, ["a", "b"], [1, 1], 15)], 10, 1)
    assert rs.search_tile(items, np.arange(2), matrix, list(range(100)), [0] * 100, 4) == 0
    items = rs.ItemTree([(1, ["a", "b"], [1, 1], 14)], 10, 1)
    rs.search_tile(items, np.arange(2), matrix, list(range(100)), [0] * 100, 4)
    assert [d for _, _, d, _ in items.found()] == list(range(10))


def test_tree_nodes_hold_maxima():
    rng = np.random.default_rng(1)
    matrix = (rng.random((12, 77)) < 0.3) * rng.integers(1, 50, (12, 77))
    tree = rs.build_tree(matrix, 5)
    assert sorted(tree.order.tolist()) == list(range(77))
    for node, (a, b) in enumerate(zip(tree.low, tree.high)):
        assert (tree.most[:, node] == matrix[:, tree.order[a:b]].max(1)).all()
        if tree.left[node] >= 0:
            assert tree.low[tree.left[node]] == a and tree.high[tree.right[node]] == b
            assert tree.high[tree.left[node]] == tree.low[tree.right[node]]


def test_clashing_columns(spark, planted):
    docs, items = frames(spark, planted)
    for c in ("_row", "_item", "id", "term", "block", "score", "rank", "item", "_id", "slot"):
        docs, items = docs.withColumn(c, F.lit("x")), items.withColumn(c, F.lit("x"))
    assert found(docs, items) == brute(*planted)
