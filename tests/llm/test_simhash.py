import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskweave.llm import simhash_join as S
from riskweave.llm.components import connected

from .conftest import TEXTS


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, k):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_brute_force(edge_docs, documents, texts):
    for docs, rows in ((edge_docs, TEXTS[:6] + TEXTS[8:]), (documents, texts[:60])):
        found = {(r["doc_id"], r["fp"] % (1 << 64)) for r in S.fingerprints(docs).collect()}
        assert {(i, brute_fingerprint(t)) for i, t in rows} <= found


def random_fingerprints(n, clusters, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(clusters)]
    out = set()
    while len(out) < n:
        fp = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            fp ^= 1 << rng.randrange(64)
        out.add(fp)
    return sorted(out)


@pytest.mark.parametrize(("k", "node"), [(2, S.MAX_NODE), (2, 16), (0, 8), (1, 8), (3, 32)])
def test_links_give_the_components_of_all_pairs(spark, k, node):
    fps = random_fingerprints(600, 12, k)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), k, node).collect()
    for e in edges:  # an edge stands for a chain of pairs of one part
        assert e["a"] != e["b"]
    want = brute_components(fps, k)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = find(e["a"] % (1 << 64)), find(e["b"] % (1 << 64))
        root[max(a, b)] = min(a, b)
    got = [find(f) for f in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_walk_finds_exactly_the_near_pairs():
    bits = np.array(random_fingerprints(400, 6, 9), np.uint64)
    zero, end = np.array([0]), np.array([len(bits)])
    for frontier in (1 << 20, 50):
        found = {tuple(sorted((int(a), int(b)))) for i, j in
                 S.walk(bits, (zero, end, zero, end), 0, np.array([0]), 2, frontier)
                 for a, b in zip(i, j)}
        want = {(i, j) for j in range(len(bits)) for i in range(j)
                if int(bits[i] ^ bits[j]).bit_count() <= 2}
        assert found == want


def test_components_of_documents(edge_docs, documents, texts):
    for docs, rows in ((documents, texts), (edge_docs, TEXTS)):
        found = S.near_components(docs).collect()
        assert len(found) == len(rows)
        fps = [r["fp"] % (1 << 64) for r in found]
        roots = brute_components(fps, 2)
        for r, root in zip(found, roots):
            ids = [x["doc_id"] for x, other in zip(found, roots) if other == root]
            ids = [i for i in ids if i is not None]
            assert r["component_id"] == (min(ids) if ids else None)


def test_one_row_of_each_component_stays(edge_docs, no_docs):
    kept = S.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    components = S.near_components(edge_docs).select("component_id").distinct()
    want = sorted(str(r[0]) for r in components.collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert S.near_components(no_docs).collect() == []
    assert S.one_of_each(no_docs).collect() == []


def test_connected(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(80)]
    edges += [(500, 500), (700, 701), (701, 700)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    found = {r["node"]: r["root"] for r in
             connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert found == {x: find(x) for x in list(root)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_third_of_the_rows_in_one_group(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 1000, F.lit("one two three four five"))
        .otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256),
                            F.lit(" end"))).alias("text"))
    found = S.near_components(rows)
    assert found.where("doc_id < 1000 AND component_id = 0").count() == 1000
    assert found.where("doc_id >= 1000 AND component_id = doc_id").count() > 1990


def test_one_of_each_takes_null_for_an_empty_text(spark):
    rows = spark.createDataFrame(
        [(1, None, "a"), (1, "", "b"), (2, "", "c"), (3, "one two three four", "d"),
         (3, "one two three four", "d")], "doc_id long, text string, _text_key string")
    kept = S.one_of_each(rows).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [
        (1, ""), (3, "one two three four")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "_text_key"}
