import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import packing, queries

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def first_fit(lengths, capacity):
    """Every bin tried in turn."""
    loads, placed = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, load in enumerate(loads):
            if load + lengths[i] <= capacity:
                break
        else:
            b = len(loads)
            loads.append(0)
        loads[b] += lengths[i]
        placed[i] = b
    return placed


@pytest.mark.parametrize("high", [3, 40, 64, 100])
def test_first_fit_decreasing(high):
    rng = np.random.default_rng(high)
    for n in (1, 2, 7, 300):
        lengths = rng.integers(1, high + 1, n)
        assert packing.first_fit_decreasing(lengths, 100).tolist() == first_fit(
            lengths.tolist(), 100)


def test_no_room_is_left():
    rng = np.random.default_rng(1)
    for n in (1, 5, 400):
        lengths = rng.integers(1, 65, n)
        parts = packing.pack_group(lengths, 64)
        used, cut = collections.Counter(), collections.Counter()
        for item, begin, length, sequence, offset in parts:
            assert offset == used[sequence] and length > 0
            used[sequence] += length
            cut[item] += length
        assert [cut[i] for i in range(n)] == lengths.tolist()
        assert all(x == 64 or x & (x - 1) == 0 for x in used.values())
        assert sum(x != 64 for x in used.values()) <= 6
        spans = sorted((i, b, n) for i, b, n, _, _ in parts)
        assert all(b == 0 or (i, b) == (h, c + m)
                   for (h, c, m), (i, b, _) in zip([(-1, 0, 0), *spans], spans))


def test_whole_pieces_stay_whole():
    """Without gaps to fill nothing is cut."""
    parts = packing.pack_group(np.array([60, 40, 4, 24]), 64)
    assert len(parts) == 4


def expected(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return sorted((-1 if i is None else i,
                   tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
                  for i, t in rows)


def unpacked(packed, capacity):
    """The documents that the pieces make up; checks sequences on the way."""
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
    return docs


@pytest.mark.parametrize("capacity, group_ids", [(2048, 1 << 22), (64, 1000), (7, 3)])
def test_pieces_make_up_the_documents(documents, texts, capacity, group_ids):
    packed = packing.pack_documents(documents, TOKENIZER, capacity, group_ids=group_ids)
    got = []
    for (doc, n), parts in unpacked(packed, capacity).items():
        ids = []
        for start, part in sorted(parts):
            assert start == len(ids)
            ids += part
        assert len(ids) == n
        got.append((doc, ids))
    assert sorted(got) == expected(texts)


def test_edge_documents(edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    packed = packing.pack_documents(edge_docs, TOKENIZER, 64)
    total = collections.Counter()
    for (doc, _), parts in unpacked(packed, 64).items():
        for _, ids in parts:
            total[-1 if doc is None else doc] += len(ids)
    want = collections.Counter()
    for doc, ids in expected(rows):
        want[doc] += len(ids)
    assert total == want


def test_no_documents(no_docs):
    assert packing.pack_documents(no_docs, TOKENIZER).count() == 0


def test_same_result_twice(documents):
    first, second = (
        sorted(map(tuple, packing.pack_documents(documents, TOKENIZER, 256).drop("ids").collect()))
        for _ in range(2))
    assert first == second


def test_query_covers_every_id(spark, sample, texts):
    got = queries.op11_packing(spark, sample).groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    want = {i: len(ids) for i, ids in expected(texts)}
    assert {r["doc_id"]: (r["n"], r["m"]) for r in got} == {i: (n, n) for i, n in want.items()}
