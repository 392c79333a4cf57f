import hashlib
import re
from collections import defaultdict

import pytest

from riskweave.llm import exact_dedup as E

from .conftest import TEXTS


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        plain = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        free = True
        for i in ids:
            out.append((i, first, len(ids), free and i == first, sha))
            free = free and i != first
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [E.MAX_FILTER_BITS, E.BITMAP_BITS])
def test_copies_equal_brute_force(edge_docs, documents, texts, bits):
    for docs, rows in ((edge_docs, TEXTS), (documents, texts)):
        found = E.find_copies(docs, bits_per_row=8192, max_filter_bits=bits)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bits", [E.MAX_FILTER_BITS, E.BITMAP_BITS])
def test_one_row_of_each_text_stays(edge_docs, bits):
    kept = E.drop_copies(edge_docs, bits_per_row=8192, max_filter_bits=bits)
    assert kept.columns == edge_docs.columns
    want = sorted(str(r[0]) for r in brute(TEXTS) if r[3])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_empty_table(no_docs):
    assert E.find_copies(no_docs).collect() == []
    assert E.drop_copies(no_docs).columns == no_docs.columns


def test_a_crowded_filter_loses_nothing(documents, texts):
    found = E.find_copies(documents, bits_per_row=1, max_filter_bits=E.BITMAP_BITS)
    assert sorted(map(tuple, found.collect()), key=str) == brute(texts)


def test_no_python_in_the_plan(documents):
    plan = E.find_copies(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_only_rows_that_may_repeat_shuffle(spark, documents):
    rows = documents.select("doc_id", E.digest(documents["text"]).alias("sha")).cache()
    bits, _ = E._filter_bits(rows.count(), E.BITS_PER_ROW, E.MAX_FILTER_BITS)
    marked = E.repeat_filter(rows, "sha", bits).mark(rows, "sha", "maybe")
    repeated = rows.groupBy("sha").count().where("count > 1").agg({"count": "sum"}).first()[0]
    maybe = marked.where("maybe").count()
    assert repeated <= maybe <= repeated + 0.2 * rows.count()


def test_names_used_inside(spark):
    """Columns of the documents that are called like those of the joins."""
    names = ("_first_sha _first_id __maybe_0 __maybe_1 __maybe_0_bucket __maybe_0_bitmap "
             "__maybe_1_bucket _maybe _maybe_0 bucket bits sha ident _ident").split()
    rows = spark.createDataFrame(
        [(1, "a b", *names), (2, "a  b", *names), (3, None, *names), (4, "", *names),
         (5, "c", *names)],
        "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = E.drop_copies(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    assert all(r[n] == n for r in kept.collect() for n in names)
