"""Every stage against a plain version of itself on the smallest tables, and the registry."""

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as driver
import corpus_pipeline as C
from checks.compare import connect, difference
from riskweave.llm import queries as Q
from riskweave.session import stage

from .test_exact_dedup import brute as brute_copies
from .test_positional_index import brute as brute_passages
from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    out = [docs]
    for name, apply in C.STAGES:
        docs = stage(apply(spark, docs, sample), name)
        out.append(docs)
    return out


def rows(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


def test_toxic_documents_go(spark, sample, stages):
    labels = {r["doc_id"]: r["toxic"] for r in
              spark.read.parquet(f"{sample}/labels.parquet").collect()}
    before, after = dict(rows(stages[0])), dict(rows(stages[1]))
    assert stages[1].columns == stages[0].columns
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)


def test_copies_go(stages):
    want = sorted(r[0] for r in brute_copies(rows(stages[1])) if r[3])
    assert sorted(i for i, _ in rows(stages[2])) == want


def test_near_copies_go(stages):
    before = sorted(rows(stages[2]))
    roots = brute_components([brute_fingerprint(t) for _, t in before], 2)
    assert sorted(rows(stages[3])) == [before[k] for k in sorted(set(roots))]


def test_passages_go(spark, sample, stages):
    items = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in brute_passages(rows(stages[3]), items) if not r[5])
    assert sorted(i for i, _ in rows(stages[4])) == want


def test_ids(stages):
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before = dict(rows(stages[4]))
    found = stages[5].collect()
    assert len(found) == len(before)
    assert all(r["text"] == before[r["doc_id"]] and r["ids"] == library.encode(r["text"])
               for r in found)


def test_run_gives_the_last_stage(spark, sample, stages):
    key = lambda t: sorted((r["doc_id"], r["ids_crc32"]) for r in t.collect())
    assert key(C.run(spark, sample)) == key(stages[5])


def test_registry():
    assert set(Q.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(Q.ORACLE) <= set(driver.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, sample, name):
    assert difference(Q.QUERIES[name](spark, sample), connect(sample), Q.ORACLE[name]) is None


# a piece is a row of op11, which test_packing holds against the documents
@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE) - {"op11_packing"}))
def test_query_has_a_row_per_document(spark, sample, name):
    found = Q.QUERIES[name](spark, sample)
    assert found.count() == spark.read.parquet(f"{sample}/documents.parquet").count()
    assert "doc_id" in found.columns
