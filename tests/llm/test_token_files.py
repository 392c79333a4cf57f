import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweave.llm import token_files as T
from riskweave.session import stage_path

from .conftest import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(rows, tokenizer):
    out, start = [], 0
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_spans_give_the_library_ids(tokenizer):
    rng = random.Random(5)
    odd = ["", " ", "  a  b\n c\t d", "it's  'll don't 's", "a <|endoftext|> b<|endoftext|>c",
           " x 　 y\x1c z\u0085 q", "日本 語 🙂 🙂", "x" * 300 + " y", " lead", "trail "]
    odd += ["".join(rng.choice("ab'st 1.\n \té🙂 ") for _ in range(50)) for _ in range(500)]
    with open(PATH, encoding="utf-8") as file:
        encoder = T.SpanEncoder(file.read(), np.dtype("<u2"), 0)
    for _ in range(2):  # once new, once remembered
        found = [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(odd)]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in odd]


@pytest.mark.parametrize("shard_bytes", [T.SHARD_BYTES, 20_000])
def test_files_hold_all_documents_in_order(spark, documents, texts, tokenizer, shard_bytes):
    path = stage_path(spark, "t")
    index = T.write_token_files(documents, path, PATH, shard_bytes=shard_bytes)
    read = sorted(map(tuple, T.read_token_files(spark, path).collect()))
    assert read == expected(sorted(texts), tokenizer)
    assert index == T.read_index(path)
    system, root = T.open_folder(path)
    names = {s["name"] for s in index["shards"]}
    files = system.get_file_info(T.fs.FileSelector(root))
    assert {f.base_name for f in files} == {"index.json"} | {
        f"{n}.{kind}" for n in names for kind in ("ids", "offsets", "docs")}
    flat = np.concatenate([T.mapped(system, f"{root}/{s['name']}.ids", index["dtype"])
                           for s in index["shards"]])
    assert len(flat) == index["n_tokens"]


def test_odd_rows(spark, edge_docs, no_docs, tokenizer):
    path = stage_path(spark, "t")
    T.write_token_files(edge_docs, path, PATH)
    read = sorted(map(tuple, T.read_token_files(spark, path).collect()))
    low = -(1 << 63)
    want = {(low if i is None else i, n, crc) for i, _, n, crc in expected(TEXTS, tokenizer)}
    assert {(i, n, crc) for i, _, n, crc in read} == want and len(read) == len(TEXTS)
    assert [s for _, s, _, _ in read] == sorted(s for _, s, _, _ in read)
    path = stage_path(spark, "t")
    assert T.write_token_files(no_docs, path, PATH)["shards"] == []
    assert T.read_token_files(spark, path).collect() == []


def test_other_pre_tokens_are_refused(spark, documents):
    with pytest.raises(ValueError):
        T.write_token_files(documents, stage_path(spark, "t"),
                            public_tokenizers.path("word_bpe_49k.json"))
