import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from riskweave.llm import pieces as P

from .conftest import TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    made = ["".join(rng.choice("abcdetinrsoh  éüß.,\n▁🙂") for _ in range(rng.randrange(120)))
            for _ in range(400)]
    return made + ["", " ", "  a  b ", "aaaaaaaaaa aaaa", "<s> </s> <0x0A>", "\x00x", "日本語 テ"]


def test_bpe_ids_equal_the_library(texts, odd_texts):
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), P.load_model(PATH)
    rows = [t for _, t in texts] + odd_texts
    found = P.encode_block(rows, P.Lexicon(P.WordEncoder(model)))
    assert found == library.encode(rows)
    assert [P.decode(ids, model) for ids in found] == [library.decode(ids) for ids in found]


def test_unigram_finds_the_best_sum(odd_texts):
    raw = proto.ModelProto()
    with open(PATH, "rb") as file:
        raw.ParseFromString(file.read())
    rng = random.Random(3)
    raw.trainer_spec.model_type = P.UNIGRAM
    for piece in raw.pieces:
        if piece.type == 1:
            piece.score = -rng.uniform(4, 16)
    data = raw.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = P.parse_model(data, proto)
    found = P.encode_block(odd_texts, P.Lexicon(P.WordEncoder(model)))
    score = lambda ids: sum(library.get_score(i) for i in ids)
    equal = 0
    for text, ids in zip(odd_texts, found):
        want = library.encode(text)
        equal += ids == want
        assert score(ids) >= score(want) - 1e-3 * max(1, len(want))
        assert library.decode(ids) == library.decode(want)
    assert equal > 0.9 * len(odd_texts)


def test_words_with_a_common_beginning_share_the_pass():
    encoder = P.WordEncoder(P.load_model(PATH))
    calls = []
    step = encoder._extend_bpe

    def counted(word, shared, *stacks):
        calls.extend(word[:n] for n in range(shared + 1, len(word) + 1))
        step(word, shared, *stacks)

    encoder._extend_bpe = counted
    words = ["▁inter", "▁internal", "▁international"]
    list(encoder.encode(words))
    assert sorted(calls) == sorted({w[:n] for w in words for n in range(1, len(w) + 1)})


def test_tables(edge_docs, no_docs):
    model = P.load_model(PATH)
    read = P.decode_table(P.encode_table(edge_docs, model, block_bytes=1000), model).collect()
    # a mark in the text reads as a space; none of these has one
    assert sorted((str(r["doc_id"]), r["text"]) for r in read) == sorted(
        (str(i), t or "") for i, t in TEXTS)
    assert all(r["n_tokens"] == len(r["ids"]) for r in read)
    at_once = P.encode_and_decode(edge_docs, model).collect()
    assert sorted(map(tuple, at_once), key=str) == sorted(map(tuple, read), key=str)
    assert P.decode_table(P.encode_table(no_docs, model), model).collect() == []
