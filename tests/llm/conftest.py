import pytest

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The  quick brown\tfox jumps over the lazy dog near the\nriver bank today"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, LONG), (None, "no id at all"),
    (9, "same id, same text"), (9, "same id, same text"), (9, "same id, other text"),
    (10, "naïve café 🙂 ünïcode İstanbul 日本語"), (11, "a"), (12, "\x00\x1f odd   spaces "),
]
# names that operators use inside
CLASHING = ("sha body fp block keep_id kept score n_words spans text_key _sha _maybe _ident "
            "features label probability prediction rawPrediction row_id position bits part "
            "component_id start n_tokens ids doc_id_ _score _segment _stay_id _hit_id").split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and many clashing columns."""
    rows = [(i, t, "xx", "src", -1, *(f"{c}{k}" for c in CLASHING))
            for k, (i, t) in enumerate(TEXTS)]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark, sample):
    return spark.read.parquet(f"{sample}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
