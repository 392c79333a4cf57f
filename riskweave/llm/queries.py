"""One registered query per operator, over whole tables, and the SQL that some must equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    backoff, chat_events, exact_dedup, license_scan, packing, personal_data, pieces,
    positional_index, prefix_trie, ranked_search, simhash_join, token_files, toxicity,
)
from riskweave.session import stage, stage_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_join.near_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path,
                                  public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def decontamination_near(spark: SparkSession, folder: str) -> DataFrame:
    """Exact phrase and proximity matches of every document."""
    return positional_index.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of its SQL; ``decontamination_near`` has the proximity matches as well."""
    return decontamination_near(spark, folder).drop("n_near")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_blocks", F.array_join("licenses", ",").alias("licenses"),
                        F.array_join("modified", ",").alias("modified"),
                        F.to_json("notices").alias("notices"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text as a checksum, and whether decoding them gives the text back."""
    model = pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    read = pieces.encode_and_decode(table(spark, folder, "documents"), model)
    return read.select(
        "doc_id", "n_tokens", "ids_crc32",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
        (F.xxhash64(F.col("text").cast("binary")) == F.col("text_key")).alias("round_trip"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, folder, "documents"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one (-1) whose texts look like the template's marks."""
    said = f"{chat_events.CLOSE}[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    placed = chat_events.in_order(rows.unionByName(probe))
    events = chat_events.as_events(placed, order_col="place")
    return chat_events.read_back(stage(chat_events.fold(events), "formatted"))


def op9_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.best_documents(table(spark, folder, "documents"),
                                        table(spark, folder, "benchmark"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_license_scan": op5_license_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_backoff_scores": op9_backoff_scores,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_trie": op13_conversation_trie,
}

# Queries besides the one per operator.
FURTHER = {"decontamination_near": decontamination_near}

ORACLE = {
    # n_near is left to the tests: its rarest terms come from counts over the whole corpus.
    "op3_decontamination": r"""
        WITH
        lower_docs AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ),
        lower_items AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ),
        windows AS (
            SELECT DISTINCT item_id, list_slice(words, i, i + 9) AS words
            FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS i
                  FROM lower_items WHERE len(words) > 0)
        ),
        spots AS (
            SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i, n
            FROM lower_docs, (SELECT DISTINCT len(words) AS n FROM windows)
        ),
        found AS (
            SELECT s.doc_id, s.i, s.n, w.item_id
            FROM spots s JOIN windows w
            ON s.i + s.n - 1 <= len(s.words) AND list_slice(s.words, s.i, s.i + s.n - 1) = w.words
        ),
        hits AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
        ),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found)
            GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM lower_docs d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op8_chat_formatting": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        shown AS (
            SELECT *, concat(
                '<s>[INST] ',
                regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'),
                ' [/INST] ',
                regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'),
                '</s>') AS formatted
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text))
                AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT)
                AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'),
                            '')) AS loss_sha256,
            CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
        FROM shown GROUP BY conv_id
    """,
    "op12_ranked_search": r"""
        WITH
        doc_terms AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        item_terms AS (
            SELECT DISTINCT r, item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS r FROM benchmark)
        ),
        corpus AS (
            SELECT count(*) FILTER (len(terms) > 0) AS n_docs,
                CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM doc_terms
        ),
        counts AS (
            SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf
            FROM (SELECT *, unnest(terms) AS term FROM doc_terms) GROUP BY ALL
        ),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))
                AS BIGINT) AS w
            FROM counts, corpus GROUP BY term, n_docs
        ),
        scores AS (
            SELECT i.r, i.item_id, c.r AS d, c.doc_id, CAST(sum(w * ((1000000000 * tf)
                // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM item_terms i JOIN counts c USING (term) JOIN weights USING (term), corpus
            GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0
        WINDOW w AS (PARTITION BY r ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER w <= 10
    """,
    # CRC-32 of the decimal id, bit by bit: DuckDB has no function for it
    "op13_conversation_trie": r"""
        WITH listed AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        cut AS (
            SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
                list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)),
                lambda crc, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1
                    THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, CAST(b AS BIGINT))),
                CAST(4294967295 AS BIGINT))) % 6 AS h
            FROM listed
        ),
        made AS (
            SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h),
                                          list_slice(c.turns, h + 1, len(c.turns))) AS turns
            FROM cut c LEFT JOIN listed b ON b.conv_id = c.base
        ),
        prefixes AS (
            SELECT conv_id, d, list_slice(turns, 1, d) AS path, len(turns) = d AS ends
            FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM made)
        ),
        nodes AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (ends), '') AS ends
            FROM prefixes GROUP BY path, d
        ),
        kids AS (
            SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children
            FROM nodes WHERE d > 0 GROUP BY ALL
        ),
        known AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children,
                CASE WHEN d > 0 THEN (n_convs - 1) * length(n.path[d].text) ELSE 0 END AS saved
            FROM nodes n LEFT JOIN kids USING (path)
        ),
        below AS (
            SELECT list_slice(path, 1, a) AS path, count(*) FILTER (n_children = 0) AS n_leaves,
                sum(saved) AS saved
            FROM (SELECT *, unnest(range(d + 1)) AS a FROM known) GROUP BY ALL
        )
        SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
            b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
        FROM known k JOIN below b ON b.path = k.path
        LEFT JOIN known p ON k.d > 0 AND p.path = list_slice(k.path, 1, k.d - 1)
    """,
}
