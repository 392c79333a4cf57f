"""Stupid-backoff scores of all documents against the counts of all other documents.

The plan is relational: count tables of n-grams partitioned by hash, joined to the n-grams of
every document, summed per document.  Rows are packed: a block of documents sends each of its
distinct n-grams once, as one sorted list per hash range, so the most frequent n-gram of the
corpus is one entry per block, and a range is joined by merging sorted lists.

1. ``tokens``: per block, its documents' words as ids of the block's own vocabulary, stored
   bucketed by block.
2. ``totals``: n-grams meet by hash range; each block gets back the counts that exceed its own.
3. Per block, tokens (which the bucketing leaves where they are) and totals meet; the
   document's own occurrences are taken off, and each word is scored by the longest n-gram that
   another document has.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_and_bytes, regroup
from riskweave.llm.positional_index import pack, pieces_of_words, unpack
from riskweave.session import stage, stage_path

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8 << 20
# N-gram entries of one hash range, before equal ones are united.
RANGE_ENTRIES = 1_000_000
# Bits of an n-gram's hash.  Different n-grams that share one share a count: among n distinct
# n-grams n * n / 2^57 pairs are to be expected (0.5 at 2^28, 128 at 2^32).
HASH_BITS = 56

TOKENS = "block long, doc_ids array<long>, lengths array<long>, words binary, tokens binary"
ENTRIES = "block long, part int, width int, hashes binary, counts binary"
TOTALS = "block long, part int, places binary, totals binary"
SCORES = ("doc_id long, n_words long, log_score double, mean_log_score double, n_full long, "
          "n_unseen long")


# ---- packing ------------------------------------------------------------------

def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers in as many bytes each as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return width, raw[:, :width].tobytes()


def widen(width: int, packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# ---- a block ------------------------------------------------------------------

def block_tokens(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the block's words, the most frequent first; all tokens; words per text."""
    ids: dict[bytes, int] = {}
    tokens, lengths = [], []
    for body in bodies:
        n = 0
        for words in pieces_of_words(body):
            tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64,
                                      len(words)))
            n += len(words)
        lengths.append(n)
    flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    by_count = np.argsort(-np.bincount(flat, minlength=len(ids)), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_count] = np.arange(len(ids))
    return hashes[by_count], rank[flat], np.array(lengths, np.int64)


def offsets_within(lengths: np.ndarray) -> np.ndarray:
    """Place of each word in its document."""
    begin = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(begin, lengths)


def gram_hashes(words: np.ndarray, tokens: np.ndarray, within: np.ndarray,
                order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: where an n-gram ends, and its hash.  None spans two documents."""
    word = words[tokens] if len(words) else np.empty(0, np.uint64)
    out, running = [], np.zeros(len(word), np.uint64)
    for n in range(1, order + 1):
        # running holds the hash of the n - 1 words before each place
        running = mixed(running * np.uint64(0xA24BAED4963EE407) + word + np.uint64(n))
        ends = np.flatnonzero(within >= n - 1)
        out.append((ends, running[ends] >> np.uint64(64 - HASH_BITS)))
        if n < order:
            running = np.concatenate((np.zeros(1, np.uint64), running[:-1]))[:len(word)]
    return out


def bounds(parts: int) -> np.ndarray:
    """First hash of each of ``parts`` equal hash ranges, and the end."""
    return np.array([-(-(i << HASH_BITS) // parts) for i in range(parts + 1)], np.uint64)


def distinct_grams(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([h for _, h in grams]), return_counts=True)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, which of them each value is, and how often they occur; in less
    memory than ``np.unique`` needs."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    known = ranked[new]
    del ranked
    counts = np.diff(np.append(np.flatnonzero(new), len(values)))
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    which = np.empty(len(values), np.int32)
    which[order] = rank
    return known, which, counts


# ---- jobs ---------------------------------------------------------------------

def tokenise(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> str:
    """Name of a new table of ``TOKENS``: one row per block, bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for table in regroup(batches, block_bytes):
            words, tokens, lengths = block_tokens(table.column("body").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()),
                "doc_ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                "words": pa.array([words.tobytes()], pa.binary()),
                "tokens": pa.array([pack(tokens)[0].tobytes()], pa.binary())})
            block += 1

    rows = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    spark, name = docs.sparkSession, f"tokens_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(run, TOKENS).write.bucketBy(buckets, "block").option(
        "path", stage_path(spark, "tokens")).format("parquet").saveAsTable(name)
    return name


def _opened(row: dict, order: int):
    """Lengths, places within documents and n-grams of a stored block."""
    lengths = np.array(row["lengths"], np.int64)
    within = offsets_within(lengths)
    grams = gram_hashes(np.frombuffer(row["words"], np.uint64), unpack(row["tokens"]), within,
                        order)
    return lengths, within, grams


def count_totals(tokens: DataFrame, order: int, parts: int) -> DataFrame:
    """``TOTALS``: for each block and hash range, the places (in the block's sorted
    n-grams of the range) whose count in the corpus exceeds the block's own, and the counts."""
    limits = bounds(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, grams = _opened(row, order)
                hashes, counts = distinct_grams(grams)
                at = np.searchsorted(hashes, limits)
                rows: dict[str, list] = {c: [] for c in ("part", "width", "hashes", "counts")}
                for part in np.flatnonzero(np.diff(at)):
                    mine = hashes[at[part]:at[part + 1]]
                    steps = np.diff(mine, prepend=limits[part])
                    width, packed = narrow(steps)
                    for c, v in zip(rows, (int(part), width, packed, pack(
                            counts[at[part]:at[part + 1]])[0].tobytes())):
                        rows[c].append(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * len(rows["part"]), pa.int64()),
                    pa.array(rows["part"], pa.int32()), pa.array(rows["width"], pa.int32()),
                    pa.array(rows["hashes"], pa.binary()), pa.array(rows["counts"], pa.binary())],
                    names=["block", "part", "width", "hashes", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        """Unite the lists of one range and answer each block."""
        blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
        lists, counts = [], []
        for width, hashes, own in zip(*(table.column(c).to_pylist()
                                        for c in ("width", "hashes", "counts"))):
            lists.append(limits[part] + np.cumsum(widen(width, hashes)))
            counts.append(unpack(own))
        sizes = np.array([len(x) for x in lists])
        every, own = np.concatenate(lists), np.concatenate(counts)
        del lists, counts
        _, which, _ = numbered(every)
        del every
        # counts are whole numbers below 2^53, exact as weights
        total = np.bincount(which, own).astype(np.int64)[which]
        out: dict[str, list] = {"block": [], "part": [], "places": [], "totals": []}
        end = 0
        for block, n in zip(blocks, sizes):
            mine, end = slice(end, end + n), end + n
            more = np.flatnonzero(total[mine] > own[mine])
            if len(more):
                out["block"].append(block)
                out["part"].append(part)
                out["places"].append(pack(np.diff(more, prepend=0))[0].tobytes())
                out["totals"].append(pack(total[mine][more])[0].tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int64()),
                         "part": pa.array(out["part"], pa.int32()),
                         "places": pa.array(out["places"], pa.binary()),
                         "totals": pa.array(out["totals"], pa.binary())})

    return tokens.mapInArrow(send, ENTRIES).groupBy("part").applyInArrow(meet, TOTALS)


def elsewhere(doc_of: np.ndarray, index: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Count of each occurring n-gram in all documents but the one it occurs in."""
    out = np.zeros(len(index), np.int64)
    often = np.flatnonzero(total > 1)
    if len(often):
        key = doc_of[often] * np.int64(int(index.max()) + 1) + index[often]
        _, back, own = np.unique(key, return_inverse=True, return_counts=True)
        out[often] = total[often] - own[back]
    return out


def block_scores(lengths: np.ndarray, within: np.ndarray, ends: list[np.ndarray],
                 index: list[np.ndarray], totals: np.ndarray, n_corpus: int,
                 alpha: float) -> dict[str, np.ndarray]:
    """Sums per document of a block.  For each order, ``ends`` says where n-grams end and
    ``index`` which they are; ``totals`` are the counts in the corpus by that number."""
    n_docs, size = len(lengths), int(lengths.sum())
    doc_of = np.repeat(np.arange(n_docs), lengths)
    others = (n_corpus - lengths)[doc_of]
    log = np.full(size, np.nan)
    full, unseen = np.zeros(size, bool), np.zeros(size, bool)
    counts: list[np.ndarray] = []
    for at, which in zip(ends, index):
        count = np.zeros(size, np.int64)
        count[at] = elsewhere(doc_of[at], which, totals[which])
        counts.append(count)
    orders = len(ends)
    available = np.minimum(within + 1, orders)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(orders, 0, -1):
            seen = np.flatnonzero(np.isnan(log) & (counts[n - 1] > 0))
            before = counts[n - 2][seen - 1] if n > 1 else others[seen]
            log[seen] = (np.log(counts[n - 1][seen]) - np.log(before)
                         + (available[seen] - n) * math.log(alpha))
            if n == orders:
                full[seen] = True
        rest = np.flatnonzero(np.isnan(log))
        unseen[rest] = True
        log[rest] = available[rest] * math.log(alpha) - np.log(others[rest] + 1.0)
    sums = np.bincount(doc_of, log, minlength=n_docs)
    return {"n_words": lengths, "log_score": sums,
            "mean_log_score": sums / np.maximum(lengths, 1),
            "n_full": np.bincount(doc_of, full, minlength=n_docs).astype(np.int64),
            "n_unseen": np.bincount(doc_of, unseen, minlength=n_docs).astype(np.int64)}


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES,
                   range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, log_score, mean_log_score, n_full,
    n_unseen``.

    Words are runs of letters and digits, A-Z lower-cased.  With counts over all other rows, a
    word's score is count(n-gram) / count(its first n - 1 words) for the longest n-gram ending
    at the word, up to ``order`` words and within the document, that others have; times
    ``alpha`` for each word by which it is shorter than it could be.  A word that no other row
    has scores ``alpha`` once more, divided by the others' words plus one.  ``log_score`` sums
    natural logarithms; ``n_full`` words were scored by ``order`` words, ``n_unseen`` are in no
    other row.

    Null and wordless texts score 0 with 0 words.  Rows that share an id or a text are rows of
    their own, so copies vouch for each other.  Other columns are ignored; an empty table gives
    no rows.  A task holds one block; a text longer than a block is a block.

    N-grams are told apart by a 56-bit hash, see ``HASH_BITS``.
    """
    spark = docs.sparkSession
    name = tokenise(docs, id_col, text_col, block_bytes)
    try:
        return _scored(spark.table(name), order, alpha, range_entries)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scored(tokens: DataFrame, order: int, alpha: float, range_entries: int) -> DataFrame:
    n_corpus = tokens.select(F.sum(F.expr(
        "aggregate(lengths, 0L, (a, x) -> a + x)"))).first()[0] or 0
    parts = -(-n_corpus * order // range_entries) or 1
    totals = count_totals(tokens, order, parts)
    limits = bounds(parts)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c.split()[0]: [] for c in SCORES.split(", ")}
        for row in left.to_pylist():
            lengths, within, grams = _opened(row, order)
            ends = [e for e, _ in grams]
            hashes = np.concatenate([h for _, h in grams])
            del grams
            known, which, counts = numbered(hashes)
            at = np.searchsorted(known, limits)
            del hashes, known
            for batch in right.to_batches(max_chunksize=256):
                for answer in batch.to_pylist():
                    places = np.cumsum(unpack(answer["places"]))
                    counts[at[answer["part"]] + places] = unpack(answer["totals"])
            index = np.split(which, np.cumsum([len(e) for e in ends])[:-1])
            found = block_scores(lengths, within, ends, index, counts, n_corpus, alpha)
            columns["doc_id"] += row["doc_ids"]
            for c, values in found.items():
                columns[c] += values.tolist()
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_full": pa.int64(),
                 "n_unseen": pa.int64()}
        return pa.table({c: pa.array(v, types.get(c, pa.float64())) for c, v in columns.items()})

    scored = tokens.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, SCORES)
    return stage(scored, "scores")
