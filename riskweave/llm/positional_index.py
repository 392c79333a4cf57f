"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table over blocks of documents.  A block has one row per term with the
positions of all its occurrences, and one row with its documents.  Positions number the words
of a block through; documents are ``GAP`` numbers apart, so no phrase runs over their border.

A search filters the postings to the terms of the test items, brings those of a block
together, and intersects them per test window: from the rarest term of the whole corpus to
the most frequent, each list moved back by the term's offset in the window.  Test windows are
searched in chunks of bounded size, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm.common import free_name, id_and_bytes, regroup, text_bytes
from riskweave.session import stage

WINDOW_WORDS = 10
# Words apart at most, and how many of an item's rarest terms must be that near.
SLOP = 40
NEAR_TERMS = 4
GAP = 1000
BLOCK_BYTES = 6 << 20
# Test windows (of at most WINDOW_WORDS words) that are broadcast at a time.
CHUNK_WINDOWS = 20_000

# A-Z to lower case; what is neither a letter, a digit nor beyond ASCII separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
INDEX_SCHEMA = ("block long, term string, n long, positions binary, doc_ids array<long>, "
                "text_keys array<long>, lengths array<long>")
_PIECE = 1 << 20


def pieces_of_words(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    clean, at = body.translate(WORD_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + _PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in seven-bit groups, low group first, and where each begins."""
    size = np.ones(len(values), np.int64)
    for shift in range(7, 63, 7):
        more = values >= (1 << shift)
        if not more.any():
            break
        size += more
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(begin[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        group = (values[has] >> (7 * k)) & 127
        out[begin[has] + k] = group | np.where(size[has] > k + 1, 128, 0)
    return out, begin


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = raw < 128
    begin = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    within = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * within), begin)


def _block(bodies: list[bytes]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for all words of a block their term and position; words per document."""
    terms: dict[bytes, int] = {}
    ids, places, lengths, base = [], [], [], 0
    for body in bodies:
        count = 0
        for words in pieces_of_words(body):
            ids.append(np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int32,
                                   len(words)))
            places.append(np.arange(base + count, base + count + len(words)))
            count += len(words)
        lengths.append(count)
        base += count + GAP
    empty = [np.empty(0, np.int64)]
    return (terms, np.concatenate(ids or empty).astype(np.int32),
            np.concatenate(places or empty), np.array(lengths, np.int64))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Postings of every word of every text, stored in the shared folder.

    Rows ``block, term, n, positions`` and, with a null term, ``block, doc_ids, text_keys,
    lengths``; a text's key is its XXH64.
    Null texts have no words; empty tables give an empty index.  A block holds whole
    documents: as many as fit in ``block_bytes``, or one.
    """

    per_document = ("doc_ids", "text_keys", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()),
                            ("positions", pa.binary()),
                            *((c, pa.list_(pa.int64())) for c in per_document)])
        block = TaskContext.get().partitionId() << 32
        for table in regroup(batches, block_bytes):
            terms, ids, places, lengths = _block(table.column("body").to_pylist())
            order = np.argsort(ids, kind="stable")
            count = np.bincount(ids, minlength=len(terms))
            begin = np.concatenate(([0], np.cumsum(count)))
            steps = places[order]
            steps[1:] -= places[order][:-1]
            steps[begin[:-1]] = places[order][begin[:-1]]
            packed, at = pack(steps)
            n = len(terms)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)),
                pa.array(list(terms), pa.binary()).cast(pa.string()),
                pa.array(count.astype(np.int64)),
                pa.BinaryArray.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer(at[begin].astype(np.int32)), pa.py_buffer(packed)]),
                *(pa.nulls(n, pa.list_(pa.int64())) for _ in per_document),
            ], schema=schema)
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.nulls(1, pa.string()), pa.array([len(lengths)], pa.int64()),
                pa.nulls(1, pa.binary()),
                *(pa.array([values], pa.list_(pa.int64())) for values in (
                    table.column("doc_id").to_pylist(), table.column("text_key").to_pylist(),
                    lengths.tolist())),
            ], schema=schema)
            block += 1

    rows = id_and_bytes(docs, id_col, text_col).select(
        F.col("doc_id").cast("long"), F.xxhash64("body").alias("text_key"), "body")
    return stage(rows.mapInArrow(run, INDEX_SCHEMA), "postings")


def indexed_documents(index: DataFrame) -> DataFrame:
    """``block, place, doc_id, text_key, n_words``: one row per indexed row."""
    rows = index.where("term IS NULL").select("block", F.posexplode(
        F.arrays_zip("doc_ids", "text_keys", "lengths")).alias("place", "doc"))
    return rows.select(
        "block", "place", F.col("doc.doc_ids").alias("doc_id"),
        F.col("doc.text_keys").alias("text_key"), F.col("doc.lengths").alias("n_words"))


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window_words: int = WINDOW_WORDS) -> DataFrame:
    """``item, at, whole, words``: the windows of each test item, stored.

    An item of fewer words than a window is one window; one without words has none.  A null
    item id counts as the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column("doc_id").to_pylist(),
                                  batch.column("body").to_pylist()):
                words = [w.decode() for piece in pieces_of_words(body) for w in piece]
                count = max(1, len(words) - window_words + 1) if words else 0
                for start in range(0, count, 4096):
                    spots = range(start, min(count, start + 4096))
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([item] * len(spots), pa.string()),
                        "at": pa.array(spots, pa.int64()),
                        "words": pa.array([words[i:i + window_words] for i in spots],
                                          pa.list_(pa.string())),
                    })

    rows = id_and_bytes(items, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "body")
    return stage(rows.mapInArrow(run, "item string, at long, words array<string>").distinct(),
                 "windows")


@dataclass
class _Chunk:
    """What a search task gets: distinct windows with their items, and items' rarest terms."""

    windows: list[tuple[tuple[str, ...], list[str]]]
    near: list[tuple[str, list[str]]]
    frequency: dict[str, int]


def _intersect(lists: dict[str, np.ndarray], words: tuple[str, ...],
               frequency: dict[str, int]) -> np.ndarray:
    """Where the phrase begins in a block."""
    order = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i]))
    starts = None
    for i in order:
        found = lists.get(words[i])
        if found is None:
            return np.empty(0, np.int64)
        if starts is None:
            starts = found - i
            continue
        spot = np.searchsorted(found, starts + i)
        starts = starts[found[np.minimum(spot, len(found) - 1)] == starts + i]
        if not len(starts):
            break
    return starts


def _together(lists: dict[str, np.ndarray], terms: list[str], slop: int) -> np.ndarray:
    """Occurrences of the first (rarest) term with all others at most ``slop`` words away."""
    if any(t not in lists for t in terms):
        return np.empty(0, np.int64)
    spots = lists[terms[0]]
    for term in terms[1:]:
        found = lists[term]
        after = np.searchsorted(found, spots - slop)
        near = found[np.minimum(after, len(found) - 1)]
        spots = spots[(near >= spots - slop) & (near <= spots + slop)]
    return spots


def _search_block(block: int, lists: dict[str, np.ndarray], lengths: np.ndarray, chunk: _Chunk,
                  slop: int) -> Iterator[tuple]:
    """Rows (block, place, item, kind, start, end); runs of overlapping windows are one row."""
    begin = np.concatenate(([0], np.cumsum(lengths + GAP)))
    spans: dict[str, list[tuple[np.ndarray, int]]] = {}
    for words, items in chunk.windows:
        starts = _intersect(lists, words, chunk.frequency)
        if len(starts):
            for item in items:
                spans.setdefault(item, []).append((starts, len(words)))
    for item, found in spans.items():
        start = np.concatenate([s for s, _ in found])
        end = np.concatenate([s + n for s, n in found])
        order = np.lexsort((end, start))
        start, end = start[order], np.maximum.accumulate(end[order])
        first = np.concatenate(([True], start[1:] > end[:-1]))
        last = np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)
        place = np.searchsorted(begin, start[first], side="right") - 1
        for p, s, e in zip(place, start[first] - begin[place], end[last] - begin[place]):
            yield block, int(p), item, "phrase", int(s), int(e)
    for item, terms in chunk.near:
        spots = _together(lists, terms, slop)
        place = np.searchsorted(begin, spots, side="right") - 1
        for p, k in zip(*np.unique(place, return_index=True)):
            yield block, int(p), item, "near", int(spots[k] - begin[p]), int(spots[k] - begin[p]) + 1


MATCH_SCHEMA = "block long, place int, item string, kind string, start long, end long"


def _postings(of: DataFrame, windows: DataFrame) -> DataFrame:
    """Postings of the windows' terms, stored."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    found = of.where("term IS NOT NULL").join(terms, "term", "left_semi")
    return stage(found.select("block", "term", "n", "positions"), "wanted")


def _search(postings: DataFrame, layout: DataFrame, rows: DataFrame, windows: DataFrame,
            near_terms: int, slop: int) -> DataFrame:
    """Matches of one chunk of windows, from the postings of its terms."""
    spark = postings.sparkSession
    frequency = {r["term"]: r["n"] for r in
                 postings.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    grouped = rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    phrases = [(tuple(r["words"]), list(r["items"])) for r in grouped.toLocalIterator()]
    rarest = []
    if near_terms:
        items = rows.select("item").distinct()
        words = windows.join(items, "item", "left_semi").select(
            "item", F.explode("words").alias("term")).distinct()
        count = postings.groupBy("term").agg(F.sum("n").alias("n"))
        # words that no document has are rarer than any, and would keep the item from matching
        order = Window.partitionBy("item").orderBy("n", "term")
        best = (
            words.join(count, "term").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= near_terms).groupBy("item")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("best"))
        )
        rarest = [(r["item"], [x["term"] for x in r["best"]]) for r in best.toLocalIterator()]
    shared = spark.sparkContext.broadcast(_Chunk(phrases, rarest, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = shared.value
        names = ["block", "place", "item", "kind", "start", "end"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def emit(block, lists, lengths):
            found = list(_search_block(block, lists, lengths, chunk, slop))
            columns = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names)

        now, lists, lengths = None, {}, np.empty(0, np.int64)
        for batch in batches:
            for block, term, packed, sizes in zip(*(batch.column(c).to_pylist() for c in (
                    "block", "term", "positions", "lengths"))):
                if block != now:
                    if lists:
                        yield emit(now, lists, lengths)
                    now, lists, lengths = block, {}, np.empty(0, np.int64)
                if term is None:
                    lengths = np.array(sizes, np.int64)
                else:
                    lists[term] = np.cumsum(unpack(packed))
        if lists:
            yield emit(now, lists, lengths)

    together = postings.select(
        "block", "term", "positions", F.lit(None).cast("array<long>").alias("lengths"))
    blocks = together.unionByName(layout).repartition("block").sortWithinPartitions(
        "block", F.col("term").asc_nulls_first())
    found = stage(blocks.mapInArrow(run, MATCH_SCHEMA), "matches")
    shared.destroy()
    return found


def find_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id",
                 text_col: str = "text", window_words: int = WINDOW_WORDS, slop: int = SLOP,
                 near_terms: int = NEAR_TERMS, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """``block, place, item, kind, start, end``: where the index has the test items.

    ``phrase``: words ``start`` to ``end`` of the document are covered by windows of the item.
    ``near``: of the item's terms that occur in the index, the ``near_terms`` rarest (or all, if
    there are fewer) are within ``slop`` words of the word at ``start``, in any order (0 terms:
    not searched).

    The index is read twice, for the postings of all test terms and for the lengths of the
    documents, however many windows there are; a chunk of windows reads what was found then.
    """
    if not 0 <= slop < GAP or not 0 < window_words <= GAP:
        raise ValueError(f"Windows and distances are below {GAP} words")
    windows = test_windows(items, id_col, text_col, window_words)
    chunks = -(-windows.count() // chunk_windows) or 1
    wanted = _postings(index, windows)
    layout = index.where("term IS NULL").select(
        "block", F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("binary").alias("positions"), "lengths")
    if chunks > 1:
        layout = stage(layout, "layout")

    def search(rows: DataFrame, windows: DataFrame, near_terms: int) -> DataFrame:
        postings = wanted if chunks == 1 else _postings(wanted, rows)
        return _search(postings, layout, rows, windows, near_terms, slop)

    out = None
    for i in range(chunks):
        # all windows of an item fall into one chunk only if there is one; matches of the
        # parts of a passage overlap and are united by whoever counts words
        rows = windows if chunks == 1 else windows.where(
            F.pmod(F.xxhash64("item", "at"), F.lit(chunks)) == i)
        found = search(rows, windows, near_terms if chunks == 1 else 0)
        out = found if out is None else out.unionByName(found)
    if chunks > 1 and near_terms:
        names = windows.select("item").distinct()
        for i in range(chunks):
            some = windows.join(names.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == i),
                                "item", "left_semi")
            out = out.unionByName(search(some, some, near_terms).where("kind = 'near'"))
    return out.distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window_words: int = WINDOW_WORDS,
                  slop: int = SLOP, near_terms: int = NEAR_TERMS,
                  block_bytes: int = BLOCK_BYTES,
                  chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, n_near``.

    ``n_hit`` words lie in an occurrence of a test window, ``n_items`` items have one,
    ``n_near`` items have their rarest terms close together.  Null and wordless texts have no
    hits; an empty table of items hits nothing; other columns are ignored; rows that share an
    id are rows of their own.
    """
    index = build_index(docs, id_col, text_col, block_bytes)
    found = find_matches(index, items, item_id_col, item_text_col, window_words, slop,
                         near_terms, chunk_windows)
    at = Window.partitionBy("block", "place").orderBy("start", "end")
    before = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hits = (
        found.where("kind = 'phrase'").withColumn("fresh", fresh)
        .groupBy("block", "place")
        .agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    near = (
        found.where("kind = 'near'").groupBy("block", "place")
        .agg(F.count_distinct("item").alias("n_near"))
    )
    rows = indexed_documents(index).join(hits, ["block", "place"], "left").join(
        near, ["block", "place"], "left")
    none = F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(listed, ","), "UTF-8"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a test window, all columns as they were."""
    index = build_index(docs, id_col, text_col)
    found = find_matches(index, items, item_id_col, item_text_col, window_words, near_terms=0)
    hit = indexed_documents(index).join(
        found.where("kind = 'phrase'").select("block", "place").distinct(), ["block", "place"],
        "left_semi")
    ident, key = (free_name(docs.columns, n) for n in ("_hit_id", "_hit_key"))
    hit = stage(hit.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).distinct(),
                "hit")
    return docs.join(
        hit, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(ident))
        & (F.xxhash64(text_bytes(text_col)) == F.col(key)), "left_anti")
