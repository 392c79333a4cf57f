"""The best documents for each item of a query set, by a dual-tree search.

1. ``build_postings``: one pass over the texts writes, per block of documents, how often each
   wanted term occurs in which of them, and a row with the documents and their lengths.
2. Corpus counts give the terms' weights.
3. Every chunk of items meets every block.  In a task, a chunk's items are a tree that is built
   once, a block's documents another.  A node holds the largest weight of each term among its
   items, or the largest saturated frequency of each term among its documents.  The sum of
   their products bounds the score of any item and document below a pair of nodes, so a pair
   goes when its bound is less than what every item of the node needs to take a document in:
   the weakest score of a full list, or the weakest that the first blocks left an item with.
   Pairs with larger bounds are opened first.  What is left at the leaves is scored exactly.
4. A task has at most k documents per item for all of its blocks; the best of them remain.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm.common import free_name, id_and_bytes, regroup
from riskweave.llm.positional_index import pack, pieces_of_words, unpack
from riskweave.session import stage

K = 10
BLOCK_BYTES = 4 << 20
# Terms that are sent to every task (about 20 bytes each); with more, all terms are indexed and
# the wanted ones are found by a join.
MAX_WANTED = 200_000
CHUNK_ITEMS = 256
CHUNK_TERMS = 50_000
LEAF_ITEMS = 4
LEAF_DOCS = 16
# Terms times documents of a matrix in a task.
TILE_CELLS = 8_000_000

POSTINGS = ("block long, term string, n long, docs binary, counts binary, doc_ids array<long>, "
            "text_keys array<long>, lengths array<long>")
ROWS = ("chunk int, slot int, block long, term string, n long, docs binary, counts binary, "
        "doc_ids array<long>, text_keys array<long>, lengths array<long>, item long, "
        "terms array<string>, weights array<long>, floor long")
FOUND = "item long, score long, doc_id long, text_key long"


# ---- postings -------------------------------------------------------------------

def build_postings(docs: DataFrame, wanted: list[str] | None = None, id_col: str = "doc_id",
                   text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``POSTINGS``, stored: per block and term the documents that hold it and how often, and
    per block a row without a term with its documents.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  Null texts
    have none.  With ``wanted`` other terms are left out; lengths always count all.  A block
    holds whole documents: as many as fit in ``block_bytes``, or one.
    """
    chosen = None if wanted is None else {t.encode(): i for i, t in enumerate(wanted)}
    lists = ("doc_ids", "text_keys", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        schema = pa.schema([
            ("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()),
            ("docs", pa.binary()), ("counts", pa.binary()),
            *((c, pa.list_(pa.int64())) for c in lists)])
        for table in regroup(batches, block_bytes):
            terms: dict[bytes, int] = {} if chosen is None else chosen
            ids, docs_of, lengths = [], [], []
            for doc, body in enumerate(table.column("body").to_pylist()):
                count = 0
                for words in pieces_of_words(body):
                    count += len(words)
                    if chosen is None:
                        found = (terms.setdefault(w, len(terms)) for w in words)
                    else:
                        found = map(terms.get, words, repeat(-1))
                    known = np.fromiter(found, np.int64, len(words))
                    known = known[known >= 0]
                    ids.append(known)
                    docs_of.append(np.full(len(known), doc))
                lengths.append(count)
            none = [np.empty(0, np.int64)]
            keys, counts = np.unique(
                np.concatenate(ids or none) * len(lengths) + np.concatenate(docs_of or none),
                return_counts=True)
            term, doc = np.divmod(keys, len(lengths))
            begin = np.flatnonzero(np.diff(term, prepend=-1))
            size = np.diff(np.append(begin, len(term)))
            steps = np.diff(doc, prepend=0)
            steps[begin] = doc[begin]
            names = list(terms)

            def packed(values: np.ndarray) -> pa.Array:
                raw, at = pack(values)
                ends = np.append(at[begin], at[-1]).astype(np.int32)
                return pa.BinaryArray.from_buffers(
                    pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw)])

            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(begin), block)),
                pa.array([names[t] for t in term[begin].tolist()], pa.binary()).cast(pa.string()),
                pa.array(size), packed(steps), packed(counts),
                *(pa.nulls(len(begin), pa.list_(pa.int64())) for _ in lists)], schema=schema)
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.nulls(1, pa.string()), pa.array([len(lengths)], pa.int64()),
                pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                *(pa.array([v], pa.list_(pa.int64())) for v in (
                    table.column("doc_id").to_pylist(), table.column("text_key").to_pylist(),
                    lengths))], schema=schema)
            block += 1

    rows = id_and_bytes(docs, id_col, text_col).select(
        F.col("doc_id").cast("long"), F.xxhash64("body").alias("text_key"), "body")
    return stage(rows.mapInArrow(run, POSTINGS), "postings")


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """``item, term``: the distinct terms of each row of ``items``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(*(column.to_pylist() for column in batch.columns)):
                terms = {w for words in pieces_of_words(body) for w in words}
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(terms), pa.int64()),
                    pa.array(sorted(terms), pa.binary()).cast(pa.string())],
                    names=["item", "term"])

    return id_and_bytes(items, "_item", text_col).mapInArrow(run, "item long, term string")


# ---- trees ----------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes over the columns of ``order``, parents before children; a node covers the columns
    from ``low`` to ``high`` and has two children, or none (-1).  ``most`` has a column of
    coordinate maxima per node."""

    order: np.ndarray
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    most: np.ndarray | None = None


def build_tree(matrix: np.ndarray, leaf: int, scale: np.ndarray | None = None) -> Tree:
    """Columns split at the mean of the coordinate that varies most (times ``scale``); in the
    middle of their order where that leaves less than an eighth on a side."""
    tree = Tree(np.arange(matrix.shape[1]))
    squared = 1.0 if scale is None else scale.astype(np.float64) ** 2
    open_nodes = [(0, matrix.shape[1], -1, False)]
    while open_nodes:
        low, high, parent, on_right = open_nodes.pop()
        node = len(tree.low)
        for values, v in ((tree.low, low), (tree.high, high), (tree.left, -1), (tree.right, -1)):
            values.append(v)
        if parent >= 0:
            (tree.right if on_right else tree.left)[parent] = node
        if high - low <= leaf:
            continue
        columns = tree.order[low:high]
        middle = (low + high) // 2
        if len(matrix):
            inside = matrix[:, columns].astype(np.float32)
            pivot = inside[int(np.argmax(squared * inside.var(1)))]
            by_value = np.argsort(-pivot, kind="stable")
            above = int((pivot > pivot.mean()).sum())
            if 8 * min(above, high - low - above) >= high - low:
                middle = low + above
            tree.order[low:high] = columns[by_value]
        open_nodes += [(middle, high, node, True), (low, middle, node, False)]
    tree.most = np.zeros((matrix.shape[0], len(tree.low)), matrix.dtype)
    for node in range(len(tree.low) - 1, -1, -1):
        if tree.left[node] < 0:
            inside = tree.order[tree.low[node]:tree.high[node]]
            tree.most[:, node] = matrix[:, inside].max(1, initial=0)
        else:
            np.maximum(tree.most[:, tree.left[node]], tree.most[:, tree.right[node]],
                       out=tree.most[:, node])
    return tree


class ItemTree:
    """Items of a chunk, the best documents they have met, and what more they would take."""

    def __init__(self, rows: list[tuple[int, list[str], list[int], int]], k: int, leaf: int):
        self.k, self.items = k, [r[0] for r in rows]
        self.coordinates: dict[str, int] = {}
        for _, terms, _, _ in rows:
            for t in terms:
                self.coordinates.setdefault(t, len(self.coordinates))
        # sums of products below 2^53 are exact in floating point
        heaviest = max((sum(r[2]) for r in rows), default=0)
        self.dtype = np.float64 if heaviest * 10**6 < 1 << 53 else np.int64
        weights = np.zeros((len(self.coordinates), len(rows)), self.dtype)
        for column, (_, terms, values, _) in enumerate(rows):
            weights[[self.coordinates[t] for t in terms], column] = values
        self.tree = build_tree(weights, leaf)
        self.nodes = []
        for node in range(len(self.tree.low)):
            inside = np.flatnonzero(self.tree.most[:, node])
            columns = self.tree.order[self.tree.low[node]:self.tree.high[node]]
            leaf_weights = weights[np.ix_(inside, columns)] if self.tree.left[node] < 0 else None
            self.nodes.append((inside, self.tree.most[inside, node], columns, leaf_weights))
        self.best: list[list[tuple]] = [[] for _ in rows]
        self.needed = np.array([r[3] for r in rows], np.int64)

    def offer(self, column: int, score: int, doc_id: int | None, text_key: int) -> None:
        """Keep the document if it is among the best k: by score, then id (null last)."""
        best = self.best[column]
        insort(best, (-score, doc_id is None, doc_id or 0, text_key))
        if len(best) > self.k:
            best.pop()
        if len(best) == self.k:
            self.needed[column] = max(self.needed[column], -best[-1][0])

    def found(self) -> Iterator[tuple[int, int, int | None, int]]:
        for item, best in zip(self.items, self.best):
            for score, null, doc_id, text_key in best:
                yield item, -score, None if null else doc_id, text_key


def search_tile(items: ItemTree, present: np.ndarray, matrix: np.ndarray, doc_ids: list,
                text_keys: list, leaf_docs: int) -> int:
    """Offer the documents of ``matrix`` (a row per coordinate in ``present``, a column per
    document) to the items; returns how many pairs of leaves were scored."""
    tree = items.tree
    docs = build_tree(matrix, leaf_docs, tree.most[present, 0])
    row_of = np.full(len(items.coordinates), -1)
    row_of[present] = np.arange(len(present))
    here: dict[int, tuple[np.ndarray, np.ndarray, list[float]]] = {}

    def bounds(node: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Of an item node: rows it meets, which of its coordinates, and its bounds with all
        document nodes."""
        if node not in here:
            inside, most, _, _ = items.nodes[node]
            rows = row_of[inside]
            some = np.flatnonzero(rows >= 0)
            rows = rows[some]
            here[node] = (rows, some,
                          (most[some] @ docs.most[rows].astype(items.dtype)).tolist())
        return here[node]

    scored, stack = 0, [(0, 0)]
    while stack:
        a, b = stack.pop()
        rows, some, limit = bounds(a)
        _, _, columns, weights = items.nodes[a]
        if limit[b] <= 0 or limit[b] < items.needed[columns].min():
            continue
        if tree.left[a] < 0 and docs.left[b] < 0:
            scored += 1
            inside = docs.order[docs.low[b]:docs.high[b]]
            scores = weights[some].T @ matrix[np.ix_(rows, inside)].astype(items.dtype)
            enough = scores >= np.maximum(items.needed[columns], 1)[:, None]
            for i, j in zip(*(x.tolist() for x in np.nonzero(enough))):
                score = int(scores[i, j])
                if score >= items.needed[columns[i]]:
                    items.offer(int(columns[i]), score, doc_ids[inside[j]], text_keys[inside[j]])
            continue
        of_a = [a] if tree.left[a] < 0 else [tree.left[a], tree.right[a]]
        of_b = [b] if docs.left[b] < 0 else [docs.left[b], docs.right[b]]
        pairs = [(x, y) for x in of_a for y in of_b]
        # the last is opened first
        stack += sorted(pairs, key=lambda p: bounds(p[0])[2][p[1]])
    return scored


def search_block(items: ItemTree, documents: dict, postings: list[dict], n_docs: int,
                 n_terms: int, leaf_docs: int, tile_cells: int) -> None:
    """All documents of a block against the items of a chunk."""
    lengths = documents["lengths"]
    # 64-bit unless a product is longer
    wide = object if 90 * max(lengths) * n_docs >= 1 << 63 else np.int64
    spread = 10 + (90 * np.array(lengths, wide) * n_docs // max(n_terms, 1)).astype(np.int64)
    sizes = np.array([p["n"] for p in postings], np.int64)
    steps = unpack(b"".join(p["docs"] for p in postings))
    counts = unpack(b"".join(p["counts"] for p in postings))
    ends = np.cumsum(sizes)
    running = np.cumsum(steps)
    before = np.concatenate(([0], running[ends[:-1] - 1])) if len(ends) else ends
    doc = running - np.repeat(before, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    values = 1_000_000_000 * counts // (1000 * counts + 8 * spread[doc])
    present = np.array([items.coordinates[p["term"]] for p in postings], np.int64)
    by_doc = np.argsort(doc, kind="stable")
    doc, row, values = doc[by_doc], row[by_doc], values[by_doc]
    step = max(1, tile_cells // max(1, len(postings)))
    for low in range(0, len(lengths), step):
        a, b = np.searchsorted(doc, [low, low + step])
        if a == b:
            continue
        # columns for documents with a term only; values are below 10^6, exact in 32 bits
        inside, column = np.unique(doc[a:b], return_inverse=True)
        matrix = np.zeros((len(postings), len(inside)), np.float32)
        matrix[row[a:b], column] = values[a:b]
        search_tile(items, present, matrix, [documents["doc_ids"][i] for i in inside],
                    [documents["text_keys"][i] for i in inside], leaf_docs)


def search_rows(rows: DataFrame, n_docs: int, n_terms: int, k: int, leaf_items: int,
                leaf_docs: int, tile_cells: int) -> DataFrame:
    """``FOUND``: per chunk and slot at most ``k`` documents for each item.

    ``rows`` (``ROWS``) has, for every chunk and slot, the chunk's items (block -1), and per
    block its documents (no term) and postings.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key = block = items = documents = None
        given: list[tuple] = []
        postings: list[dict] = []

        def close_block() -> None:
            nonlocal items, documents
            if items is None:
                items = ItemTree(given, k, leaf_items)
            if documents is not None and postings:
                search_block(items, documents, postings, n_docs, n_terms, leaf_docs, tile_cells)
            documents = None
            postings.clear()

        def results() -> pa.RecordBatch:
            close_block()
            columns = list(zip(*items.found())) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              names=[c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["chunk"], r["slot"])
                if key != run_key:
                    if run_key is not None:
                        yield results()
                    run_key, block, items, documents, given = key, -1, None, None, []
                if r["block"] < 0:
                    given.append((r["item"], r["terms"], r["weights"], r["floor"]))
                    continue
                if r["block"] != block:
                    close_block()
                    block = r["block"]
                if r["term"] is None:
                    documents = r
                else:
                    postings.append(r)
        if run_key is not None:
            yield results()

    ordered = rows.repartition("chunk", "slot").sortWithinPartitions(
        "chunk", "slot", "block", F.col("term").asc_nulls_first(), "item")
    return ordered.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "text_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                   max_wanted: int = MAX_WANTED, chunk_items: int = CHUNK_ITEMS,
                   chunk_terms: int = CHUNK_TERMS, leaf_items: int = LEAF_ITEMS,
                   leaf_docs: int = LEAF_DOCS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """The ``k`` documents of the highest score above 0 for each item: the item's id (under its
    own name), ``rank`` from 1, ``doc_id, score``.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) of the N documents that have a
    term; a document's score sums weight * (10^9 tf div (1000 tf + 8 m)) over the item's distinct
    terms, with m = 10 + 90 n N div L for n terms of the document and L of all.

    Equal scores are ranked by id (null last), then by the XXH64 of the text.  Null texts have
    no terms: such documents are not ranked, such items have no rows.  Every row of either
    table counts: repeated documents are ranked one after the other, rows that share an item id
    have ranks of their own.  Other columns are ignored; empty tables give no rows.
    """
    own = free_name(items.columns, "_row")
    kept = stage(items.select(F.col(f"`{item_col}`").alias("id"),
                              F.col(f"`{item_text_col}`").alias("text"),
                              F.monotonically_increasing_id().alias(own))
                 .select("id", "text", F.col(own).alias("_item")), "items")
    terms = stage(item_terms(kept, "text"), "item-terms")
    vocabulary = terms.select("term").distinct()
    few = vocabulary.limit(max_wanted + 1).count() <= max_wanted
    wanted = sorted(r["term"] for r in vocabulary.collect()) if few else None
    index = build_postings(docs, wanted, id_col, text_col, block_bytes)

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    blocks = index.where("term IS NULL")
    n_docs, n_terms = blocks.select(F.explode("lengths").alias("n")).agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = index.where("term IS NOT NULL")
    counts = postings.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000.0 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = counts.select("term", weight.cast("long").alias("weight")).where("weight > 0")
    weighed = terms.join(small(weights), "term")
    size = weighed.agg(F.count("*"), F.count_distinct("item")).first()
    chunks = max(-(-size[1] // chunk_items), -(-size[0] // chunk_terms), 1)
    pair = F.struct("term", "weight")
    chunked = stage(weighed.groupBy("item").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
                    .select("item", F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int")
                            .alias("chunk"), F.col("pairs.term").alias("terms"),
                            F.col("pairs.weight").alias("weights")), "chunks")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot")
    chunk_vocabulary = chunked.select("chunk", F.explode("terms").alias("term")).distinct()
    wanted_postings = postings.join(small(chunk_vocabulary), "term").select("*", slot)
    every_block = blocks.select(
        "*", slot, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    names = [c.split()[0] for c in ROWS.split(", ")]

    def rows(floors: DataFrame, first: bool) -> DataFrame:
        """What the first slot searches, or all others."""
        part = F.col("slot") == 0 if first else F.col("slot") > 0
        given = chunked.join(floors, "item", "left").select(
            "*", F.lit(-1).cast("long").alias("block"), F.explode(
                F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.lit(slots - 1))
            ).alias("slot")).withColumn("floor", F.coalesce("floor", F.lit(0)))
        blank = docs.sparkSession.createDataFrame([], ROWS)
        both = blank.unionByName(given, allowMissingColumns=True)
        both = both.unionByName(every_block.where(part), allowMissingColumns=True)
        both = both.unionByName(wanted_postings.where(part), allowMissingColumns=True)
        return both.select(names)

    def search(floors: DataFrame, first: bool) -> DataFrame:
        return stage(ranked(search_rows(rows(floors, first), n_docs, n_terms, k, leaf_items,
                                        leaf_docs, tile_cells), k), "found")

    found = search(chunked.select("item", F.lit(0).cast("long").alias("floor")), True)
    if slots > 1:
        # k documents of the first slot bound from below what the others must reach
        full = found.where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
        found = ranked(found.drop("rank").unionByName(search(full, False).drop("rank")), k)
    return found.join(kept.select(F.col("_item").alias("item"), F.col("id").alias("_id")), "item") \
        .select(F.col("_id").alias(item_col), F.col("rank").cast("int").alias("rank"),
                "doc_id", "score")
