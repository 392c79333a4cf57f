"""Near duplicates by SimHash: fingerprints, a binary-trie self-join, linked components.

Two fingerprints within ``k`` bits agree on at least one of ``k + 1`` bit blocks.  So for
each block there is a trie over the fingerprints rotated to begin with that block, and the
self-join of that trie starts at the nodes where the block ends: any pair of different nodes
there has spent an error on every other block too, or is found in another trie.  From such a
node the join walks pairs of nodes together, one bit at a time, adds up the bits in which the
two paths differ, and prunes a pair as soon as the sum exceeds ``k``.

Node pairs with many fingerprints are first split into their child pairs as Spark rows, four
bits a round, until none has more than ``MAX_NODE``; tasks then walk bounded subtries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import free_name, id_and_bytes, slices, text_bytes
from riskweave.llm.components import connected
from riskweave.session import stage

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
# Fingerprints below one pair of nodes that a task walks at a time.
MAX_NODE = 16_384
# Node pairs of one level that a task holds at a time.
MAX_FRONTIER = 400_000
SPLIT_BITS = 4
# Shingle digests counted at a time, so a very long text needs no more memory.
_CHUNK = 65_536


def fingerprint(body: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: A-Z lower-cased, words between white space, shingles of words joined
    by a space (repeats count), XXH64 with seed 42.  A bit is set if it is set in more than
    half of the shingles.  Fewer words than a shingle: one shingle of them all; none: zero."""
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle_words, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        span = zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in span), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_key, fp``: one row per row; ``fp`` is the fingerprint as a signed long and
    ``text_key`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            fps = [fingerprint(b, shingle_words) for b in batch.column("body").to_pylist()]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fps)],
                names=["doc_id", "text_key", "fp"])

    body = id_and_bytes(docs, id_col, text_col).select(
        F.col("doc_id").cast("long"), F.xxhash64("body").alias("text_key"), "body")
    return body.mapInArrow(run, "doc_id long, text_key long, fp long")


# ---- the join ---------------------------------------------------------------

def _blocks(k: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``k + 1`` blocks that cover 64 bits."""
    edges = [64 * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotated(first: int):
    fp = F.col("fp")
    if first == 0:
        return fp
    return F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, 64 - first))


def _roots(distinct: DataFrame, k: int) -> DataFrame:
    """A row per fingerprint and trie, below the pair (node, node) where its block ends."""
    entries = [
        F.struct(F.lit(t).alias("trie"), F.lit(width).alias("depth"),
                 F.shiftrightunsigned(_rotated(first), 64 - width).alias("u"),
                 F.shiftrightunsigned(_rotated(first), 64 - width).alias("v"),
                 F.lit(0).alias("side"), _rotated(first).alias("bits"))
        for t, (first, width) in enumerate(_blocks(k))
    ]
    return distinct.select(F.inline(F.array(*entries)))


PAIR = ["trie", "depth", "u", "v"]


def _children(rows: DataFrame, k: int) -> DataFrame:
    """The same fingerprints below the child pairs, ``SPLIT_BITS`` bits deeper.

    Side 0 marks rows of ``u`` (or of both, if the nodes are one), side 1 rows of ``v``.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT_BITS)
                      if m.bit_count() <= k])
    step = F.least(F.lit(SPLIT_BITS), F.lit(64) - F.col("depth"))
    own = F.expr(f"shiftrightunsigned(bits, 64 - depth - least({SPLIT_BITS}, 64 - depth)) "
                 f"& (shiftleft(1L, least({SPLIT_BITS}, 64 - depth)) - 1)")
    spent = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    expanded = (
        rows.select(*PAIR, "side", "bits", step.alias("step"), own.alias("own"),
                    spent.alias("spent"), F.explode(masks).alias("mask"))
        .where((F.bit_count("mask") + F.col("spent") <= k)
               & (F.col("mask") < F.expr("shiftleft(1L, step)")))
        .withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    )
    same = F.col("u") == F.col("v")
    up = lambda node: F.expr(f"shiftleft({node}, step)")
    left = F.when(same, F.least("own", "other")).when(F.col("side") == 0, F.col("own")) \
        .otherwise(F.col("other"))
    right = F.when(same, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")) \
        .otherwise(F.col("own"))
    side = F.when(same, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    return expanded.select(
        "trie", (F.col("depth") + F.col("step")).alias("depth"),
        up("u").bitwiseOR(left).alias("u"), up("v").bitwiseOR(right).alias("v"),
        side.alias("side"), "bits")


def _bounded(rows: DataFrame, k: int, max_node: int) -> DataFrame:
    """Rows below node pairs of at most ``max_node`` fingerprints that both sides have."""
    done = None
    while True:
        rows = stage(rows, "nodes")
        sizes = rows.groupBy(*PAIR).agg(
            F.count("*").alias("n"), F.sum("side").alias("n1"))
        useful = sizes.where(
            "CASE WHEN u = v THEN n > 1 ELSE n1 > 0 AND n1 < n END")
        small = rows.join(useful.where(f"n <= {max_node} OR depth = 64").select(*PAIR), PAIR,
                          "left_semi")
        done = small if done is None else done.unionByName(small)
        large = useful.where(f"n > {max_node} AND depth < 64").select(*PAIR)
        if large.isEmpty():
            return done
        rows = _children(rows.join(large, PAIR, "left_semi"), k)


def walk(bits: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, spent: np.ndarray,
         k: int, max_frontier: int = MAX_FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``k`` bits below the given pairs of trie nodes at ``depth``.

    ``bits`` (unsigned) is sorted within every node; a node is a range of it, and ``pairs`` is
    (start of u, end of u, start of v, end of v).  A node paired with itself has equal ranges.
    The frontier is cut when it grows beyond ``max_frontier`` and its parts are walked one
    after another, so memory stays bounded however dense the fingerprints are.
    """
    stack = [(depth, *pairs, spent)]
    while stack:
        depth, us, ue, vs, ve, err = stack.pop()
        same = us == vs
        live = np.where(same, ue - us > 1, (ue > us) & (ve > vs)) & (err <= k)
        us, ue, vs, ve, err, same = (x[live] for x in (us, ue, vs, ve, err, same))
        if not len(us):
            continue
        single = ~same & (ue - us == 1) & (ve - vs == 1)
        if single.any():
            i, j = us[single], vs[single]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= k
            if near.any():
                yield i[near], j[near]
            us, ue, vs, ve, err, same = (x[~single] for x in (us, ue, vs, ve, err, same))
            if not len(us):
                continue
        if depth == 64:  # equal fingerprints are one row, so each node is a single one
            continue
        if len(us) > max_frontier:
            half = len(us) // 2
            stack.append((depth, us[half:], ue[half:], vs[half:], ve[half:], err[half:]))
            stack.append((depth, us[:half], ue[:half], vs[:half], ve[:half], err[:half]))
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        um, vm = _middle(bits, us, ue, bit), _middle(bits, vs, ve, bit)
        apart = ~same
        stack.append((
            depth + 1,
            np.concatenate((us, um, us, um[apart])),
            np.concatenate((um, ue, um, ue[apart])),
            np.concatenate((vs, vm, vm, vs[apart])),
            np.concatenate((vm, ve, ve, vm[apart])),
            np.concatenate((err, err, err + 1, err[apart] + 1)),
        ))


def _middle(bits: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index of each range whose ``bit`` is set (the bits above it are equal)."""
    low, high = start.copy(), end.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        ones = (bits[np.minimum(mid, len(bits) - 1)] & bit) != 0
        low = np.where(open_ & ~ones, mid + 1, low)
        high = np.where(open_ & ones, mid, high)


class Forest:
    """Smallest index linked to each index; linked in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]


def links(distinct: DataFrame, k: int = MAX_DISTANCE, max_node: int = MAX_NODE) -> DataFrame:
    """Edges ``a, b`` between fingerprints that link all pairs within ``k`` differing bits.

    ``distinct`` has one row per fingerprint, column ``fp``.  Of the pairs that a task finds
    it returns the edges of a spanning forest, at most one per row it has read.
    """
    if not 0 <= k < 32:
        raise ValueError("The distance is 0 to 31 bits")
    rows = _bounded(_roots(distinct, k), k, max_node)
    starts = np.array([first for first, _ in _blocks(k)], np.uint64)

    def join_nodes(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).to_numpy() for c in (*PAIR, "side")}
        bits = table.column("bits").to_numpy().view(np.uint64)
        # the rows come by pair, side and fingerprint; a part is one side of one pair
        keys = np.stack([col[c].astype(np.int64) for c in (*PAIR, "side")])
        order = np.lexsort((bits, *keys[::-1]))
        bits, keys = bits[order], keys[:, order]
        new = np.ones(len(bits), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
        part = np.flatnonzero(new)
        part_end = np.append(part[1:], len(bits))
        trie, depth, u, v, side = keys[:, part]
        forest = Forest(len(bits))
        mirrored = np.flatnonzero((u != v) & (side == 0))
        alone = np.flatnonzero(u == v)
        first = np.concatenate((alone, mirrored))
        second = np.concatenate((alone, mirrored + 1))
        if len(mirrored):  # both sides must be here
            second = np.minimum(second, len(part) - 1)
            whole = (first == second) | (
                (keys[:4, part[first]] == keys[:4, part[second]]).all(0) & (side[second] == 1))
            first, second = first[whole], second[whole]
        for d in np.unique(depth[first]):
            at = depth[first] == d
            a, b = first[at], second[at]
            spent = np.bitwise_count(u[a] ^ v[a]).astype(np.int64)
            for i, j in walk(bits, (part[a], part_end[a], part[b], part_end[b]), int(d),
                             spent, k):
                forest.link(i, j)
        turn = starts[keys[0]]
        back = (np.uint64(64) - turn) % np.uint64(64)
        fp = np.where(turn == 0, bits, (bits >> turn) | (bits << back)).view(np.int64)
        member = np.flatnonzero(forest.root != np.arange(len(bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[forest.root[member]]), pa.array(fp[member])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 4 * max_node:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # keep the last, perhaps unfinished pair for the next round
            tail = np.ones(n, bool)
            for c in PAIR:
                x = table.column(c).to_numpy()
                tail &= x == x[-1]
            cut = int(np.flatnonzero(tail)[0])
            if cut:
                yield join_nodes(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield join_nodes(pa.Table.from_batches(held))

    ordered = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", "bits")
    return ordered.mapInArrow(run, "a long, b long").distinct()


# ---- components ---------------------------------------------------------------

def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE,
                    max_node: int = MAX_NODE) -> DataFrame:
    """One row per input row: ``doc_id, text_key, fp, component_id``.

    Documents are linked when their fingerprints differ in ``max_distance`` bits or fewer;
    ``component_id`` is the smallest id reachable.  Documents of one fingerprint are one node,
    so a group of copies of any size is one row in the join.  Null and wordless texts have
    fingerprint zero and are linked like any others; a null id sorts last.  Rows that share an
    id are rows of their own.  An empty table gives no rows; other columns are ignored.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    joined = connected(links(nodes.select("fp"), max_distance, max_node))
    grouped = (
        nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(grouped.join(smallest, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle_words: int = SHINGLE_WORDS,
                max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay, one per component, all columns as they were.

    The row with the component's smallest id stays; if several rows have that id, the one
    whose text has the smallest digest, and one of wholly equal rows.
    """
    found = stage(
        near_components(docs, id_col, text_col, shingle_words, max_distance), "near")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ident, key, several, own = (free_name(docs.columns, n) for n in (
        "_stay_id", "_stay_key", "_several", "_text_key"))
    stay = stage(first.groupBy(F.col("component_id").alias(ident)).agg(
        F.min("text_key").alias(key), (F.count("*") > 1).alias(several)), "stay")
    keyed = docs.withColumn(own, F.xxhash64(text_bytes(text_col)))
    kept = keyed.join(
        stay, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(ident))
        & (F.col(own) == F.col(key)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = kept.where(~F.col(several)).select(*columns)
    if stay.where(F.col(several)).isEmpty():
        return alone
    # a component's rows of one id and text: ids and keys decide, a null text being empty
    return alone.unionByName(
        kept.where(F.col(several)).dropDuplicates([ident, key]).select(*columns))
