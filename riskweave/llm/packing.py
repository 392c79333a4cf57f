"""Documents packed into training sequences of one length.

Texts are encoded and cut every ``capacity`` ids, so a full piece is a sequence and only what is
left of a document has to share one.  Pieces are stored, then dealt at random: a task sorts its
share by a hash of the piece and cuts it into groups of bounded size.  Each group is packed by
itself, first fit decreasing: pieces from the longest to the shortest go to the first bin that
has room, which a tournament tree of the bins' room finds in one descent.

First fit leaves some room.  The emptiest bins, beyond those that the group's ids can fill, are
therefore taken apart, and their pieces are cut into the room of the others.  What is left over
at the end of a group becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_and_bytes, regroup
from riskweave.llm.token_files import BLOCK_BYTES, byte_level, id_type, kept_encoder
from riskweave.session import stage

CAPACITY = 2048
# Ids and pieces of one group at most (a group holds one piece at least).
GROUP_IDS = 2 << 20
GROUP_PIECES = 1 << 16
SEED = 11

PIECES = "row long, doc_id long, doc_tokens long, start long, ids binary"
PACKED = ("sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, "
          "ids binary, ids_crc32 long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item.  Items go from the longest to the shortest (equal ones in their
    order) to the first bin with room for them."""
    sizes = lengths.tolist()
    # of two bins in a row at most one is less than half full
    bins = min(len(sizes), 2 * sum(sizes) // capacity + 2)
    leaves = 1 << max(0, bins - 1).bit_length()
    room = [capacity] * (2 * leaves)  # a node has the most room of the bins below it
    placed = np.zeros(len(sizes), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        placed[item] = node - leaves
        room[node] -= size
        while node > 1:
            node >>= 1
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return placed


def powers_of_two(n: int) -> list[int]:
    """Powers of two that add up to ``n``, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_group(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``item, begin, length, sequence, offset`` of every part, in the order of sequences.

    All sequences but the last few are full; those have powers of two as lengths.
    """
    placed = first_fit_decreasing(lengths, capacity)
    loads = np.bincount(placed, lengths).astype(np.int64)
    by_load = np.argsort(-loads, kind="stable")
    full, rest = divmod(int(lengths.sum()), capacity)
    sequence_of = np.full(len(loads), -1)
    sequence_of[by_load[:full]] = np.arange(full)
    loose = [(i, 0, int(lengths[i])) for i in np.flatnonzero(sequence_of[placed] < 0).tolist()]
    loose.reverse()

    def fill(sequence: int, offset: int, end: int) -> Iterator[tuple[int, int, int, int, int]]:
        while offset < end:
            item, begin, size = loose.pop()
            taken = min(size, end - offset)
            if taken < size:
                loose.append((item, begin + taken, size - taken))
            yield item, begin, taken, sequence, offset
            offset += taken

    parts, used = [], [0] * full
    for item in np.argsort(placed, kind="stable").tolist():
        sequence = int(sequence_of[placed[item]])
        if sequence >= 0:
            parts.append((item, 0, int(lengths[item]), sequence, used[sequence]))
            used[sequence] += int(lengths[item])
    for sequence, offset in enumerate(used):
        parts += fill(sequence, offset, capacity)
    for sequence, size in enumerate(powers_of_two(rest), full):
        parts += fill(sequence, 0, size)
    return sorted(parts, key=lambda p: p[3:])


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str,
                  capacity: int) -> tuple[DataFrame, str]:
    """``PIECES``, stored, and the type of an id: the ids of every text and the end id, cut
    every ``capacity`` ids.  ``row`` tells the rows of ``docs`` apart."""
    with open(tokenizer_path, encoding="utf-8") as file:
        rules = file.read()
    if not byte_level(rules):
        raise ValueError("Only byte-level tokenizers without a normalizer are supported")
    dtype = id_type(rules, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        width = np.dtype(dtype).itemsize
        step, encoder = capacity * width, None
        gc.disable()
        try:
            for table in regroup(batches, BLOCK_BYTES):
                encoder = encoder or kept_encoder(rules, np.dtype(dtype), end_id)
                rows, ids, totals, starts, packed = [], [], [], [], []
                texts = [b.decode() for b in table.column("body").to_pylist()]
                for doc, found in zip(table.column("doc_id").to_pylist(), encoder.encode(texts)):
                    for at in range(0, len(found), step):
                        rows.append(row)
                        ids.append(doc)
                        totals.append(len(found) // width)
                        starts.append(at // width)
                        packed.append(found[at:at + step])
                    row += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows, pa.int64()), pa.array(ids, pa.int64()),
                    pa.array(totals, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(packed, pa.binary())],
                    names=["row", "doc_id", "doc_tokens", "start", "ids"])
        finally:
            gc.enable()

    rows = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return stage(rows.mapInArrow(run, PIECES), "pieces"), dtype


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                   group_ids: int = GROUP_IDS, seed: int = SEED) -> DataFrame:
    """One row per piece: ``sequence_id, offset`` (in its sequence), ``doc_id, start`` (ids of
    its document before it), ``length, doc_tokens`` (with the end id), ``ids`` (little-endian,
    as wide as the vocabulary needs) and ``ids_crc32`` (of the ids as unsigned 32-bit integers).

    Every id of every text, and ``end_id`` after each, is in exactly one piece.  Sequences hold
    ``capacity`` ids, or a power of two at the end of a group, so nothing is padded.
    A null text is empty: its only id is the end id.  Null ids, repeated ids and repeated rows
    are documents of their own.  Equal lengths keep the random order of their group.  Other
    columns are ignored; an empty table gives no rows.

    A group is what a task holds in memory.  Groups are runs of at most ``group_ids`` ids in the
    order of a hash, so neither a very long text nor a frequent one makes a large group.
    """
    pieces, dtype = encode_pieces(docs, tokenizer_path, end_id, id_col, text_col, capacity)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        width = np.dtype(dtype).itemsize
        return regroup(batches, group_ids * width, "ids", GROUP_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        for table in groups(batches):
            ids = table.column("ids").combine_chunks()
            sizes = pa.compute.binary_length(ids).to_numpy(zero_copy_only=False)
            width = np.dtype(dtype).itemsize
            flat = np.frombuffer(b"".join(ids.to_pylist()), dtype)
            lengths = sizes.astype(np.int64) // width
            begins = np.cumsum(lengths) - lengths
            item, begin, length, of, offset = np.array(
                pack_group(lengths, capacity), np.int64).T
            chosen = np.ascontiguousarray(item)
            at = (begins[chosen] + begin).tolist()
            packed = [flat[a:a + n] for a, n in zip(at, length.tolist())]
            column = {c: table.column(c).to_numpy()[chosen] for c in ("start", "doc_tokens")}
            yield pa.RecordBatch.from_arrays([
                pa.array(of + sequence), pa.array(np.ascontiguousarray(offset)),
                table.column("doc_id").combine_chunks().take(pa.array(chosen)),
                pa.array(column["start"] + begin), pa.array(np.ascontiguousarray(length)),
                pa.array(column["doc_tokens"]),
                pa.array([p.tobytes() for p in packed], pa.binary()),
                pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in packed], pa.int64())],
                names=[c.split()[0] for c in PACKED.split(", ")])
            sequence += int(of[-1]) + 1

    order = F.xxhash64(F.lit(seed), "row", "start")
    dealt = pieces.withColumn("_order", order).repartition("_order")
    return dealt.sortWithinPartitions("_order", "row", "start").drop("_order").mapInArrow(
        run, PACKED)
