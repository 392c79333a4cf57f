"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Space and the control characters from tab to carriage return.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_bytes(text_col: str) -> Column:
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, whatever else the table carries: ``doc_id`` and ``body`` (UTF-8)."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("body"))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "body",
           max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` of a piece holds ``max_bytes`` or a single row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def regroup(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "body",
            max_rows: int = 65536) -> Iterator[pa.Table]:
    """Put Arrow batches together to blocks of about ``max_bytes`` in ``column``."""
    held, size, rows = [], 0, 0
    for batch in slices(batches, max_bytes, column, max_rows):
        n = int(pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0)
        if held and (size + n > max_bytes or rows + batch.num_rows > max_rows):
            yield pa.Table.from_batches(held)
            held, size, rows = [], 0, 0
        held.append(batch)
        size, rows = size + n, rows + batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
