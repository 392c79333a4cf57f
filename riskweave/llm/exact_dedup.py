"""Exact duplicates by two passes over a Bloom filter, with DataFrame functions only.

Pass one counts, per bit position, how many rows set it; positions set at least twice form
the filter of possibly repeated texts.  In pass two a row whose positions are not all in
the filter is certainly alone and goes straight through; the others, and only they, are
grouped by the digest of their text.

The filter of one segment holds at most ``MAX_FILTER_BITS`` bits (64 MB), which is what is
broadcast.  More rows than that serves are split by digest into more segments, each with a
filter of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import SPACE_RUN, free_name
from riskweave.session import stage, stage_path

BITS_PER_ROW = 8
MAX_FILTER_BITS = 1 << 29
# Bits in one row of bitmap_construct_agg; fixed by Spark.
BITMAP_BITS = 32768
SEEDS = (11, 23)


def normalised(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


@dataclass(frozen=True)
class RepeatFilter:
    """Bit positions that at least two rows set: rows (bucket, bits) of 4 KB each."""

    bits: int
    bitmaps: DataFrame

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(s)), F.lit(self.bits)) for s in SEEDS]

    def mark(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        """Add ``flag``: whether the row's text may occur more than once."""
        names: list[str] = []
        for i in range(len(SEEDS)):
            names.append(free_name([*rows.columns, *names], f"_{flag}_{i}"))
        out = rows.withColumns(dict(zip(names, self.positions(F.col(key)))))
        tests = []
        for name in names:
            bucket = free_name(out.columns, f"{name}_bucket")
            bitmap = free_name([*out.columns, bucket], f"{name}_bitmap")
            table = self.bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bitmap))
            out = out.join(
                F.broadcast(table), F.expr(f"`{name}` div {BITMAP_BITS}") == F.col(bucket), "left"
            )
            offset = F.pmod(F.col(name), F.lit(BITMAP_BITS)).cast("int")
            byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(offset / 8).cast("int") + 1,
                                            F.lit(1))), 16, 10).cast("int")
            tests.append(F.coalesce(F.getbit(byte, offset % 8) == 1, F.lit(False)))
        columns = [F.col(f"`{c}`") for c in rows.columns]
        repeated = tests[0]
        for test in tests[1:]:
            repeated = repeated & test
        return out.select(*columns, repeated.alias(flag))


def repeat_filter(rows: DataFrame, key: str, bits: int) -> RepeatFilter:
    """Pass one.  Positions are counted map-side first, so a text that fills a third of the
    rows arrives as a few counts; what remains is at most ``bits`` bits."""
    empty = RepeatFilter(bits, rows)
    positions = rows.select(F.explode(F.array(*empty.positions(F.col(key)))).alias("position"))
    often = positions.groupBy("position").agg(F.count("*").alias("n")).where("n > 1")
    bitmaps = often.groupBy(F.expr(f"position div {BITMAP_BITS}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("position", F.lit(BITMAP_BITS))).alias("bits")
    )
    return RepeatFilter(bits, stage(bitmaps, "repeats"))


def _filter_bits(n: int, bits_per_row: int, max_bits: int) -> tuple[int, int]:
    """Bits of each filter (a power of two) and how many segments the rows need."""
    wanted = max(BITMAP_BITS, n * bits_per_row)
    segments = -(-wanted // max_bits)
    return min(max_bits, 1 << (-(-wanted // segments) - 1).bit_length()), segments


def _segments(rows: DataFrame, count: int) -> list[DataFrame]:
    """The staged ``rows`` cut by digest; each part is read from its own files."""
    if count == 1:
        return [rows]
    part = F.pmod(F.xxhash64("sha", F.lit(5)), F.lit(count)).cast("int")
    cut = stage(rows.withColumn("segment", part), "segments", ("segment",))
    return [cut.where(F.col("segment") == i).select(*rows.columns) for i in range(count)]


def _copies(marked: DataFrame) -> DataFrame:
    """Per repeated digest: the smallest document, how many rows, and the one row to keep."""
    order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    return (
        marked.where("maybe").groupBy("sha")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
             F.min_by("row_id", order).alias("keep_row"))
    )


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = BITS_PER_ROW,
                max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their white-space-normalised forms have one SHA-256.  Of equal texts
    the row with the smallest ``doc_id`` is kept; of rows that also share that id, exactly one.
    A null text is the empty text; a null id sorts last and is the group's ``keep_id`` only if
    all its ids are null.  An empty table gives no rows; other columns are ignored.  Ids are
    integers.
    """
    if max_filter_bits < BITMAP_BITS:
        raise ValueError(f"A filter has at least {BITMAP_BITS} bits")
    rows = stage(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row_id"),
            digest(F.col(f"`{text_col}`")).alias("sha"),
        ),
        "digests",
    )
    bits, count = _filter_bits(rows.count(), bits_per_row, max_filter_bits)
    path = stage_path(docs.sparkSession, "copies")
    for i, part in enumerate(_segments(rows, count)):
        marked = repeat_filter(part, "sha", bits).mark(part, "sha", "maybe")
        if i == 0 and count == 1:
            return _decisions(marked)
        _decisions(marked).write.parquet(f"{path}/segment={i}")
    return docs.sparkSession.read.parquet(path).drop("segment")


def _decisions(marked: DataFrame) -> DataFrame:
    # stored, so that the join has a plain exchange on either side: adaptive execution can then
    # split the partition of a text that fills a third of the rows
    groups = stage(_copies(marked), "groups")
    grouped = (
        marked.where("maybe").join(groups, "sha")
        .select("doc_id", "keep_id", "group_size",
                (F.col("row_id") == F.col("keep_row")).alias("kept"), "sha")
    )
    alone = marked.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    return grouped.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = BITS_PER_ROW,
                max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns as they were.

    Same rules as ``find_copies``.  Rows that the filter clears never shuffle.  Of the
    others, those with the smallest id of their text stay; they move by text and id.
    ``docs`` is read twice, so pass a stored table.  With more than one segment its rows are
    first written by segment, which takes no shuffle either.
    """
    sha, maybe, ident = (free_name(docs.columns, n) for n in ("_sha", "_maybe", "_ident"))
    keyed = docs.withColumns({sha: digest(F.col(f"`{text_col}`")),
                              ident: F.col(f"`{id_col}`").cast("long")})
    rows = stage(
        keyed.select(F.col(ident).alias("doc_id"), F.lit(0).cast("long").alias("row_id"),
                     F.col(sha).alias("sha")), "digests")
    bits, count = _filter_bits(rows.count(), bits_per_row, max_filter_bits)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if count == 1:
        return _first_rows(keyed, rows, bits, sha, maybe, ident).select(*columns)
    segment = free_name(keyed.columns, "_segment")
    part = F.pmod(F.xxhash64(sha, F.lit(5)), F.lit(count)).cast("int")
    cut = stage(keyed.withColumn(segment, part), "rows", (segment,))
    path = stage_path(docs.sparkSession, "kept")
    for i, narrow in enumerate(_segments(rows, count)):
        mine = cut.where(F.col(segment) == i).select(*keyed.columns)
        _first_rows(mine, narrow, bits, sha, maybe, ident).select(*columns).write.parquet(
            f"{path}/{segment}={i}")
    return docs.sparkSession.read.schema(docs.schema).parquet(path).select(*columns)


def _first_rows(keyed: DataFrame, narrow: DataFrame, bits: int, sha: str, maybe: str,
                ident: str) -> DataFrame:
    filter_ = repeat_filter(narrow, "sha", bits)
    first_sha, first_id = (free_name(keyed.columns, n) for n in ("_first_sha", "_first_id"))
    first = _copies(filter_.mark(narrow, "sha", "maybe")).select(
        F.col("sha").alias(first_sha), F.col("keep_id").alias(first_id))
    marked = filter_.mark(keyed, sha, maybe)
    firsts = (
        marked.where(F.col(maybe))
        .join(first, (F.col(sha) == F.col(first_sha))
              & F.col(ident).eqNullSafe(F.col(first_id)), "left_semi")
        .dropDuplicates([sha, ident])
    )
    return marked.where(~F.col(maybe)).unionByName(firsts)
