"""Labelled account files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.constants import SOURCE_FILES
from riskweave.functions.text import missing_to_null
from riskweave.operators.merge import ROW_ORDER


# A quoted field, from its separator to the next: what a line has of quotes beyond such fields may
# open a field that ends on a later line.
_QUOTED_FIELD = '(^|,)"(?:[^"]|"")*+"(?=,|$)'


def _unsplittable(spark: SparkSession, path: str) -> set[str]:
    """Files at ``path`` that may not be read line by line: a quote is left open on a line or
    stands inside an unquoted field, a carriage return stands inside a line, or a line has
    nothing but blanks (which only a reader of whole files returns as a row)."""
    line = F.regexp_replace(F.col("value"), "\\r$", "")
    odd = (
        F.regexp_replace(line, _QUOTED_FIELD, "$1").contains('"') | line.contains("\r")
        | line.rlike("^[\\x00-\\x20]+$")
    )
    lines = spark.read.option("lineSep", "\n").text(path)
    # one row per file at most reaches the driver
    found = lines.where(odd).select(F.col("_metadata.file_path").alias("file")).distinct()
    return {unquote(r["file"]) for r in found.collect()}


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files at ``path``, those with one and the same first line together."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    ).where("block = 0")
    # one row per file reaches the driver, like in any file listing
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header")).collect()
    groups: dict[str, list[str]] = {}
    for r in sorted(first, key=lambda r: r["file"]):
        groups.setdefault(r["header"], []).append(unquote(r["file"]))
    return list(groups.values())


def read_delimited(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A delimited file (or folder of them) as text columns, missing tokens as NULL.

    Quotes are escaped by doubling.  Files whose headers differ are read by their own and
    united by column name; a column that a file does not have is NULL there.
    Files are split into tasks.  Line breaks inside quotes are accepted: a pass over the lines
    finds the files that may have some, and each of these is read by one task.  ``multi_line``
    True reads all files so, False none, both without that pass.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
    try:
        whole = _unsplittable(spark, path) if multi_line is None else set()
        groups = []
        for files in _by_header(spark, path):
            for many in (True, False):
                some = [f for f in files if (f in whole if multi_line is None
                                             else multi_line) == many]
                if some:
                    groups.append((some, many))
        if len(groups) < 2:
            groups = [([path], groups[0][1] if groups else bool(multi_line))]
        heads = [reader.option("multiLine", many).csv(files).columns for files, many in groups]
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"No file at {path}") from exc
        raise
    # position: file, split, then reading order inside the split
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = []
    for (files, many), names in zip(groups, heads):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(reader.option("multiLine", many).schema(schema).csv(files).select(
            *[missing_to_null(F.col(f"`{n}`")).alias(n) for n in names],
            position.alias(ROW_ORDER),
        ))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_sources(spark: SparkSession, folder: str,
                 files: Sequence[str] = SOURCE_FILES, multi_line: bool | None = None
                 ) -> list[DataFrame]:
    """The labelled sources in their fixed order."""
    return [
        read_delimited(spark, f"{folder.rstrip('/')}/{name}", multi_line) for name in files
    ]
