"""Sinks for the generated splits and the demo accounts, in order of the id text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.constants import PRIVATE_COLUMNS

SPLITS = ("train", "validation", "test")


def write_splits(split: DataFrame, path: str) -> None:
    """One folder per split; its files, in order of their names, are one list of rows in order
    of the id text."""
    (
        split.repartitionByRange("split", "account_id").sortWithinPartitions("split", "account_id")
        .write.mode("overwrite").partitionBy("split").parquet(path)
    )


def read_split(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All splits, or one of them by partition pruning."""
    df = spark.read.parquet(path)
    return df if name is None else df.where(df["split"] == name)


def write_demo(demo: DataFrame, path: str) -> None:
    """Rows in order of the id text over all files."""
    exposed = set(PRIVATE_COLUMNS) & set(demo.columns)
    if exposed:
        raise AssertionError(f"Private columns in a demo sample: {sorted(exposed)}.")
    (
        demo.repartitionByRange("account_id").sortWithinPartitions("account_id")
        .write.mode("overwrite").parquet(path)
    )


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of sorted files with their ``place``: places grow as the rows do in the files' list,
    file by file in order of the names.  Spark itself reads large files first."""
    return rows.withColumn("place", F.struct(
        F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def export_csv(df: DataFrame, path: str, ordered: bool = True) -> None:
    """Delimited export, quotes doubled and blanks kept; sorted by id text if ``ordered``."""
    rows = df.orderBy("account_id") if ordered else df
    (
        rows.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
