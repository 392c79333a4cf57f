"""Union of labelled sources and cleaning to one row per account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.constants import REQUIRED_COLUMNS
from riskweave.functions.ids import normalise_account_id
from riskweave.functions.numbers import completeness_rank, parse_double

SOURCE_ORDER = "_source_order"
ROW_ORDER = "_row_order"


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Columns not found: {missing}")


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Union by name with a source ordinal; absent columns are NULL.

    Every source brings ``_row_order`` (any orderable type, the same in all sources).
    A column whose type differs between sources travels as text.
    """
    types: dict[str, set] = {}
    for df in sources:
        require_columns(df)
        for field in df.schema:
            types.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = {name for name, seen in types.items() if len(seen) > 1}

    merged = None
    for position, df in enumerate(sources):
        as_text = {c: F.col(c).cast("string") for c in df.columns if c in mixed}
        part = df.withColumns({**as_text, SOURCE_ORDER: F.lit(position)})
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged


def with_identity(bronze: DataFrame) -> DataFrame:
    """Normalised ``account_id`` and integer ``label``, both NULL where invalid."""
    return bronze.withColumns({
        "account_id": normalise_account_id(F.col("account_id")),
        "label": parse_double(F.col("label"), bronze.schema["label"].dataType),
    }).withColumn("label", F.when(F.col("label").isin(0.0, 1.0), F.col("label").cast("int")))


def valid_row() -> Column:
    return F.col("account_id").isNotNull() & F.col("label").isNotNull()


def account_groups(bronze: DataFrame) -> DataFrame:
    """One row per account: row count, label range and the best row.

    A single aggregate on ``account_id``.  Each map task folds its own rows first, so an
    account that owns a third of the table still sends one row per map task.  The best
    row is a struct, which Spark folds in a sort aggregate: each task sorts its rows by
    account.  Without it (``best`` is pruned for a summary) it is a hash aggregate.  Rows
    without a valid id and label share the NULL account.
    """
    rows = with_identity(bronze)
    rank = (
        completeness_rank(
            F.col("feature_completeness"), bronze.schema["feature_completeness"].dataType
        )
        if "feature_completeness" in bronze.columns
        else F.lit(-1.0)
    )
    payload = [c for c in bronze.columns
               if c not in ("account_id", "label", SOURCE_ORDER, ROW_ORDER)]
    return (
        rows.withColumns({
            "_account": F.when(valid_row(), F.col("account_id")),
            # invalid rows bring no label, so their group never agrees with itself
            "_label": F.when(valid_row(), F.col("label")),
            "_precedence": F.struct(-rank, F.col(SOURCE_ORDER), F.col(ROW_ORDER)),
            "_payload": F.struct(*payload),
        })
        .groupBy(F.col("_account").alias("account_id"))
        .agg(
            F.count("*").alias("row_count"),
            F.min("_label").alias("min_label"),
            F.max("_label").alias("max_label"),
            F.min_by("_payload", "_precedence").alias("best"),
        )
    )


def agreeing_accounts(groups: DataFrame) -> DataFrame:
    """Clean accounts out of ``account_groups``: valid, conflict-free, best row each."""
    payload = groups.schema["best"].dataType.names
    return groups.where(F.col("min_label") == F.col("max_label")).select(
        "account_id", F.col("min_label").alias("label"),
        *[F.col("best")[name].alias(name) for name in payload],
    )


def conflicting_accounts(groups: DataFrame) -> DataFrame:
    """Accounts whose valid labels disagree, with their number of distinct labels."""
    return groups.where(F.col("min_label") != F.col("max_label")).select(
        # labels are 0 or 1, so a disagreement is always two of them
        "account_id", F.lit(2).cast("bigint").alias("distinct_labels"), "row_count"
    )


def summary_columns() -> list[Column]:
    """What cleaning removed and kept, as aggregates over ``account_groups``."""
    known = F.col("account_id").isNotNull()
    agrees = F.col("min_label") == F.col("max_label")

    def total(condition: Column, amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0))

    return [
        total(~known, F.col("row_count")).alias("invalid_rows_removed"),
        F.count_if(known & ~agrees).alias("conflicting_account_ids_removed"),
        total(known & agrees, F.col("row_count") - 1).alias("duplicate_rows_removed"),
        F.count_if(known & agrees).alias("clean_account_count"),
    ]


def summarise(groups: DataFrame) -> DataFrame:
    """One row: what cleaning removed and kept."""
    return groups.agg(*summary_columns())


def clean_accounts(bronze: DataFrame) -> DataFrame:
    return agreeing_accounts(account_groups(bronze))


def label_conflicts(bronze: DataFrame) -> DataFrame:
    return conflicting_accounts(account_groups(bronze))


def cleaning_summary(bronze: DataFrame) -> DataFrame:
    return summarise(account_groups(bronze))


def repeated_ids(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def first_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a column, text when the frame does not have it."""
    return df.schema[name].dataType if name in df.columns else T.StringType()
