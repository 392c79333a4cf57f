"""Account listing and readiness report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.constants import LIST_DEFAULT, LIST_LIMITS
from riskweave.functions.text import optional_text


def list_accounts(accounts: DataFrame, limit: int = LIST_DEFAULT) -> DataFrame:
    """The first ``limit`` accounts by id text: id, source and username."""
    lowest, highest = LIST_LIMITS
    if not lowest <= limit <= highest:
        raise ValueError(f"Limit must be between {lowest} and {highest}.")

    def text(name: str):
        column = F.col(name) if name in accounts.columns else F.lit(None).cast("string")
        return optional_text(column).alias(name)

    # order first: the sort key is the raw id, top-n is taken before any clean-up
    return (
        accounts.orderBy("account_id").limit(limit)
        .select("account_id", text("source_dataset"), text("username"))
    )


def listing_response(listing: DataFrame) -> DataFrame:
    """One row: how many accounts are listed (at most 100) and the accounts."""
    return listing.agg(
        F.count("*").alias("count"),
        F.array_sort(F.collect_list(
            F.struct("account_id", "source_dataset", "username")
        )).alias("accounts"),
    )


def readiness_report(accounts: DataFrame, model_ready, accounts_ready, store_ready,
                     missing_artifacts: Sequence[str] = ()) -> DataFrame:
    """One row on the state of model, account table and store.

    The ready flags are Python booleans or boolean columns over ``accounts``
    aggregates such as ``max_rows_per_id``.
    """
    def state(flag, good: str):
        return F.when(flag, F.lit(good)).otherwise(F.lit("unavailable"))

    model, store = F.lit(model_ready), F.lit(store_ready)
    data = accounts_ready if not isinstance(accounts_ready, bool) else F.lit(accounts_ready)
    per_id = accounts.groupBy("account_id").agg(F.count("*").alias("n"))
    totals = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_rows_per_id"),
    )
    return totals.select(
        F.when(model & data & store, F.lit("ok")).otherwise(F.lit("degraded")).alias("status"),
        F.lit("available").alias("api"),
        state(model, "loaded").alias("model"),
        state(data, "loaded").alias("data_adapter"),
        F.when(data, F.col("row_count")).otherwise(F.lit(0)).alias("demo_account_count"),
        state(store, "ready").alias("feedback_store"),
        F.lit(list(missing_artifacts)).cast("array<string>").alias("missing_artifacts"),
    )
