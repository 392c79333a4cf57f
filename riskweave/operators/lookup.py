"""Many-to-one joins that stay balanced when one key owns much of the fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import stage


def key_demand(facts: DataFrame, key: str, usable: Column, *extra: Column) -> DataFrame:
    """One row per key wanted by a ``usable`` row, with its ``row_count``; stored for the
    steps that read it.

    Folded map-side, so a frequent key is one row per task.  Unusable rows fold into the
    NULL key, which is dropped on reading: a filter before the aggregate would be pushed
    down and evaluate the key and the check twice.
    """
    counted = (
        facts.withColumn("_wanted", F.when(usable, F.col(key)))
        .groupBy(F.col("_wanted").alias(key)).agg(F.count("*").alias("row_count"), *extra)
    )
    return stage(counted, "demand").where(F.col(key).isNotNull())


def hot_keys(demand: DataFrame, key: str, partitions: int | None = None) -> list:
    """Keys of a ``key_demand``, or of plain rows, that own more rows than an even shuffle
    partition holds.

    ``partitions`` is the number of shuffle partitions, by default the session's.  Fewer
    than that many keys can exceed an even share, so the list needs no cap; every other
    key fits beside others in a partition of at most twice the even size on average.
    Plain rows are counted by cells of the key's hash, and by key only in cells that hold so
    many rows themselves; an even partition is eight cells or more.
    """
    if partitions is None:
        partitions = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "row_count" in demand.columns:
        total = demand.agg(F.sum("row_count")).first()[0] or 0
        counted = demand
    else:
        cell = F.pmod(F.xxhash64(key), F.lit(max(4096, 8 * partitions)))
        keys = demand.select(key).where(F.col(key).isNotNull())
        cells = keys.groupBy(cell.alias("cell")).count().collect()
        total = sum(r["count"] for r in cells)
        crowded = [r["cell"] for r in cells if r["count"] > total / partitions]
        if not crowded:
            return []
        counted = keys.where(cell.isin(crowded)).groupBy(key).agg(
            F.count("*").alias("row_count"))
    rows = counted.where(F.col("row_count") > total / partitions).select(key).collect()
    return sorted(r[key] for r in rows)


def attach(facts: DataFrame, key: str, row_id: str, dimension: DataFrame,
           result: str, hot: Sequence = (), usable: Column | None = None) -> DataFrame:
    """Left-join ``dimension`` (one row per ``key``) and add its other columns as the
    struct ``result``, NULL without a match.

    Rows that cannot match (NULL key, ``usable`` false) and rows of ``hot`` keys get a
    private shuffle key from ``row_id``, so they spread evenly.  Hot rows then find
    their match in a broadcast of the dimension rows of those keys, one row per key;
    ``hot_keys`` gives fewer than there are shuffle partitions.
    """
    searchable = F.col(key).isNotNull()
    if usable is not None:
        searchable = searchable & usable
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False)) if hot else F.lit(False)
    columns = [c for c in dimension.columns if c != key]
    keyed = dimension.select(F.col(key).alias("_key"), F.struct(*columns).alias("_found"))

    shuffle_key = F.when(searchable & ~is_hot, F.col(key)).otherwise(
        F.concat(F.lit("\u0000"), F.col(row_id).cast("string"))
    )
    joined = facts.withColumn("_key", shuffle_key).join(keyed, "_key", "left").drop("_key")
    if not hot:
        return joined.withColumnRenamed("_found", result)
    few = keyed.where(F.col("_key").isin(*hot)).withColumnsRenamed(
        {"_key": "_hot_key", "_found": "_hot_found"}
    )
    return (
        joined.withColumn("_wanted", F.when(searchable & is_hot, F.col(key)))
        .join(F.broadcast(few), F.col("_wanted") == F.col("_hot_key"), "left")
        .withColumn(result, F.coalesce("_found", "_hot_found"))
        .drop("_wanted", "_hot_key", "_found", "_hot_found")
    )
