"""Account profiles, requests and overrides as views over the sample star schema.

The labelled account files are not distributed; these views give tables of the same
shape, with the same kinds of defects, that grow with the sample tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.merge import ROW_ORDER

AS_OF = "2001-08-02"
FEATURE_INPUTS = (
    "account_age_days", "followers_count", "following_count", "tweet_count", "username",
    "description", "verified", "default_profile_image",
)


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
              "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, "
                "l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def profile_crm(spark: SparkSession, folder: str) -> DataFrame:
    """Source 0: one row per customer."""
    items = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("item_count")
    )
    activity = (
        table(spark, folder, "orders")
        .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").alias("first_order"),
            F.count("*").alias("order_count"),
            F.coalesce(F.sum("item_count"), F.lit(0)).alias("item_count"),
        )
    )
    key = F.col("c_custkey")
    even_nation = F.col("c_nationkey") % 2 == 0
    rows = (
        table(spark, folder, "customer")
        .join(activity, key == F.col("o_custkey"), "left")
        .join(table(spark, folder, "nation"),
              F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.cast("string").alias("account_id"),
            F.lit("crm").alias("source_dataset"),
            key.alias(ROW_ORDER),
            F.when((F.col("c_acctbal") < 3000) & even_nation, "1").otherwise("0")
            .alias("label"),
            F.when(key % 4 == 0, 0.75).otherwise(1.0).alias("feature_completeness"),
            F.datediff(F.lit(AS_OF).cast("date"), F.col("first_order").cast("date"))
            .alias("account_age_days"),
            F.floor("c_acctbal").cast("bigint").alias("followers_count"),
            F.coalesce("order_count", F.lit(0)).alias("following_count"),
            F.coalesce("item_count", F.lit(0)).alias("tweet_count"),
            F.when(key % 9 != 0, F.col("c_name")).alias("username"),
            F.when(key % 6 == 0, "  ")
            .otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
            .alias("description"),
            F.when(key % 5 == 0, "Unknown").otherwise(F.col("n_name")).alias("location"),
            F.when(even_nation, "Yes").when(key % 8 == 1, "maybe").otherwise("f")
            .alias("verified"),
            F.when(key % 7 == 0, "TRUE").otherwise("0").alias("default_profile_image"),
        )
    )
    empty = F.col(ROW_ORDER) % 50 == 7
    return rows.withColumns({c: F.when(~empty, F.col(c)) for c in FEATURE_INPUTS})


def profile_events(spark: SparkSession, folder: str) -> DataFrame:
    """Source 1: one row per event user, ids in spreadsheet spellings."""
    user = F.col("user_id")
    text = user.cast("string")
    spelling = user % 10
    return (
        table(spark, folder, "events").groupBy("user_id")
        .agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
            F.count("*").alias("event_count"),
            F.count_if(F.col("event_type") == "error").alias("error_count"),
        )
        .select(
            F.when(spelling == 3, F.concat(F.lit("bad-"), text))
            .when(spelling == 4, F.concat(text, F.lit(".0")))
            .when(spelling == 5, F.concat(F.lit(" "), text, F.lit(" ")))
            .when(spelling == 6, F.concat(text, F.lit("E+0")))
            .when(spelling == 7, F.concat(F.lit("00"), text))
            .otherwise(text).alias("account_id"),
            F.lit("events").alias("source_dataset"),
            user.alias(ROW_ORDER),
            F.when(user % 20 == 9, "x")
            .when(F.col("error_count") * 5 > F.col("event_count"), "1")
            .otherwise("0").alias("label"),
            F.when(user % 3 != 0, 1.0).alias("feature_completeness"),
            (F.datediff(F.col("last_seen").cast("date"), F.col("first_seen").cast("date"))
             + 1).alias("account_age_days"),
            F.col("event_count").alias("tweet_count"),
        )
    )


def labelled_sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [profile_crm(spark, folder), profile_events(spark, folder)]


def account_table(spark: SparkSession, folder: str) -> DataFrame:
    """The label-free accounts that requests refer to."""
    return profile_crm(spark, folder).drop(ROW_ORDER, "label", "feature_completeness")


def requests_from_orders(orders: DataFrame) -> DataFrame:
    """Assessment requests: one per order, some with a wrong platform or id."""
    key = F.col("o_orderkey")
    return orders.select(
        key.cast("string").alias("request_id"),
        F.when(key % 17 == 0, "twitter").otherwise("x").alias("platform"),
        F.when(key % 13 == 0, "abc")
        .when(key % 11 == 0, (F.col("o_custkey") + 1_000_000_000).cast("string"))
        .otherwise(F.col("o_custkey").cast("string")).alias("account_id"),
        F.col("o_orderdate").alias("requested_at"),
    )


# tells override requests apart and orders them
ARRIVAL = (
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax",
)


def overrides_from_items(items: DataFrame, assessment_id) -> DataFrame:
    """Override requests: one per order line, on the order's assessment."""
    return items.select(
        assessment_id(F.col("l_orderkey").cast("string")).alias("assessment_id"),
        F.when(F.col("l_returnflag") == "A", "legitimate")
        .when(F.col("l_returnflag") == "N", "uncertain")
        .when(F.col("l_returnflag") == "R", "suspicious").alias("override_label"),
        F.when(F.col("l_partkey") % 29 == 0, "Bad Code!")
        .otherwise(F.concat(F.lit("status_"), F.lower("l_linestatus"))).alias("reason_code"),
        *ARRIVAL,
    )
