"""Analyst overrides: at most one per recorded assessment, the first arrival wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.constants import OVERRIDE_STORE_MESSAGE
from riskweave.functions.decisions import error
from riskweave.functions.ids import is_assessment_id, is_override_label, is_reason_code
from riskweave.operators.bodies import (
    BODY_CHECKS, body_problem, invalid_value, read_bodies,
)
from riskweave.operators.lookup import hot_keys
from riskweave.session import stage


OVERRIDE_FIELDS = ("override_label", "reason_code")


def read_override_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """Override requests out of JSON bodies; the assessment id is a column beside them."""
    return read_bodies(requests, OVERRIDE_FIELDS, body)


def override_problem(requests: DataFrame, id_width: int) -> Column:
    """Message for the first fault, else NULL; the body is checked before the id."""
    in_body = body_problem(requests, F.when(
        ~is_override_label(F.col("override_label")), invalid_value(F.lit("override_label"))
    ).when(
        ~is_reason_code(F.col("reason_code")), invalid_value(F.lit("reason_code"))
    ))
    return F.coalesce(in_body, F.when(
        ~is_assessment_id(F.col("assessment_id"), id_width), F.lit("Invalid assessment ID.")
    ))


def decide_overrides(requests: DataFrame, assessments: DataFrame, overrides: DataFrame,
                     arrival: Sequence[str], id_width: int = 32) -> DataFrame:
    """Add ``outcome`` ('recorded' or NULL) and ``error`` to every override request.

    ``arrival`` names the columns that order the requests; requests that tie in them are
    ordered by a hash of all their columns, and exactly one wins.  Requests meet what is known
    of their assessment and are ranked in one shuffle by id; rows with a fault need none.  Ids
    that own more than an even share of a shuffle partition go apart: their rows are staged,
    which fixes them, and get their first arrival by broadcast.  Jobs run while this is called,
    and the requests are read by several of them.
    """
    key = "assessment_id"
    asked = requests.withColumn("_problem", override_problem(requests, id_width))
    faulty = asked.where("_problem IS NOT NULL")
    valid = asked.where("_problem IS NULL")
    # ids share their first letters: a number before them settles most comparisons of a sort
    told = assessments.select(key, F.lit(False).alias("_taken")).unionByName(
        overrides.select(key, F.lit(True).alias("_taken")))
    state = told.groupBy(F.xxhash64(key).alias("_place"), key).agg(
        F.bool_or(~F.col("_taken")).alias("_known"), F.bool_or("_taken").alias("_taken"))
    tie = F.xxhash64(*requests.columns)
    hot = hot_keys(requests.select(key), key)
    is_hot = F.col(key).isin(*hot) if hot else F.lit(False)

    turn = F.row_number().over(Window.partitionBy("_place", key).orderBy(*arrival, tie))
    found = (
        valid.where(~is_hot).withColumn("_place", F.xxhash64(key))
        .withColumn("_first", turn == 1).join(state, ["_place", key], "left").drop("_place")
    )
    if hot:
        apart = stage(
            valid.where(is_hot).withColumn("_row", F.monotonically_increasing_id()), "hot-requests"
        ).withColumn("_arrival", F.struct(*arrival, tie.alias("_tie"), "_row"))
        # fewer than there are shuffle partitions
        first = apart.groupBy(key).agg(F.min("_arrival")["_row"].alias("_first_row")).join(
            state.where(is_hot).drop("_place"), key, "left")
        found = found.unionByName(
            apart.join(F.broadcast(first), key)
            .withColumn("_first", F.col("_row") == F.col("_first_row"))
            .drop("_row", "_arrival", "_first_row"))
    found = found.unionByName(faulty, allowMissingColumns=True)
    code = (
        F.when(F.col("_problem").isNotNull(), F.lit("invalid_request"))
        .when(~F.coalesce("_known", F.lit(False)), F.lit("assessment_not_found"))
        .when(F.col("_taken") | ~F.col("_first"), F.lit("override_already_recorded"))
    )
    return _outcomes(found.withColumn("_code", code), requests)


def refuse_overrides(requests: DataFrame, id_width: int = 32) -> DataFrame:
    """Outcomes while the store is unavailable: valid requests cannot be recorded."""
    problem = override_problem(requests, id_width)
    asked = requests.withColumn("_problem", problem).withColumn(
        "_code", F.when(F.col("_problem").isNotNull(), F.lit("invalid_request"))
        .otherwise(F.lit("feedback_store_unavailable"))
    )
    message = F.coalesce("_problem", F.lit(OVERRIDE_STORE_MESSAGE))
    return _outcomes(asked.withColumn("_problem", message), requests)


def _outcomes(decided: DataFrame, requests: DataFrame) -> DataFrame:
    return decided.select(
        *[c for c in requests.columns if c not in BODY_CHECKS],
        F.when(F.col("_code").isNull(), F.lit("recorded")).alias("outcome"),
        error(F.col("_code"), F.col("_problem")).alias("error"),
    )


def accepted_overrides(decided: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows for the overrides table."""
    return decided.where(F.col("outcome") == "recorded").select(
        "assessment_id",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        "override_label", "reason_code",
    )
