"""Bulk assessment: requests in, one response row per request out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.constants import (
    EXPLANATION_WARNING, INSUFFICIENT_WARNING, TRIAGE_WARNING, UNKNOWN_MODEL,
)
from riskweave.functions.decisions import (
    confidence, error, is_finite, is_sufficient, recommendation, risk_band, top_factors,
)
from riskweave.functions.ids import assessment_id, is_account_id
from riskweave.operators.bodies import (
    BODY_CHECKS, body_problem, invalid_value, read_bodies,
)
from riskweave.operators.features import account_features
from riskweave.operators.lookup import attach, hot_keys, key_demand
from riskweave.operators.models import Scorer

REQUEST_FIELDS = ("platform", "account_id")
ENVELOPE = ("request_id", "requested_at")


def read_request_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """Assessment requests out of JSON bodies."""
    return read_bodies(requests, REQUEST_FIELDS, body)


def check_request_columns(requests: DataFrame, envelope=ENVELOPE) -> None:
    """Requests are strict: a field nobody asked for is an error, not ignored."""
    known = {*REQUEST_FIELDS, *BODY_CHECKS, *envelope}
    extra = sorted(set(requests.columns) - known)
    if extra:
        raise ValueError(f"Invalid value for {extra[0]}.")


def request_problem(requests: DataFrame) -> Column:
    """Message on the first offending part of a request, else NULL."""
    return body_problem(requests, F.when(
        ~F.coalesce(F.col("platform") == "x", F.lit(False)), invalid_value(F.lit("platform"))
    ).when(
        ~is_account_id(F.col("account_id")), invalid_value(F.lit("account_id"))
    ))


def decide(scored: DataFrame, scorer: Scorer) -> DataFrame:
    """Decision columns for scored accounts (``usable``, ``probability``,
    ``contributions``).  Insufficient accounts get a response without a score."""
    medium, high = scorer.thresholds.medium, scorer.thresholds.high
    enough = is_sufficient(F.col("usable"))
    scorable = enough & is_finite(F.col("probability"))
    explained = F.col("contributions").isNotNull()

    staged = scored.withColumns({
        "_scorable": scorable,
        "_explained": explained,
        "risk_band": F.when(scorable, risk_band(F.col("probability"), medium, high)),
        "confidence": F.when(scorable, confidence(
            F.col("probability"), F.col("usable"), medium, high, scorer.margin
        )),
    })
    return staged.withColumns({
        "error_code": F.when(enough & ~F.col("_scorable"), F.lit("internal_error")),
        "status": F.when(~enough, F.lit("insufficient_data"))
        .when(~F.col("_scorable"), F.lit(None))
        .when(F.col("_explained"), F.lit("completed"))
        .otherwise(F.lit("completed_with_warning")),
        "data_completeness": F.bround("completeness", 3),
        "risk_probability": F.when(F.col("_scorable"), F.bround("probability", 6)),
        "top_factors": F.when(
            F.col("_scorable") & F.col("_explained"),
            top_factors(F.col("contributions"), list(scorer.feature_names)),
        ),
        "recommendation": F.when(F.col("_scorable"), recommendation(
            F.col("_explained"), F.col("confidence")["level"], F.col("risk_band")
        )),
        "warning": F.when(~enough, F.lit(INSUFFICIENT_WARNING))
        .when(F.col("_explained"), F.lit(TRIAGE_WARNING))
        .otherwise(F.lit(EXPLANATION_WARNING)),
    }).select(
        "account_id", "error_code", "status", "data_completeness", "risk_probability",
        "risk_band", "confidence", "top_factors", "recommendation", "warning",
    )


def assess_accounts(accounts: DataFrame, scorer: Scorer) -> DataFrame:
    """Decision columns for every account of a label-free table."""
    return decide(scorer.score(account_features(accounts)), scorer)


def assess(requests: DataFrame, accounts: DataFrame | None, scorer: Scorer | None,
           id_width: int = 32, envelope=ENVELOPE, store_ready: bool = True) -> DataFrame:
    """One response per request.

    Each requested account is scored and explained once, however often it is asked
    for, and the result is attached to its requests.  ``accounts`` holds one row per
    id; ``None`` for accounts or scorer answers valid requests with the matching
    error, and so does a store that cannot record scores.  ``request_id`` identifies a
    request.
    """
    check_request_columns(requests, envelope)
    asked = requests.withColumn("_problem", request_problem(requests))
    valid = F.col("_problem").isNull()

    if scorer is None or accounts is None:
        code = "model_unavailable" if scorer is None else "data_adapter_unavailable"
        return _responses(
            asked.withColumns({
                "_code": F.lit(code), "_a": F.lit(None).cast(_ASSESSED),
            }),
            requests, UNKNOWN_MODEL if scorer is None else scorer.model_id, id_width,
        )

    demand = key_demand(asked, "account_id", valid)
    assessed = assess_accounts(
        accounts.join(demand, "account_id", "left_semi"), scorer
    )
    found = attach(
        asked, "account_id", "request_id", assessed, "_a",
        hot=hot_keys(demand, "account_id"), usable=valid,
    )
    code = F.when(F.col("_a").isNull(), F.lit("account_not_found")).otherwise(
        F.col("_a")["error_code"]
    )
    if not store_ready:
        code = F.coalesce(code, F.when(
            F.col("_a")["status"] != "insufficient_data", F.lit("feedback_store_unavailable")
        ))
    return _responses(found.withColumn("_code", code), requests, scorer.model_id, id_width)


_ASSESSED = (
    "struct<error_code:string,status:string,data_completeness:double,"
    "risk_probability:double,risk_band:string,"
    "confidence:struct<level:string,basis:string>,"
    "top_factors:array<struct<feature:string,direction:string,evidence:string>>,"
    "recommendation:string,warning:string>"
)


def _responses(found: DataFrame, requests: DataFrame, model_id: str,
               id_width: int) -> DataFrame:
    code = F.when(F.col("_problem").isNotNull(), F.lit("invalid_request")).otherwise(
        F.col("_code")
    )
    answered = F.col("_error_code").isNull()
    kept = [c for c in requests.columns if c not in (*REQUEST_FIELDS, *BODY_CHECKS)]

    def field(name: str) -> Column:
        return F.when(answered, F.col("_a")[name]).alias(name)

    return found.withColumn("_error_code", code).select(
        *kept,
        F.when(answered, assessment_id(F.col("request_id"), F.lit(model_id), id_width))
        .alias("assessment_id"),
        field("status"),
        "platform", "account_id",
        F.when(answered, F.lit("dataset")).alias("data_source"),
        field("data_completeness"),
        field("risk_probability"),
        field("risk_band"),
        field("confidence"),
        F.when(answered, F.coalesce(
            F.col("_a")["top_factors"],
            F.array().cast("array<struct<feature:string,direction:string,evidence:string>>"),
        )).alias("top_factors"),
        field("recommendation"),
        field("warning"),
        error(F.col("_error_code"), F.col("_problem")).alias("error"),
    )


def to_record(responses: DataFrame, model_id: str | None, created_at: Column | None = None
              ) -> DataFrame:
    """The part of the responses that is stored: scored requests only."""
    return responses.where(
        F.col("status").isin("completed", "completed_with_warning")
    ).select(
        "assessment_id",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(model_id or UNKNOWN_MODEL).alias("model_id"),
        "risk_band", "status",
    )
