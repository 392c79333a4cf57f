"""Decision rules over a probability: band, confidence, recommendation, wording."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.constants import (
    CONFIDENCE_MARGIN, CONFIDENT_USABLE, ERROR_MESSAGES, FEATURE_LABELS,
    SUFFICIENT_USABLE,
)


def is_sufficient(usable: Column) -> Column:
    """At least half of the features are usable."""
    return usable >= SUFFICIENT_USABLE


def is_finite(p: Column) -> Column:
    return F.coalesce(F.abs(p) < float("inf"), F.lit(False))


def risk_band(p: Column, medium, high) -> Column:
    return (
        F.when(p < F.lit(medium), F.lit("low"))
        .when(p < F.lit(high), F.lit("medium"))
        .when(p.isNotNull(), F.lit("high"))
    )


def confidence(p: Column, usable: Column, medium, high,
               margin: float = CONFIDENCE_MARGIN) -> Column:
    """STRUCT<level, basis>; thin coverage outranks closeness to a cut-off."""
    distance = F.least(F.abs(p - F.lit(medium)), F.abs(p - F.lit(high)))

    def verdict(level: str, basis: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(basis).alias("basis"))

    return (
        F.when(usable < CONFIDENT_USABLE, verdict("low", "limited_feature_coverage"))
        .when(distance < F.lit(margin), verdict("low", "close_to_decision_thresholds"))
        .otherwise(verdict("high", "clear_of_decision_thresholds"))
    )


def recommendation(explained: Column, level: Column, band: Column) -> Column:
    return (
        F.when(~explained | (level == "low"), F.lit("monitor"))
        .when(band == "low", F.lit("no_concern"))
        .when(band == "medium", F.lit("monitor"))
        .otherwise(F.lit("prioritise"))
    )


def top_factors(contributions: Column, names: list[str], k: int = 3) -> Column:
    """The k largest contributions by size, worded; equal sizes: later feature first."""
    ranked = F.slice(
        F.sort_array(
            F.transform(
                contributions,
                lambda v, i: F.struct(F.abs(v).alias("size"), i.alias("i"), v.alias("v")),
            ),
            asc=False,
        ),
        1, k,
    )
    name_list = F.array(*[F.lit(n) for n in names])
    wording = F.array(*[
        F.lit(FEATURE_LABELS.get(n, n.replace("_", " ").title())) for n in names
    ])

    def describe(x: Column) -> Column:
        rises = x["v"] >= 0
        return F.struct(
            F.get(name_list, x["i"]).alias("feature"),
            F.when(rises, "increases_risk").otherwise("decreases_risk").alias("direction"),
            F.concat(
                F.get(wording, x["i"]),
                F.when(rises, " increased").otherwise(" reduced"),
                F.lit(" the estimated risk."),
            ).alias("evidence"),
        )

    return F.transform(ranked, describe)


def error(code: Column, message: Column | None = None) -> Column:
    """STRUCT<code, message, retryable>, NULL when there is no error."""
    known = F.create_map(*[F.lit(v) for pair in ERROR_MESSAGES.items() for v in pair])
    standard = F.try_element_at(known, code)
    text = standard if message is None else F.coalesce(message, standard)
    return F.when(
        code.isNotNull(),
        F.struct(code.alias("code"), text.alias("message"), F.lit(False).alias("retryable")),
    )
