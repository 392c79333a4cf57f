"""The twelve account features as layered projections (map-only, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.constants import FEATURES
from riskweave.functions.decisions import is_sufficient
from riskweave.functions.numbers import flag, in_domain, parse_double
from riskweave.functions.text import says, strip
from riskweave.operators.merge import first_type

# feature or fallback -> (source column, must be > 0)
_NUMBERS = {
    "account_age_days": ("account_age_days", True),
    "followers_count": ("followers_count", False),
    "following_count": ("following_count", False),
    "tweet_count": ("tweet_count", False),
    "_given_ratio": ("followers_following_ratio", False),
    "_given_rate": ("tweets_per_day", False),
    "_given_description_length": ("description_length", False),
    "_given_username_length": ("username_length", False),
}
_FLAGS = {
    "verified": "verified",
    "uses_default_profile_image": "default_profile_image",
}


def account_features(df: DataFrame, keep: Sequence[str] = ("account_id",)) -> DataFrame:
    """``keep`` columns, the features in order, ``usable`` and ``completeness``.

    Source columns are optional.  Missing is NULL, never NaN.
    """

    def source(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    parsed = df.select(
        *keep,
        *[parse_double(source(c), first_type(df, c)).alias(out)
          for out, (c, _) in _NUMBERS.items()],
        *[flag(source(c), first_type(df, c)).alias(out) for out, c in _FLAGS.items()],
        *[strip(source(c)).alias(f"_{c}") for c in ("description", "username", "location")],
    )
    checked = parsed.withColumns({
        **{out: in_domain(F.col(out), positive) for out, (_, positive) in _NUMBERS.items()},
        "_said": says(F.col("_username")) + says(F.col("_description"))
        + says(F.col("_location"), unknown_is_missing=True),
    })

    image_known = F.col("uses_default_profile_image").isNotNull()
    derived = checked.withColumns({
        "follower_following_ratio": F.coalesce(
            (F.col("followers_count") + 1) / (F.col("following_count") + 1),
            F.col("_given_ratio"),
        ),
        "posting_frequency": F.coalesce(
            F.col("tweet_count") / F.col("account_age_days"), F.col("_given_rate")
        ),
        "description_length": F.coalesce(
            F.col("_given_description_length"), F.length("_description").cast("double")
        ),
        "username_length": F.coalesce(
            F.col("_given_username_length"), F.length("_username").cast("double")
        ),
        # mean of three presence flags, or of four when the image flag is known
        "profile_completeness": F.when(
            image_known,
            (F.col("_said") + (1 - F.col("uses_default_profile_image"))) / 4,
        ).otherwise(F.col("_said") / 3),
    })

    described = {"description", "description_length"} & set(df.columns)
    has_description = (
        F.when(F.col("description_length") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        if described
        else F.lit(None).cast("double")
    )
    features = derived.withColumn("has_description", has_description).select(*keep, *FEATURES)
    usable = reduce(add, [F.col(f).isNotNull().cast("int") for f in FEATURES])
    return features.withColumn("usable", usable).withColumn(
        "completeness", F.col("usable") / len(FEATURES)
    )


def usable_accounts(features: DataFrame) -> DataFrame:
    """Rows with at least half of the features."""
    return features.where(is_sufficient(F.col("usable")))


def split_counts(features: DataFrame) -> DataFrame:
    """Rows, positives and rows below the completeness floor per split."""
    return features.groupBy("split").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("label") == 1).alias("positive_count"),
        F.count_if(~is_sufficient(F.col("usable"))).alias("removed_count"),
    )


def split_count_columns(splits: Sequence[str]) -> list[Column]:
    """The counts of ``split_counts`` for known splits, as aggregates over all rows."""
    thin = ~is_sufficient(F.col("usable"))
    return [column.alias(f"{name}:{of}") for name in splits for column, of in (
        (F.count_if(F.col("split") == name), "row_count"),
        (F.count_if((F.col("split") == name) & thin), "removed_count"))]
