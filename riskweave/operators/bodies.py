"""Strict reading of JSON request bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.constants import ERROR_MESSAGES

# what read_bodies adds to a row
BODY_CHECKS = ("extra_fields", "malformed")


def read_bodies(requests: DataFrame, fields: Sequence[str], body: str = "body") -> DataFrame:
    """Replace a JSON body by its fields and what is wrong with the body.

    Only JSON strings count as field values; keys beyond ``fields`` go to
    ``extra_fields``; text that is not a JSON object is ``malformed``.
    """
    parsed = F.col("_parsed")

    def string_field(name: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == (
            "STRING"
        )
        return F.when(is_text, F.try_variant_get(parsed, f"$.{name}", "string"))

    keys = F.json_object_keys(body)
    known = F.array(*[F.lit(f) for f in fields])
    return requests.withColumn("_parsed", F.try_parse_json(F.col(body))).withColumns({
        **{f: string_field(f) for f in fields},
        "extra_fields": F.array_except(keys, known),
        "malformed": parsed.isNull() | keys.isNull(),
    }).drop(body, "_parsed")


def invalid_value(name: Column) -> Column:
    return F.concat(F.lit("Invalid value for "), name, F.lit("."))


def body_problem(requests: DataFrame, field_problem: Column) -> Column:
    """Message on the first fault: the body as a whole, its fields, then extra keys."""
    problem = field_problem
    if "extra_fields" in requests.columns:
        extra = F.get("extra_fields", F.lit(0))
        problem = F.coalesce(problem, F.when(extra.isNotNull(), invalid_value(extra)))
    if "malformed" in requests.columns:
        problem = F.when(
            F.col("malformed"), F.lit(ERROR_MESSAGES["invalid_request"])
        ).otherwise(problem)
    return problem
