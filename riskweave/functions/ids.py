"""Account and assessment identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.constants import (
    ACCOUNT_ID_PATTERN, ASSESSMENT_PREFIX, OVERRIDE_LABELS, REASON_PATTERN,
)
from riskweave.functions.text import strip

# whole numbers without exponent; the group is the id
_SIMPLE = r"^\+?0*(0|[1-9][0-9]{0,18})(?:\.0*)?\z"
# zeros the pattern above leaves over: negative, without whole part, with exponent
_ZERO = r"^[+-]?(?:0+\.?0*|\.0+)(?:[eE][+-]?[0-9]+)?\z"
# a nonzero digit, 18 or more digits, a nonzero digit: no id of 19 digits
_TOO_PRECISE = r"[1-9](?:\.?[0-9]){18,}\.?[0-9]*[1-9]"
_WHOLE_DECIMAL = r"^([1-9][0-9]*)\.0+\z"


def is_account_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ACCOUNT_ID_PATTERN), F.lit(False))


def normalise_account_id(c: Column) -> Column:
    """Digits of a non-negative whole number of at most 19 digits, else NULL.

    Accepts what spreadsheets make of ids (signs, leading zeros, ``1.0``,
    ``8.41E+17``).  One pattern settles ids without an exponent, the others go through
    a decimal.
    """
    text = strip(c)
    # 19 whole digits fit this type exactly, larger values are NULL; the cast rounds at
    # the 19th decimal, which only digit runs too long for an id could turn into one
    decimal = text.try_cast("decimal(38,19)").cast("string")
    return F.coalesce(
        _first_group(text, _SIMPLE),
        F.when(text.rlike(_ZERO), F.lit("0")).when(
            ~text.rlike(_TOO_PRECISE), _first_group(decimal, _WHOLE_DECIMAL)
        ),
    )


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def assessment_id(request_key: Column, model_id: Column, width: int = 32) -> Column:
    """Stable id of (request, model): a retried request gets the same id."""
    digest = F.md5(F.concat_ws("|", request_key.cast("string"), model_id))
    return F.concat(F.lit(ASSESSMENT_PREFIX), F.substring(digest, 1, width))


def packed_id(c: Column) -> Column:
    """Assessment ids in half the bytes, for what is kept or moved per id; any other text gets
    a byte more.  The last byte tells the two apart, ``unpacked_id`` gives the text back."""
    digits = F.substr(c, F.lit(len(ASSESSMENT_PREFIX) + 1))
    number = F.unhex(digits)
    is_short = c.startswith(ASSESSMENT_PREFIX) & (F.lower(F.hex(number)) == digits)
    return F.when(is_short, F.concat(number, F.lit(b"\x01"))).otherwise(
        F.concat(c.cast("binary"), F.lit(b"\x00")))


def unpacked_id(c: Column) -> Column:
    size = F.octet_length(c)
    value = F.substr(c, F.lit(1), size - 1)
    return F.when(F.substr(c, size, F.lit(1)) == F.lit(b"\x01"), F.concat(
        F.lit(ASSESSMENT_PREFIX), F.lower(F.hex(value)))).otherwise(value.cast("string"))


def is_assessment_id(c: Column, width: int = 32) -> Column:
    shape = c.startswith(ASSESSMENT_PREFIX) & (
        F.length(c) == len(ASSESSMENT_PREFIX) + width
    )
    return F.coalesce(shape, F.lit(False))


def is_override_label(c: Column) -> Column:
    return F.coalesce(c.isin(*OVERRIDE_LABELS), F.lit(False))


def is_reason_code(c: Column) -> Column:
    return F.coalesce(c.rlike(REASON_PATTERN), F.lit(False))
