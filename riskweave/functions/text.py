"""Text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.constants import MISSING_TOKENS, UNKNOWN_WORDS, WHITESPACE


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (Spark's own trim: spaces only)."""
    return F.trim(c.cast("string"), F.lit(WHITESPACE))


def missing_to_null(c: Column) -> Column:
    """Turn the missing-value spellings of delimited files into NULL."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def optional_text(c: Column) -> Column:
    """Stripped text, NULL when blank."""
    return F.when(F.length(strip(c)) > 0, strip(c))


def present(c: Column, unknown_is_missing: bool = False) -> Column:
    """1.0 if the text says something, else 0.0; optionally 'unknown' words say nothing."""
    return says(strip(c), unknown_is_missing)


def says(stripped: Column, unknown_is_missing: bool = False) -> Column:
    """``present`` for text that is stripped already."""
    said = F.length(stripped) > 0
    if unknown_is_missing:
        said = said & ~F.lower(stripped).isin(*UNKNOWN_WORDS)
    return F.when(said, F.lit(1.0)).otherwise(F.lit(0.0))


def stripped_length(c: Column) -> Column:
    """Code points in the stripped text, as DOUBLE."""
    return F.length(strip(c)).cast("double")
