"""Tolerant number and flag parsing.

The ``dtype`` argument is the type of the incoming column: typed columns are cast,
text is parsed, anything unreadable is NULL.  No NaN leaves this module.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.constants import FALSE_WORDS, TRUE_WORDS, WHITESPACE
from riskweave.functions.text import strip

# Spark's text-to-double cast also takes suffixes ('1d') and hex; these do not.  Group 1
# is the number without the whitespace around it.
_FINITE = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_AROUND = f"[{WHITESPACE}]*"
FINITE_TEXT = rf"^{_AROUND}({_FINITE}){_AROUND}\z"
ANY_NUMBER_TEXT = rf"^{_AROUND}({_FINITE}|[+-]?(?i:inf|infinity)){_AROUND}\z"

_SMALLEST = 5e-324                  # smallest double above zero
_LARGEST = 1.7976931348623157e308   # largest finite double


def parse_double(c: Column, dtype: T.DataType, infinite: bool = False) -> Column:
    """DOUBLE, or NULL for text that is not a plain number; NaN becomes NULL."""
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.NumericType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    pattern = ANY_NUMBER_TEXT if infinite else FINITE_TEXT
    # regexp_extract yields '' without a match, and '' casts to NULL.
    return F.regexp_extract(c, pattern, 1).try_cast("double")


def in_domain(x: Column, positive: bool = False) -> Column:
    """Keep a finite value that is >= 0 (or > 0), else NULL."""
    lowest = _SMALLEST if positive else 0.0
    return F.when(x.between(lowest, _LARGEST), x)


def number(c: Column, dtype: T.DataType = T.StringType(), positive: bool = False) -> Column:
    """Finite non-negative DOUBLE or NULL."""
    return in_domain(parse_double(c, dtype), positive)


def completeness_rank(c: Column, dtype: T.DataType) -> Column:
    """Rank value for de-duplication; unreadable ranks below everything."""
    return F.coalesce(parse_double(c, dtype, infinite=True), F.lit(-1.0))


def flag(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """1.0 / 0.0 / NULL from booleans, 0/1 numbers and the usual words."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, T.NumericType):
        x = c.cast("double")
        return F.when(x.isin(0.0, 1.0), x)
    return F.try_element_at(_flag_words(), F.lower(strip(c)))


def _flag_words() -> Column:
    # '1.0' / '0.0' appear when a 0/1 column was written as floating point
    pairs = [(w, 1.0) for w in (*TRUE_WORDS, "1.0")] + [(w, 0.0) for w in (*FALSE_WORDS, "0.0")]
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])
