"""Column functions for turning raw text fields into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens a pandas CSV read treats as missing by default
# (library behaviour of ``pandas.read_csv``), so the cleaning step drops the
# same rows the reference drops.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Fixed value: the only numeric spellings accepted as a price -- a decimal
# with optional sign, exponent and surrounding blanks, or a signed infinity
# without blanks (what pandas' to_numeric accepts). Spark's cast alone would
# also accept forms such as '1d' or ' inf'.
NUMERIC_PATTERN = r"(?i)^(\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*|[+-]?inf(inity)?)$"


def missing_as_null(c: Column) -> Column:
    """Null when the text is one of the CSV missing-value tokens."""
    return F.when(c.isNull() | c.isin(MISSING_TOKENS), F.lit(None)).otherwise(c)


def parse_number(c: Column, to: str = "double") -> Column:
    """Text to number; anything outside ``NUMERIC_PATTERN`` becomes null."""
    return F.when(c.rlike(NUMERIC_PATTERN), F.trim(c).try_cast(to))


def valid_price(c: Column) -> Column:
    """True for a usable price: not null, not NaN, greater than zero."""
    return c.isNotNull() & ~F.isnan(c) & (c > 0)
