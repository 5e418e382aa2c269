"""Display formats of the analytics page, as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """``$%.2f``; rounded half away from zero first so every engine prints
    the same digits."""
    return F.format_string("$%.2f", F.round(c, 2))


def percent(fraction: Column) -> Column:
    """``%.1f%%`` of a fraction (0.25 -> ``25.0%``)."""
    return F.format_string("%.1f%%", F.round(fraction * F.lit(100.0), 1))
