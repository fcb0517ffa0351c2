"""Unit conversions, times and risk arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosstie.functions.nulls import col, if_else, to_integer

# Conversion factors used by the study.
METRES_PER_MILE = 1609.34
SQUARE_METRES_PER_SQUARE_MILE = 2.59e6
SECONDS_PER_HOUR = 3600.0


def seconds_to_hours(c: str | Column) -> Column:
    return col(c) / F.lit(SECONDS_PER_HOUR)


def metres_to_miles(c: str | Column) -> Column:
    return col(c) / F.lit(METRES_PER_MILE)


def square_metres_to_square_miles(c: str | Column) -> Column:
    return col(c) / F.lit(SQUARE_METRES_PER_SQUARE_MILE)


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Round to ``digits`` places, halves to even, on the binary value.

    ``bround`` rounds the shortest decimal text of a double instead, so 1.275 (stored
    slightly below) would become 1.28; the study's rounding gives 1.27.
    """
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) if digits else F.rint(col(c))


def hour_24(hour: str | Column, ampm: str | Column) -> Column:
    """Twelve-hour clock to 24 h. Hours before 12 move by 12 in the afternoon; 12 AM stays 12."""
    h = to_integer(hour)
    return if_else((col(ampm) == "PM") & (h < 12), h + 12, h)


def crash_timestamp(year2, month, day, hour24: Column, minute) -> Column:
    """Local time from text parts (two-digit year of this century); missing if not a real time.

    The result has no time zone, so it does not depend on the session's.
    """
    return F.try_make_timestamp_ntz(
        to_integer(year2) + 2000, to_integer(month), to_integer(day),
        hour24, to_integer(minute), F.lit(0).cast("decimal(16,6)"),
    )


def combine_effects(*rates: str | Column) -> Column:
    """Joint reduction of independent effects: ``1 - (1-r1)(1-r2)...``; missing if any is."""
    return F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - col(r) for r in rates])
