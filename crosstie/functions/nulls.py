"""Missing-value rules of the analyst's table language, as Spark columns.

Spark follows SQL; the rules here differ from SQL on purpose and every operator
that depends on one of them uses the helper instead of the raw expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_in_keep_null(c: str | Column, values) -> Column:
    """True for values outside the set *and* for missing values."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def missing_or_not_matching(c: str | Column, pattern: str) -> Column:
    """True where the text is missing or does not match the pattern."""
    return col(c).isNull() | ~col(c).rlike(pattern)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice whose result is missing when the condition is missing."""
    return F.when(cond, yes).when(~cond, no)


def text_or_na(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("NA"))


def paste(*cols: str | Column, sep: str = "") -> Column:
    """Concatenate, rendering missing parts as the text ``NA``."""
    return F.concat_ws(sep, *[text_or_na(c) for c in cols])


def to_number(c: str | Column) -> Column:
    """Text to double; anything that is not a number becomes missing.

    Java's parser accepts a trailing ``d`` or ``f`` type suffix, which is not a
    number in a data file, so such text is refused before the cast.
    """
    text = F.rtrim(col(c).cast("string"))
    suffixed = text.endswith("d") | text.endswith("f") | text.endswith("D") | text.endswith("F")
    return F.when(~suffixed, text.try_cast("double"))


def to_integer(c: str | Column) -> Column:
    return to_number(c).try_cast("int")


def strict_sum(c: str | Column) -> Column:
    """Sum that is missing as soon as one input is missing."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields a missing value for a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def total(*cols: str | Column) -> Column:
    """Row-wise addition; one missing part makes the total missing."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def across(cols, fn):
    """Apply ``fn`` to each named column: ``{name: expression}`` for ``withColumns``."""
    return {c: fn(F.col(c)) for c in cols}
