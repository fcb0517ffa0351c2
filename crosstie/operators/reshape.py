"""Long/wide reshaping with declared columns.

Wide tables are built by conditional aggregation: one partial + final aggregate
and a single shuffle, where a generic pivot needs a second aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Most columns that names found in the data may become.
MOST_NAMES = 1000


def _label(v) -> str:
    return "NA" if v is None else str(v)


def widen_counts(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence, fill: bool = True,
                 rest: str | None = None) -> DataFrame:
    """Row counts per id and name, one column per declared name; absent pairs are 0 or missing.

    ``rest`` names a column for the rows of all other names, so that none goes uncounted.
    """
    def n(test: Column, label: str) -> Column:
        c = F.count_if(test)
        return (c if fill else F.nullif(c, F.lit(0).cast("bigint"))).alias(label)

    declared = [F.col(names_from).eqNullSafe(F.lit(v)) for v in names]
    cells = [n(test, _label(v)) for test, v in zip(declared, names, strict=True)]
    if rest:
        cells.append(n(~reduce(lambda a, b: a | b, declared), rest))
    return df.groupBy(*ids).agg(*cells)


def widen(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence, values: Sequence[str],
          agg=F.max, fill=None) -> DataFrame:
    """Long to wide for one or several value columns.

    One value column gives columns named after the names; several give ``value_name``.
    """
    def cell(v, n) -> Column:
        c = agg(F.when(F.col(names_from).eqNullSafe(F.lit(n)), F.col(v)))
        c = c if fill is None else F.coalesce(c, F.lit(fill))
        return c.alias(_label(n) if len(values) == 1 else f"{v}_{_label(n)}")
    return df.groupBy(*ids).agg(*[cell(v, n) for v in values for n in names])


def lengthen(df: DataFrame, cols: Sequence[str], names_to: str, values_to: str, drop_null: bool = False) -> DataFrame:
    """Wide to long over the given columns; all others are ids."""
    ids = [c for c in df.columns if c not in set(cols)]
    out = df.unpivot(ids, list(cols), names_to, values_to)
    return out.where(F.col(values_to).isNotNull()) if drop_null else out


def row_total(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in cols]))


def names_in(df: DataFrame, names_from: str, most: int = MOST_NAMES) -> list:
    """The names that occur, sorted, a missing one last, to be declared in a second pass.

    They become columns, so their number is bounded: more than ``most`` are refused.
    """
    found = [r[0] for r in df.select(names_from).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{names_from} has more than {most} names; declare those wanted and name a rest column")
    return sorted([n for n in found if n is not None]) + [None] * (None in found)


def spread_total(df: DataFrame, key: str, names_from: str, names: Sequence | None, value: str, out: str,
                 rest: str | None = None) -> DataFrame:
    """Long to wide, every missing value (the key's too) set to 0, plus the sum over all names.

    Each pair of key and name is expected once. The values of undeclared names are in the
    total, and in a column of their own if ``rest`` names one. Without ``names`` all that
    occur become columns.
    """
    names = names_in(df, names_from) if names is None else names
    others = ~reduce(lambda a, b: a | b, [F.col(names_from).eqNullSafe(F.lit(n)) for n in names], F.lit(False))
    cells = [F.coalesce(F.max(F.when(F.col(names_from).eqNullSafe(F.lit(n)), F.col(value))), F.lit(0.0)).alias(_label(n)) for n in names]
    left = rest or "_rest"
    cells.append(F.coalesce(F.sum(F.when(others, F.col(value))), F.lit(0.0)).alias(left))
    wide = df.groupBy(key).agg(*cells).fillna(0, [key])
    total = row_total(wide, [*[_label(n) for n in names], left], out)
    return total if rest else total.drop(left)


def transpose(df: DataFrame, group: str, groups: Sequence, metrics: Sequence[str]) -> DataFrame:
    """Turn a small per-group summary on its side: one row per metric, one column per group."""
    long = df.select(group, *[F.col(m).cast("double") for m in metrics]).unpivot([group], list(metrics), "metric", "_v")
    return widen(long, ["metric"], group, groups, ["_v"])
