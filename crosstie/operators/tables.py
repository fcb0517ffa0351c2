"""Row and column operators on whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.functions.nulls import col, strict_sum
from crosstie.functions.text import clean_names


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks are missing there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sort_last(df: DataFrame, *keys: str) -> DataFrame:
    """Sort with missing values last; a leading ``-`` means descending."""
    order = [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]
    return df.orderBy(*order)


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Counts per key; missing keys form their own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sums_by(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """``{output: column}`` strict sums per group (missing if any input is missing)."""
    return df.groupBy(*keys).agg(*[strict_sum(c).alias(out) for out, c in cols.items()])


def histogram(df: DataFrame, groups: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """Counts per bin of fixed width, bins labelled by their lower end."""
    lower = (F.floor(col(value) / F.lit(width)) * F.lit(width)).cast("double")
    return count_by(df.where(col(value).isNotNull()).withColumn("bin", lower), *groups, "bin")


def log_histogram(df: DataFrame, groups: Sequence[str], value: str, bins_per_decade: int = 10) -> DataFrame:
    """Counts per bin on a log10 axis; values without a logarithm are left out."""
    shown = df.where(col(value) > 0)
    return count_by(shown.withColumn("bin", F.floor(F.log10(col(value)) * bins_per_decade).cast("bigint")),
                    *groups, "bin")
