"""Order-dependent columns that stay distributed when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstie.operators.joins import key_join
from crosstie.session import cut_lineage


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows up to and including this one, per group, in a total order.

    Rows are range-partitioned on (group, order), which cuts large groups into slices;
    each slice is summed by itself and shifted by the total of the slices before it. There
    are as many slices as shuffle partitions, so none holds more than its share however
    uneven the groups are. The sliced rows are checkpointed so that both passes see the
    same slices even if a task is rerun.
    """
    groups = list(groups)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        df.repartitionByRange(slices, *[F.col(g) for g in groups], *order)
        .withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*groups, "_slice").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, slice): at most slices + groups rows.
    shift = totals.select(*groups, "_slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (key_join(sliced.withColumn("_local", F.sum(value).over(local)), shift, [*groups, "_slice"], "inner")
            .withColumn(out, F.col("_local") + F.col("_shift"))
            .drop("_local", "_shift", "_slice"))


def number_in_order(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1, 2, 3 ... (bigint) per group in the given total order."""
    return running_total(df, groups, order, F.lit(1), out)


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank within the group, ties sharing their mean rank; missing values get no rank.

    The rank of a value follows from the number of smaller rows, so rows are first
    counted per distinct value and only those counts are put in order.
    """
    groups = list(groups)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts, groups, [F.col(value)], F.col("_n"), "_upto")
    ranks = upto.select(*groups, value, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return key_join(df, ranks, [*groups, value], "left")


def keep_group_min(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows equal to their group's minimum, ties kept; none of a group with a missing value or NaN.

    The minimum of a group with a missing member is itself missing, so no row equals it.
    Aggregate and join back instead of a window: the aggregate combines before the
    shuffle and no task has to hold a whole group.
    """
    groups = list(groups)
    df = df.withColumn(value, F.nullif(F.col(value), F.lit(float("nan"))))
    lows = (df.groupBy(*groups)
            .agg(F.min(value).alias(value), (F.count(value) == F.count(F.lit(1))).alias("_whole"))
            .where(F.col("_whole")).drop("_whole"))
    return key_join(df.where(F.col(value).isNotNull()), lows, [*groups, value], "left_semi")
