"""Joins with the analyst's key rules: missing matches missing, duplicates multiply."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may take before the key is dealt over several tasks.
HOT_ROWS = 1_000_000
# Bounds of the broadcast list of hot keys and of the salts of one key.
MOST_HOT = 1000
MOST_SALTS = 1000
_SALT = "_salt"


def _null_safe(pairs) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in pairs])


def _pairs(on) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def key_join(left: DataFrame, right: DataFrame, on: Sequence | None = None, how: str = "left") -> DataFrame:
    """Null-safe equi-join keeping one key column per pair, named as on the left.

    ``on`` holds names or ``(left, right)`` pairs; by default all common columns.
    The key is taken from the side that is kept whole (both, coalesced, for ``full``).
    """
    pairs = _pairs(on if on is not None else natural_keys(left, right))
    if not pairs:
        raise ValueError("no common columns to join on")
    if how in ("left_semi", "left_anti"):
        renamed = right.select(*[F.col(f"`{b}`").alias(f"_r_{b}") for _, b in pairs])
        return left.join(renamed, _null_safe([(a, f"_r_{b}") for a, b in pairs]), how)
    renamed = right.withColumnsRenamed({b: f"_r_{b}" for _, b in pairs})
    joined = left.join(renamed, _null_safe([(a, f"_r_{b}") for a, b in pairs]), how)
    if how == "right":
        keys = {a: F.col(f"_r_{b}") for a, b in pairs}
    elif how == "full":
        keys = {a: F.coalesce(F.col(f"`{a}`"), F.col(f"_r_{b}")) for a, b in pairs}
    else:
        keys = {}
    return joined.withColumns(keys).drop(*[f"_r_{b}" for _, b in pairs])


def semi(left: DataFrame, right: DataFrame, on: Sequence) -> DataFrame:
    return key_join(left, right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence) -> DataFrame:
    """Rows whose key is not in ``right``; rows with a missing key stay unless ``right`` lists it."""
    return key_join(left, right, on, "left_anti")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows, at most ``MOST_HOT`` of them, largest first, with a number of salts.

    The constant bound makes the list safe to broadcast at any size. A key that misses the
    list has fewer rows than each of ``MOST_HOT`` others, so under a thousandth of the table.
    """
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), *keys).limit(MOST_HOT)
        .select(*[F.col(k).alias(f"_h_{k}") for k in keys],
                F.least(F.ceil(F.col("_n") / F.lit(hot_rows)), F.lit(MOST_SALTS)).cast("int").alias("_salts"))
    )


def spread(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS,
           row_key: Sequence[str] = ()):
    """Deal the rows of hot ``left`` keys over several salts and repeat the matching right rows.

    Returns both sides with an extra join key. ``row_key`` names columns that tell rows of
    one key apart; the salt is their hash. Without it the row's place in its partition is
    used, which is repeatable for tables read from files; name a row key where ``left`` comes
    out of a shuffle. The counting pass reads only the key columns and combines before its
    shuffle.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, hot_rows)

    def with_salts(df: DataFrame) -> DataFrame:
        cond = _null_safe([(k, f"_h_{k}") for k in keys])
        return df.join(F.broadcast(hot), cond, "left").drop(*[f"_h_{k}" for k in keys])

    if row_key:
        row, source = F.xxhash64(*[F.col(f"`{c}`") for c in row_key]), left
    else:
        row, source = F.col("_place"), left.withColumn("_place", F.monotonically_increasing_id())
    dealt = with_salts(source).withColumn(
        _SALT, F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(row, F.col("_salts")).cast("int"))
    ).drop("_salts", "_place")
    repeated = with_salts(right).withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return dealt, repeated


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                hot_rows: int = HOT_ROWS, row_key: Sequence[str] = ()) -> DataFrame:
    """``key_join`` on equally named keys for a left side whose keys may be very uneven.

    Only joins that keep no unmatched right row are possible: the right rows of a hot key
    are repeated, and each repeat would be kept by itself.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot keep unmatched right rows (how={how!r})")
    dealt, repeated = spread(left, right, keys, hot_rows, row_key)
    return key_join(dealt, repeated, [*keys, _SALT], how).drop(_SALT)


def _constant(df: DataFrame, key: str, table: dict, value_type: str) -> Column:
    """Value of ``key`` in a constant table as a map literal; missing where not listed."""
    key_type = df.schema[key].dataType
    pairs = [c for k, v in table.items() for c in (F.lit(k).cast(key_type), F.lit(v).cast(value_type))]
    return F.try_element_at(F.create_map(*pairs), F.col(key))


def lookup(df: DataFrame, key: str, table: dict, out: str, value_type: str = "string") -> DataFrame:
    """Code to label through a constant table (its size is fixed by the program text)."""
    return df.withColumn(out, _constant(df, key, table, value_type))


def override(df: DataFrame, key: str, fixes: dict, out: str) -> DataFrame:
    """Point overrides: where ``key`` is listed, ``out`` takes the listed value."""
    fixed = _constant(df, key, fixes, df.schema[out].dataType.simpleString())
    return df.withColumn(out, F.coalesce(fixed, F.col(out)))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key of either table with where it was found: ``both``, ``only_left``, ``only_right``."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    status = (F.when(F.col("n_left").isNull(), "only_right")
              .when(F.col("n_right").isNull(), "only_left").otherwise("both"))
    return key_join(a, b, [key], "full").withColumn("status", status).fillna(0, ["n_left", "n_right"])
