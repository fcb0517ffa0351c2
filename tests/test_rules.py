"""One literal-row test per missing-value and rounding rule."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crosstie.functions import measures, nulls, rules, text
from crosstie.operators import joins, reshape, tables, windows


def values(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_not_in_keeps_missing(rows):
    df = rows([("a",), (None,), ("b",)], "x string")
    assert values(df.where(nulls.not_in_keep_null("x", ["a"])), "x") == [None, "b"]


def test_unequal_drops_missing(rows):
    df = rows([("a",), (None,), ("b",)], "x string")
    assert values(df.where(F.col("x") != "a"), "x") == ["b"]


def test_if_else_keeps_missing_condition(rows):
    df = rows([(1,), (2,), (None,)], "p int").select(rules.pedestrian_flag("p").alias("o"))
    assert values(df, "o") == ["No", "Yes", None]


def test_case_ignores_missing_condition_and_takes_first(rows):
    df = rows([(None, "1"), ("2", "1"), ("0", None), ("x", "0")], "k string, i string")
    assert values(df.select(rules.severity("k", "i").alias("o")), "o") == ["Injury", "Fatal", "PDO", "PDO"]


def test_join_matches_missing_keys_and_multiplies(rows):
    left = rows([(1, "a"), (None, "b")], "k int, v string")
    right = rows([(None, 10), (1, 20), (1, 30)], "k int, w int")
    out = sorted(((r.v, r.w) for r in joins.key_join(left, right).collect()), key=str)
    assert out == [("a", 20), ("a", 30), ("b", 10)]


def test_natural_keys_are_the_common_names(rows):
    left, right = rows([(1, 2, 3)], "a int, b int, c int"), rows([(1, 2, 9)], "b int, a int, d int")
    assert joins.natural_keys(left, right) == ["a", "b"]
    assert joins.key_join(left, right).columns == ["a", "b", "c", "d"]


def test_full_and_right_join_keep_one_key(rows):
    left, right = rows([(1, "a")], "k int, v string"), rows([(2, "z")], "k2 int, w string")
    full = joins.key_join(left, right, [("k", "k2")], "full")
    assert sorted(values(full, "k")) == [1, 2] and full.columns == ["k", "v", "w"]
    assert values(joins.key_join(left, right, [("k", "k2")], "right"), "k") == [2]


def test_sum_is_missing_if_any_is(rows):
    df = rows([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    out = {r.g: r.s for r in tables.sums_by(df, ["g"], {"s": "v"}).collect()}
    assert out == {"a": None, "b": 2.0}


def test_paste_writes_missing_as_text(rows):
    df = rows([("a", None)], "x string, y string")
    assert values(df.select(nulls.paste("x", F.lit("_to_"), "y").alias("o")), "o") == ["a_to_NA"]


@pytest.mark.parametrize("given, expected", [("12", 12.0), (" 3.5 ", 3.5), ("x", None), ("1d", None), ("2F ", None),
                                             ("", None), (None, None), ("1e3", 1000.0)])
def test_text_to_number(rows, given, expected):
    df = rows([(given,)], "x string")
    assert values(df.select(nulls.to_number("x").alias("o")), "o") == [expected]


def test_ratio_of_zero_is_missing(rows):
    df = rows([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert values(df.select(nulls.ratio("a", "b").alias("o")), "o") == [None, None, 0.25]


def test_round_half_even_on_binary_value(rows):
    df = rows([(2.5, 1.275), (3.5, 81.025), (-0.5, 0.125)], "a double, b double")
    out = df.select(measures.half_even("a").alias("a"), measures.half_even("b", 2).alias("b"))
    assert values(out, "a") == [2.0, 4.0, 0.0] and values(out, "b") == [1.27, 81.03, 0.12]


def test_sort_puts_missing_last_both_ways(rows):
    df = rows([(2,), (None,), (1,)], "x int")
    assert values(tables.sort_last(df, "x"), "x") == [1, 2, None]
    assert values(tables.sort_last(df, "-x"), "x") == [2, 1, None]


def test_average_rank(rows):
    df = rows([("a", 10), ("b", 20), ("c", 20), ("d", 30), ("e", None)], "k string, v int").withColumn("g", F.lit(1))
    out = {r.k: r.rank for r in windows.average_rank(df, ["g"], "v", "rank").collect()}
    assert out == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0, "e": None}


def test_hour_and_timestamp(rows):
    df = rows([("1", "PM"), ("12", "PM"), ("12", "AM"), ("9", None)], "h string, a string")
    assert values(df.select(measures.hour_24("h", "a").alias("o")), "o") == [13, 12, 12, None]
    parts = rows([("5", "2", "29", "7"), ("4", "2", "29", "7")], "y string, m string, d string, mi string")
    stamp = measures.crash_timestamp("y", "m", "d", F.lit(8), "mi").alias("o")
    assert values(parts.select(stamp), "o") == [None, datetime(2004, 2, 29, 8, 7)]


def test_narrative(rows):
    df = rows([("THE NARROW", None), (None, "B")], "a string, b string")
    assert values(df.select(text.narrative("a", "b").alias("o")), "o") == ["THE NARROW", "B"]
    literal = df.select(text.narrative("a", "b", literal=True).alias("o"))
    assert values(literal, "o") == ["THERROW", "NA B"]


def test_declared_severities_are_filled(rows):
    df = rows([(1, "Fatal"), (1, "Fatal")], "k int, s string")
    out = reshape.widen_counts(df, ["k"], "s", rules.SEVERITIES).first().asDict()
    assert out == {"k": 1, "PDO": 0, "Injury": 0, "Fatal": 2}


def test_four_quadrant_gates_differ_between_groupings(rows):
    df = rows([("FourQuad",)], "d string")
    out = df.select(rules.device_group("d").alias("g"), rules.existing_class("d").alias("e")).first()
    assert (out.g, out.e) == ("Passive", "gates")


def test_unclassified_change_gives_sentinel(rows):
    df = rows([("gates_to_FL", 1.0, 1), ("pass_to_gates", 11.0, 2), ("pass_to_gates", None, 2), ("gates_to_NA", 1.0, 1)],
              "c string, n double, k int")
    assert values(df.select(rules.base_reduction("c", "n", "k").alias("o")), "o") == [99.0, 0.78, 99.0, 99.0]
    tier1 = df.select(rules.base_reduction("c", "n", "k", F.col("c")).alias("o"))
    assert values(tier1, "o") == [99.0, 0.78, 99.0, 0.0]


def test_group_min_keeps_ties_and_skips_nan(rows):
    df = rows([("a", 1.0, 1), ("a", 1.0, 2), ("a", 2.0, 3), ("b", float("nan"), 4), (None, 5.0, 5)],
              "g string, v double, i int")
    assert sorted(values(windows.keep_group_min(df, ["g"], "v"), "i")) == [1, 2, 5]


def test_wide_rows_split_when_ids_differ(rows):
    df = rows([(1, 5, "base", 1.0), (1, 6, "closure", 2.0)], "id int, trips int, s string, d double")
    assert reshape.widen(df, ["id", "trips"], "s", ["base", "closure"], ["d"]).count() == 2


def test_spread_fills_key_and_totals(rows):
    df = rows([(None, "a", 1.0), (7, "b", 2.0)], "k int, g string, v double")
    out = sorted((r.k, r.a, r.b, r.t) for r in reshape.spread_total(df, "k", "g", ["a", "b"], "v", "t").collect())
    assert out == [(0, 1.0, 0.0, 1.0), (7, 0.0, 2.0, 2.0)]


def test_title_case_breaks_at_hyphens(rows):
    df = rows([("QUARRY ind-LD",), (None,)], "x string")
    assert values(df.select(text.title_case("x").alias("o")), "o") == ["Quarry Ind-Ld", None]


def test_clean_names():
    assert text.clean_names(["CrossingID", "Final ADT V2", "Est 1-yr Incidents", "x", "X"]) == [
        "crossing_id", "final_adt_v2", "est_1_yr_incidents", "x", "x_2"]


def test_override_and_reconcile(rows):
    df = rows([(1, "a"), (2, "b")], "k bigint, v string")
    out = {r.k: r.v for r in joins.override(df, "k", {2: "z"}, "v").collect()}
    assert out == {1: "a", 2: "z"}
    other = rows([(2,), (2,), (3,)], "k bigint")
    found = {r.k: (r.status, r.n_left, r.n_right) for r in joins.reconcile(df, other, "k").collect()}
    assert found == {1: ("only_left", 1, 0), 2: ("both", 1, 2), 3: ("only_right", 0, 1)}


def test_union_fills_missing_columns(rows):
    out = tables.union_by_name(rows([(1,)], "a int"), rows([(2,)], "b int"))
    assert sorted(((r.a, r.b) for r in out.collect()), key=str) == [(1, None), (None, 2)]


def test_undeclared_names_count_in_the_total(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "new", 5.0), (1, None, 1.0), (2, "b", None)], "k long, g string, v double")
    rows = reshape.spread_total(df, "k", "g", ["a", "b"], "v", "t").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 2.0, 0.0, 8.0), (2, 0.0, 0.0, 0.0)]
    kept = reshape.spread_total(df, "k", "g", ["a", "b"], "v", "t", "rest").orderBy("k").first()
    assert (kept.rest, kept.t) == (6.0, 8.0)
    found = reshape.spread_total(df, "k", "g", None, "v", "t")
    assert found.columns == ["k", "a", "b", "new", "NA", "t"] and found.orderBy("k").first().t == 8.0
    with pytest.raises(ValueError):
        reshape.names_in(df, "g", 2)
    empty = reshape.spread_total(df.limit(0), "k", "g", None, "v", "t")
    assert empty.columns == ["k", "t"] and empty.count() == 0
