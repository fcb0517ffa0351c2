"""Results do not change when a third or more of the rows share one key, position or group."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstie.geo import hexgrid, match, polygons, shapes
from crosstie.operators import joins, windows


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def uneven(spark, n=3000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))


def test_spread_join_equals_plain_join(spark):
    left = uneven(spark)
    right = spark.createDataFrame([(-1, "hot"), (1, "x"), (1, "y"), (99, "z")], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = joins.key_join(left, right, ["k"], how)
        assert as_set(joins.spread_join(left, right, ["k"], how, hot_rows=100)) == as_set(plain)
        assert as_set(joins.spread_join(left, right, ["k"], how, hot_rows=100, row_key=["id"])) == as_set(plain)
        assert as_set(joins.spread_join(left, right, ["k"], how)) == as_set(plain)
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            joins.spread_join(left, right, ["k"], how, hot_rows=100)


def test_equal_rows_of_a_hot_key_are_dealt_out(spark):
    left = spark.range(3000).select(F.lit(7).alias("k"))
    dealt, _ = joins.spread(left, spark.createDataFrame([(7, "v")], "k int, v string"), ["k"], 100)
    assert dealt.select("_salt").distinct().count() == 30


def test_hot_list_has_a_constant_bound(spark):
    keys = spark.range(6000).select((F.col("id") % 1500).alias("k"))
    assert joins.hot_keys(keys, ["k"], 1).count() == joins.MOST_HOT


def test_hot_key_is_dealt_over_several_salts(spark):
    left, right = joins.spread(uneven(spark), spark.createDataFrame([(-1, "hot"), (5, "c")], "k bigint, v string"), ["k"], 100)
    salts = {r.k: r.n for r in left.groupBy("k").agg(F.countDistinct("_salt").alias("n")).collect()}
    assert salts[-1] == 10 and salts[5] == 1
    assert right.where("k = -1").count() == 10 and right.where("k = 5").count() == 1


def test_numbering_is_the_same_when_groups_are_sliced(spark):
    df = uneven(spark).withColumn("pos", (F.col("id") * 7919) % 101)
    order = [F.col("pos"), F.col("id")]
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    sliced = windows.number_in_order(df, ["k"], order, "n")
    assert as_set(sliced.select("id", "n")) == as_set(plain.select("id", "n"))
    assert dict(sliced.dtypes)["n"] == "bigint"
    whole = windows.number_in_order(df, [], order, "n")
    assert sorted(r.n for r in whole.collect()) == list(range(1, 3001))


def test_ranks_are_the_same_when_groups_are_sliced(spark):
    df = uneven(spark).withColumn("v", (F.col("id") * 31) % 400).withColumn("g", F.lit("all"))
    v = Window.partitionBy("g", "v")
    plain = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("v")) + (F.count(F.lit(1)).over(v) - 1) / F.lit(2.0))
    assert as_set(windows.average_rank(df, ["g"], "v", "r").select("id", "r")) == as_set(plain.select("id", "r"))


def crowded(spark):
    """Points of which a third are copies of one position and a third lie in one small area."""
    i = F.col("id")
    x = F.when(i % 3 == 0, 500.0).when(i % 3 == 1, 5000.0 + (i * 37) % 211).otherwise((i * 7919) % 20011)
    y = F.when(i % 3 == 0, 700.0).when(i % 3 == 1, 5000.0 + (i * 53) % 197).otherwise((i * 104729) % 20011)
    return spark.range(900).select("id", x.cast("double").alias("x"), y.cast("double").alias("y"))


def brute_neighbours(points, d):
    rows = points.collect()
    return sorted((a.id, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= d * d for b in rows)) for a in rows)


def test_neighbour_counts_in_crowds(spark):
    points = crowded(spark)
    for d, split in ((150.0, 8), (1609.0, 4)):
        found = match.neighbour_counts(points, d, "n", split=split, hot_rows=50).select("id", "n")
        assert sorted(map(tuple, found.collect())) == brute_neighbours(points, d)


def test_neighbour_counts_halve_crowded_cells(spark):
    points = crowded(spark)
    d = 150.0
    found = match.neighbours_by_position(points, d, "n", split=2, crowd=3)
    assert {(r.x, r.y): r.n for r in found.collect()} == {
        (r.x, r.y): n for r, (_, n) in zip(sorted(points.collect(), key=lambda r: r.id), brute_neighbours(points, d), strict=True)}
    locs = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    assert len(match.settled_cells(locs, d, 2, 3)) > 2
    assert match.neighbours_by_position(points.limit(0), d).count() == 0


def compared_positions(spark, n):
    """Pairs of positions left to compare, and pairs of cells, for n positions in one square of twice the distance."""
    step = 2000.0 / n ** 0.5
    side = int(n ** 0.5)
    locs = spark.range(n).selectExpr(f"(id % {side}) * {step}D AS x", f"floor(id / {side}) * {step}D AS y", "1L AS w")
    counts = [pairs.agg(F.expr("sum(IF(sure, 0, m * b_m))"), F.count(F.lit(1))).first()
              for _, pairs in match.settled_cells(locs, 1000.0, 2, 8)]
    return sum(c[0] or 0 for c in counts), sum(c[1] for c in counts)


def test_neighbour_pairs_grow_less_than_squared(spark):
    few, many = compared_positions(spark, 24 ** 2), compared_positions(spark, 96 ** 2)
    # 16 times the positions: all pairs would be 256 times as many, the cells along the circles are 64 times as many.
    assert many[0] < 80 * few[0] and many[1] < 80 * few[1]
    assert many[0] < 0.15 * (96 ** 2) ** 2


def test_line_search_halves_crowded_cells(spark, monkeypatch):
    """Many short segments in one place, of which some only just reach the others."""
    mine = spark.range(300).selectExpr("id AS line_id", "(id % 20) * 11D AS x1", "floor(id / 20) * 13D AS y1",
                                       "(id % 20) * 11D + 7 AS x2", "floor(id / 20) * 13D + 5 AS y2")
    theirs = spark.range(200).selectExpr("400D + (id % 10) * 9 AS x1", "(id % 37) * 5D AS y1", "404D + (id % 10) * 9 AS x2", "(id % 37) * 5D + 3 AS y2")
    seen = []
    close = match._close
    monkeypatch.setattr(match, "_close", lambda m, pairs, *rest: seen.append(pairs) or close(m, pairs, *rest))
    for distance in (215.0, 260.0):
        seen.clear()
        found = {r.line_id for r in match.segments_within(mine, ["line_id"], theirs, distance, crowd=4).collect()}
        assert len(seen) > 1
        compared = sum(p.agg(F.sum(F.col("m") * F.col("o_m"))).first()[0] or 0 for p in seen)
        plain = {r.line_id for r in match.segments_within(mine, ["line_id"], theirs, distance, crowd=10 ** 6).collect()}
        exact = match.segment_segment_sq(match.ENDS, [f"o_{c}" for c in match.ENDS])
        o = theirs.withColumnsRenamed({c: f"o_{c}" for c in match.ENDS})
        brute = {r.line_id for r in mine.withColumn("k", F.lit(1)).join(o.withColumn("k", F.lit(1)), "k")
                 .where(f"{exact} <= {distance ** 2}").select("line_id").distinct().collect()}
        assert found == plain == brute and 0 < len(brute) < 300
        assert compared < 300 * 200


def test_crowded_cells_meet_few_segments(spark):
    """One cell with most points and all segments: equal to brute force, with few comparisons."""
    points = spark.range(2500).selectExpr("id", "(id % 50) * 9.7D + 3 AS x", "floor(id / 50) * 9.7D + 2 AS y").union(
        spark.sql("SELECT 9000L, 7000D, 7000D UNION ALL SELECT 9001L, CAST('NaN' AS DOUBLE), 3D UNION ALL SELECT 9002L, NULL, 3D"))
    lines = spark.range(300).selectExpr("CAST(id AS INT) AS line_id", "0 AS seq", "(id * 37) % 491 * 1D AS x1", "(id * 91) % 487 * 1D AS y1",
                                        "(id * 37) % 491 + 5D AS x2", "(id * 91) % 487 + 4D AS y2")
    sq = match.point_segment_sq("x", "y")
    pairs = points.withColumn("k", F.lit(1)).join(lines.withColumn("k", F.lit(1)), "k").selectExpr("id", "line_id", f"{sq} AS sq").where("sq IS NOT NULL AND NOT isnan(sq)").collect()
    compared = {}
    for distance in (15.0, 120.0):
        close = [r for r in pairs if r.sq <= distance ** 2]
        best = {}
        for r in sorted(close, key=lambda r: (r.sq, r.line_id)):
            best.setdefault(r.id, r.line_id)
        assert {r.id: r.line_id for r in match.nearest_line(points, lines, distance, ["line_id"], crowd=100).collect()} == best
        assert sorted(r.id for r in match.within_lines(points, lines, distance, crowd=100).collect()) == sorted(best)
        assert {(r.id, r.line_id) for r in match.join_within(points, lines, distance, ["line_id"], crowd=100).collect()} == {
            (r.id, r.line_id) for r in close}
        placed = shapes.with_cell(points.where("NOT isnan(x)"), 500.0).selectExpr("*", "floor(x / 15.625D) AS _fx", "floor(y / 15.625D) AS _fy")
        cover = shapes.cover_segments(lines, 500.0, distance)
        for wanted in ("nearest", "any"):
            compared[distance, wanted] = placed.join(match.fine_candidates(placed, cover, distance, wanted), ["_fx", "_fy"]).count()
    assert max(compared.values()) < 0.1 * 2500 * 300 and compared[120.0, "any"] <= 2501


def test_copies_are_kept_by_spatial_joins(spark):
    points = crowded(spark)
    line = spark.createDataFrame([(1, 0, 0.0, 650.0, 900.0, 650.0)], "line_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    near = match.nearest_line(points, line, 60.0, ["line_id"], hot_rows=50)
    kept = {r.id for r in near.collect()}
    assert {r.id for r in points.where("x = 500 AND y = 700").collect()} <= kept
    assert kept == {r.id for r in match.within_lines(points, line, 60.0).collect()}


def test_density_in_crowds(spark):
    points = crowded(spark)
    ring = [(0, 0), (4000, 0), (4000, 4000), (0, 4000), (0, 0)]
    edges = spark.createDataFrame([(1, 0, i, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
                                   for i, (a, b) in enumerate(zip(ring, ring[1:]))],
                                  "poly_id int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    rows = [r for r in points.collect()]
    out = polygons.circle_shares(shapes.locations(points), edges, 1609.0).collect()
    assert len(out) == len({(r.x, r.y) for r in rows if r.x < 5609 and r.y < 5609 and
                            max(0.0, r.x - 4000) ** 2 + max(0.0, r.y - 4000) ** 2 < 1609.0 ** 2})
    assert all(0 < r.shared <= 3.1415926536 * 1609.0 ** 2 + 1e-3 for r in out)


def test_lattice_joins_no_shuffled_groups(spark):
    segments = spark.range(40).selectExpr("id % 2 AS g", "id * 700D AS x1", "id * 30D AS y1", "(id + 1) * 700D AS x2", "(id + 1) * 30D AS y2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells = hexgrid.hex_cells(segments, 900.0, 500.0, ["g"])
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    few, hexgrid.MOST_ORIGINS = hexgrid.MOST_ORIGINS, 1
    try:
        assert as_set(hexgrid.hex_cells(segments, 900.0, 500.0, ["g"])) == as_set(cells)
    finally:
        hexgrid.MOST_ORIGINS = few
