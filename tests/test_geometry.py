"""Geometry properties and comparisons with brute force."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from crosstie.geo import hexgrid, match, polygons, project, shapes
from crosstie.geo.measure import length, segment_segment_sq

SEG = "line_id int, seq int, x1 double, y1 double, x2 double, y2 double"
EDGE = "poly_id int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def ring_rows(poly, ring, pts):
    return [(poly, ring, i, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
            for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))]


@pytest.fixture(scope="module")
def donut(spark):
    outer = [(0, 0), (10000, 0), (10000, 10000), (0, 10000)]
    hole = [(4000, 4000), (4000, 6000), (6000, 6000), (6000, 4000)]
    return spark.createDataFrame(ring_rows(1, 0, outer) + ring_rows(1, 1, hole), EDGE)


def points(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")


def test_projection_round_trip(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-95.8, -89.0), rng.uniform(35.9, 40.7)) for _ in range(300)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = project.project("lon", "lat")
    lon, lat = project.unproject("x", "y")
    back = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2"))
    worst = max(max(abs(r.lon - r.lon2) * math.cos(math.radians(r.lat)), abs(r.lat - r.lat2)) for r in back.collect())
    assert worst * 111_000 < 0.002


def test_projection_origin_and_scale(spark):
    x, y = project.project("lon", "lat")
    df = spark.createDataFrame([(-92.5, 35 + 50 / 60), (-92.5, 36 + 50 / 60)], "lon double, lat double")
    a, b = df.select(x.alias("x"), y.alias("y")).collect()
    assert a.x == pytest.approx(500000) and a.y == pytest.approx(0, abs=1e-6)
    assert b.y == pytest.approx(110965, abs=40)


def test_area_ignores_direction_and_subtracts_holes(spark, donut):
    flipped = donut.select("poly_id", "ring", "seq", F.col("x2").alias("x1"), F.col("y2").alias("y1"),
                           F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    for edges in (donut, flipped):
        assert polygons.areas(edges).first().area == pytest.approx(96e6)


def test_containment_with_hole_and_boundary(spark, donut):
    pts = points(spark, [(1000, 1000), (5000, 5000), (0, 500), (4000, 5000), (10500, 1), (10000, 10000), (-1, 5000)])
    inside = {r.id for r in polygons.join_polygons(pts, donut).collect()}
    assert inside == {0, 2, 3, 5}


def test_circle_share(spark, donut):
    r = 1609.0
    pts = [(2000, 2000), (0, 5000), (5000, 5000), (20000, 20000), (0, 0)]
    df = points(spark, pts)
    shares = {(s.x, s.y): s.shared for s in polygons.circle_shares(shapes.locations(df), donut, r).collect()}
    assert shares[(2000.0, 2000.0)] == pytest.approx(math.pi * r * r)
    assert shares[(0.0, 5000.0)] == pytest.approx(math.pi * r * r / 2)
    assert shares[(0.0, 0.0)] == pytest.approx(math.pi * r * r / 4)
    assert (20000.0, 20000.0) not in shares
    corner = math.pi * r * r - 4e6  # the circle contains the hole
    assert shares[(5000.0, 5000.0)] == pytest.approx(corner)


def test_density_of_uniform_area(spark, donut):
    counts = spark.createDataFrame([(1, 960.0)], "poly_id int, estimate double")
    out = polygons.areal_density(shapes.locations(points(spark, [(2000, 2000), (0, 9000)])), donut, counts, 1609.0)
    for r in out.collect():
        assert r.density == pytest.approx(960 / (96e6 / 2.59e6))


def test_clip_lengths(spark, donut):
    segs = spark.createDataFrame([
        (1, 0, -5000.0, 5000.0, 15000.0, 5000.0), (2, 0, 1000.0, 1000.0, 2000.0, 1000.0),
        (3, 0, -10.0, -10.0, -10.0, 50.0), (4, 0, 4500.0, 5000.0, 5500.0, 5000.0), (5, 0, 0.0, 100.0, 0.0, 300.0)], SEG)
    out = polygons.clipped_lengths(polygons.clip_lines(segs, donut), ["line_id"])
    found = {r.line_id: r.length for r in out.collect()}
    assert found == {1: pytest.approx(8000), 2: pytest.approx(1000), 5: pytest.approx(200)}


def test_lines_and_polygons(spark, donut):
    segs = spark.createDataFrame([
        (1, 0, -5000.0, 5000.0, 15000.0, 5000.0), (2, 0, 1000.0, 1000.0, 1100.0, 1000.0),
        (3, 0, -10.0, -10.0, -10.0, 50.0), (4, 0, 4900.0, 5000.0, 5100.0, 5000.0)], SEG)
    assert {r.line_id for r in polygons.lines_meeting_polygons(segs, donut).collect()} == {1, 2}
    assert {r.line_id for r in polygons.lines_near_polygons(segs, donut, 20.0).collect()} == {1, 2, 3}
    assert {r.line_id for r in polygons.lines_near_polygons(segs, donut, 950.0).collect()} == {1, 2, 3, 4}


def random_segments(seed, n, size=30000.0, step=4000.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, size), rng.uniform(0, size)
        out.append((i, 0, x, y, x + rng.uniform(-step, step), y + rng.uniform(-step, step)))
    return out


def point_gap(x, y, s):
    dx, dy = s[4] - s[2], s[5] - s[3]
    t = max(0.0, min(1.0, ((x - s[2]) * dx + (y - s[3]) * dy) / (dx * dx + dy * dy or 1)))
    return math.hypot(s[2] + t * dx - x, s[3] + t * dy - y)


@pytest.mark.parametrize("distance", [20.0, 400.0, 2640.0])
def test_near_search_equals_brute_force(spark, distance):
    segs = random_segments(3, 40)
    rng = random.Random(4)
    pts = [(rng.uniform(0, 30000), rng.uniform(0, 30000)) for _ in range(200)]
    df, lines = points(spark, pts), spark.createDataFrame(segs, SEG)
    expected = {}
    for i, (x, y) in enumerate(pts):
        gap, line = min((point_gap(x, y, s), s[0]) for s in segs)
        if gap <= distance:
            expected[i] = line
    assert {r.id: r.line_id for r in match.nearest_line(df, lines, distance, ["line_id"]).collect()} == expected
    assert {r.id for r in match.within_lines(df, lines, distance).collect()} == set(expected)
    pairs = {(i, s[0]) for i, (x, y) in enumerate(pts) for s in segs if point_gap(x, y, s) <= distance}
    assert {(r.id, r.line_id) for r in match.join_within(df, lines, distance, ["line_id"]).collect()} == pairs


@pytest.mark.parametrize("distance", [50.0, 700.0, 6000.0])
def test_lines_near_lines_equals_brute_force(spark, distance):
    mine = spark.createDataFrame(random_segments(5, 60, 60000.0), SEG)
    theirs = spark.createDataFrame(random_segments(6, 6, 60000.0), SEG)
    ends = ("x1", "y1", "x2", "y2")
    both = mine.join(theirs.select(*[F.col(c).alias(f"o_{c}") for c in ends]), F.lit(True))
    sq = F.expr(segment_segment_sq(ends, [f"o_{c}" for c in ends]))
    expected = {r.line_id for r in both.where(sq <= distance ** 2).collect()}
    assert {r.line_id for r in match.segments_within(mine, ["line_id"], theirs, distance).collect()} == expected


def test_cover_lists_each_cell_once_and_holds_every_point(spark):
    segs = spark.createDataFrame(random_segments(8, 50, step=9000.0), SEG)
    cover = shapes.cover_segments(segs, 500.0, 120.0)
    assert cover.count() == cover.distinct().count()
    on = segs.selectExpr("*", "explode(sequence(0, 40)) AS i").selectExpr(
        "line_id", "x1 + (x2 - x1) * i / 40 AS x", "y1 + (y2 - y1) * i / 40 AS y")
    missing = shapes.with_cell(on, 500.0).join(cover.select("line_id", "cx", "cy"), ["line_id", "cx", "cy"], "left_anti")
    assert missing.count() == 0


def test_hex_cells_tile_the_line(spark):
    segs = spark.createDataFrame(random_segments(9, 12), SEG).withColumn("g", F.lit("a"))
    cells = hexgrid.hex_cells(segs, 3000.0, 1500.0, ["g"])
    assert cells.count() == cells.select("row", "cell").distinct().count()
    cut = hexgrid.mark_cut_cells(cells, segs, 20.0, 3000.0, 1500.0, ["g"])
    whole = segs.selectExpr(f"sum({length()})").first()[0]
    assert cut.agg(F.sum("line_length")).first()[0] == pytest.approx(whole)
    assert cut.where("line_length > 0 AND NOT is_cut").count() == 0


def test_hex_cells_reach_the_distance(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0)], SEG)
    cells = [(r.hx, r.hy) for r in hexgrid.hex_cells(segs, 2000.0, 1000.0).collect()]
    ring = [(math.hypot(max(0.0, -hx, hx - 100.0), hy)) for hx, hy in cells]
    assert max(ring) <= 2000 + 1000 / math.sqrt(3) + 1e-6
    assert len(cells) > 12


def test_array_geometry_to_tables(spark):
    lines = spark.sql("SELECT 1 AS line_id, array(struct(0D AS x, 0D AS y), struct(3D AS x, 4D AS y), struct(3D AS x, 5D AS y)) AS points")
    out = shapes.segments_from_points(lines)
    assert [(r.seq, r.x1, r.y2) for r in out.orderBy("seq").collect()] == [(0, 0.0, 4.0), (1, 3.0, 5.0)]
    polys = lines.select(F.col("line_id").alias("poly_id"), F.array("points", "points").alias("rings"))
    assert {r.ring for r in shapes.edges_from_rings(polys).collect()} == {0, 1}


def test_dissolve_ignores_direction(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0), (2, 0, 1.0, 1.0, 0.0, 0.0), (2, 1, 1.0, 1.0, 2.0, 0.0)], SEG)
    assert shapes.dissolve(segs).count() == 2


# Boundary contact against exact fractions

def plain_clip(seg, rings):
    """Length of a segment in a closed polygon (boundary included), and whether they meet, in exact arithmetic."""
    a, b = [tuple(map(Fraction, p)) for p in seg]
    edges = [(tuple(map(Fraction, p)), tuple(map(Fraction, q))) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]
    d = (b[0] - a[0], b[1] - a[1])
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    less = lambda p, q: (p[0] - q[0], p[1] - q[1])
    dd = d[0] ** 2 + d[1] ** 2
    stops = {Fraction(0), Fraction(1)}
    for p, q in edges:
        e = less(q, p)
        if cross(d, e):
            t, u = cross(less(p, a), e) / cross(d, e), cross(less(p, a), d) / cross(d, e)
            if 0 <= t <= 1 and 0 <= u <= 1:
                stops.add(t)
        elif cross(d, less(p, a)) == 0:
            for r in (p, q):
                t = (less(r, a)[0] * d[0] + less(r, a)[1] * d[1]) / dd
                if 0 <= t <= 1:
                    stops.add(t)

    def held(x, y):
        odd = False
        for (px, py), (qx, qy) in edges:
            if (qx - px) * (y - py) == (qy - py) * (x - px) and min(px, qx) <= x <= max(px, qx) and min(py, qy) <= y <= max(py, qy):
                return True
            if (py > y) != (qy > y) and px + (y - py) * (qx - px) / (qy - py) > x:
                odd = not odd
        return odd

    at = lambda t: (a[0] + t * d[0], a[1] + t * d[1])
    order = sorted(stops)
    kept = sum(t2 - t1 for t1, t2 in zip(order, order[1:]) if held(*at((t1 + t2) / 2)))
    return float(kept) * math.sqrt(dd), any(held(*at(t)) for t in order)


SQUARE = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]
SQUARE_HOLE = [(300, 300), (300, 700), (700, 700), (700, 300)]
ALONG = [((0, 300), (0, 800)), ((0, -500), (0, 500)), ((-500, 0), (1500, 0)), ((1000, 1000), (1500, 1500)), ((-500, 500), (500, -500)), ((500, -500), (-500, 1500)),
         ((-100, 1000), (500, 1000)), ((0, 0), (1000, 1000)), ((300, 0), (300, 1000)), ((300, 400), (300, 600)), ((350, 300), (650, 300)), ((400, 400), (600, 600)),
         ((300, 500), (700, 500)), ((200, 800), (800, 200)), ((200, 400), (400, 200)), ((1000, 200), (2000, 200)), ((-300, 1200), (-1, 1200)), ((1000, -10), (1000, 1010)),
         ((-10, -10), (0, 0)), ((-10, 5), (0, 5)), ((0, 1000), (1000, 1000)), ((2000, 0), (3000, 0)), ((700, 700), (1000, 1000)), ((0, 0), (0, 1000))]


@pytest.mark.parametrize("shift", [0, 1500, 2000])
def test_boundary_contact_is_exact(spark, shift):
    """Both directions of rings and lines, with and without hole, on and off the grid of cells."""
    move = lambda p: (p[0] + shift, p[1] + shift)
    shapes_ = [([SQUARE], 1), ([SQUARE[::-1]], 2), ([SQUARE, SQUARE_HOLE], 3), ([SQUARE[::-1], SQUARE_HOLE[::-1]], 4)]
    rng = random.Random(shift)
    some = lambda: (rng.randrange(-2, 13) * 100, rng.randrange(-2, 13) * 100)
    lines = [*ALONG, *[(b, a) for a, b in ALONG], *[(p, q) for p, q in ((some(), some()) for _ in range(60)) if p != q]]
    edges = [r for rings, n in shapes_ for k, ring in enumerate(rings) for r in ring_rows(n, k, list(map(move, ring)))]
    segs = spark.createDataFrame([(i, 0, *map(float, move(a)), *map(float, move(b))) for i, (a, b) in enumerate(lines)], SEG)
    table = spark.createDataFrame(edges, EDGE)
    found = {(r.line_id, r.poly_id): r.length for r in polygons.clipped_lengths(polygons.clip_lines(segs, table), ["line_id", "poly_id"]).collect()}
    met = {tuple(r) for r in polygons.lines_meeting_polygons(segs, table).collect()}
    for i, line in enumerate(lines):
        for rings, n in shapes_:
            inside, meets = plain_clip([move(p) for p in line], [list(map(move, r)) for r in rings])
            assert found.get((i, n), 0) == pytest.approx(inside, abs=1e-6), (line, n)
            assert ((i, n) in met) == meets, (line, n)


def test_contact_is_not_a_matter_of_area(spark, donut):
    """A polygon that only just reaches the circle counts, so its missing estimate makes the density missing."""
    far = [(11608.9999, 0), (20000, 0), (20000, 10000), (11608.9999, 10000)]
    edges = donut.union(spark.createDataFrame(ring_rows(2, 0, far) + ring_rows(3, 0, [(x + 20, y) for x, y in far]), EDGE))
    at = shapes.locations(points(spark, [(10000, 5000)]))
    shares = {r.poly_id: r.shared for r in polygons.circle_shares(at, edges, 1609.0).collect()}
    assert set(shares) == {1, 2} and 0 <= shares[2] < 0.1
    for missing, expected in ((2, None), (3, pytest.approx(960 / (96e6 / 2.59e6), rel=1e-4))):
        counts = spark.createDataFrame([(i, None if i == missing else 960.0) for i in (1, 2, 3)], "poly_id int, estimate double")
        assert polygons.areal_density(at, edges, counts, 1609.0).first().density == expected


def test_containment_grows_with_points_and_edges(spark):
    """Ten times the points and edges of a polygon: ten times the joined pairs, told by the counted rows of the sweep."""
    def made(n):
        ring = [(9000 * (1 + 0.3 * (k % 2)) * math.cos(2 * math.pi * k / n), 9000 * (1 + 0.3 * (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        rng = random.Random(n)
        pts = [(rng.uniform(-12000, 12000), rng.uniform(-12000, 12000)) for _ in range(n)]
        return ring, pts

    for n in (40, 400):
        ring, pts = made(n)
        edges = spark.createDataFrame(ring_rows(1, 0, ring), EDGE)
        inside = {r.id for r in polygons.join_polygons(points(spark, pts), edges).collect()}
        odd = lambda x, y: sum((a[1] > y) != (b[1] > y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > x
                               for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1  # noqa: B023
        assert inside == {i for i, (x, y) in enumerate(pts) if odd(x, y)}
    plan = polygons._reference_parity(edges.selectExpr("poly_id", "1L AS cx", "2L AS cy"), edges, "poly_id", 2000.0)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
