"""Polygons as edge tables: containment, area, clipping and areal shares.

An edge table has the shape key, ``ring`` (0 is the outer ring, higher numbers are
holes), optionally ``part``, ``seq`` and the edge ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstie.functions.measures import SQUARE_METRES_PER_SQUARE_MILE
from crosstie.functions.nulls import ratio, strict_sum
from crosstie.geo.match import attach, cell_join, segments_within
from crosstie.geo.measure import (
    ENDS, REFERENCE_ANGLE, circle_edge_steps, clamp01, length, num, point_segment_sq, ring_term, segment_segment_sq, side,
)
from crosstie.geo.shapes import (
    CELL, boxes, cell_of, cell_size, cover_box, cover_segments, cut_to_length, locations, with_cell,
)
from crosstie.operators.joins import HOT_ROWS, key_join

POLYGON_CELL = 2000.0
TOUCH = 1e-6  # metres within which a point counts as lying on an edge


_EDGE = tuple(f"e_{c}" for c in ENDS)


# Place of a cell's reference position inside the cell; odd fractions keep it off regular edges.
_REF_X, _REF_Y = 0.4871, 0.5137


def _right_of(x: str, y: str) -> str:
    """Whether an edge crosses the horizontal ray from (x, y) to the right."""
    return f"((e_y1 > {y}) != (e_y2 > {y})) AND e_x1 + try_divide(({y} - e_y1) * (e_x2 - e_x1), e_y2 - e_y1) > {x}"


def _above(x: str, y: str) -> str:
    """Whether an edge crosses the vertical ray from (x, y) upwards."""
    return f"((e_x1 > {x}) != (e_x2 > {x})) AND e_y1 + try_divide(({x} - e_x1) * (e_y2 - e_y1), e_x2 - e_x1) > {y}"


def _reference_parity(cells: DataFrame, edges: DataFrame, poly: str, size: float) -> DataFrame:
    """For each (polygon, cell) the number of edges right of the cell's reference position.

    A sweep along the rows of cells. An edge crosses the reference line of a row once at
    most; the crossings are counted by column, and the count right of a cell is the running
    total of the columns behind it plus the crossings in its own column beyond its reference
    position. So an edge gives one row per row of cells it crosses, whatever the number of
    cells, and what is put in order has a polygon's columns at most.
    """
    ry = f"(cy + {num(_REF_Y)}) * {num(size)}"
    crossed = (edges.selectExpr(poly, *[f"{c} AS e_{c}" for c in ENDS],
                                f"explode(sequence({cell_of('least(y1, y2)', size)}, {cell_of('greatest(y1, y2)', size)})) AS cy")
               .selectExpr("*", f"{ry} AS ry").where("(e_y1 > ry) != (e_y2 > ry)")
               .selectExpr(poly, "cy", "e_x1 + try_divide((ry - e_y1) * (e_x2 - e_x1), e_y2 - e_y1) AS px")
               .selectExpr(poly, f"{cell_of('px', size)} AS cx", "cy", f"px > (floor(px / {num(size)}) + {num(_REF_X)}) * {num(size)} AS beyond")
               .groupBy(poly, *CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if("beyond").alias("n_own")))
    columns = crossed.selectExpr("*", "false AS wanted").union(cells.selectExpr(poly, *CELL, "0L AS n", "0L AS n_own", "true AS wanted"))
    columns = columns.groupBy(poly, *CELL).agg(F.sum("n").alias("n"), F.sum("n_own").alias("n_own"), F.bool_or("wanted").alias("wanted"))
    behind = Window.partitionBy(poly, "cy").orderBy(F.desc("cx")).rowsBetween(Window.unboundedPreceding, -1)
    swept = columns.withColumn("n_ref", F.col("n_own") + F.coalesce(F.sum("n").over(behind), F.lit(0))).where("wanted")
    return swept.selectExpr(poly, *CELL, f"(cx + {num(_REF_X)}) * {num(size)} AS rx", f"{ry} AS ry", "n_ref")


def _inside(cand: DataFrame, edges: DataFrame, poly: str, size: float) -> DataFrame:
    """Rows of ``cand`` (``x, y``, the polygon key, any others) whose position is in or on the polygon.

    Each grid cell has a reference position of known parity. A position is joined to it by
    a horizontal and a vertical step inside the cell and meets only the edges of its own
    cell; every edge crossed flips the parity. Holes need no special case, and positions
    in cells without edges meet none.
    """
    placed = with_cell(cand, size)
    keys = [poly, *CELL]
    refs = _reference_parity(placed.select(*keys).distinct(), edges, poly, size)
    near = cover_segments(edges.select(poly, *ENDS), size, TOUCH).withColumnsRenamed(dict(zip(ENDS, _EDGE)))
    met = placed.join(refs, keys).join(near, keys, "left")
    across = f"(({_right_of('x', 'y')}) != ({_right_of('rx', 'y')}))"
    up = f"(({_above('rx', 'y')}) != ({_above('rx', 'ry')}))"
    touches = f"{point_segment_sq('x', 'y', _EDGE)} <= {num(TOUCH * TOUCH)}"
    return (met.groupBy(*cand.columns, "n_ref")
            .agg(F.expr(f"count_if({across}) + count_if({up}) AS _c"), F.expr(f"bool_or({touches}) AS _t"))
            .where("(_c + n_ref) % 2 = 1 OR _t").select(*cand.columns))


def locate(locs: DataFrame, edges: DataFrame, poly: str = "poly_id", size: float = POLYGON_CELL) -> DataFrame:
    """``(x, y, poly)`` for every position in or on a polygon.

    Candidates come from the grid cells of the polygons' bounding boxes.
    """
    box = cover_box(boxes(edges, [poly]), "xlo", "ylo", "xhi", "yhi", size)
    cand = cell_join(with_cell(locs.select("x", "y"), size), box, "x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi")
    return _inside(cand.select("x", "y", poly), edges, poly, size)


def join_polygons(points: DataFrame, edges: DataFrame, poly: str = "poly_id", x: str = "x", y: str = "y",
                  size: float = POLYGON_CELL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per (point row, polygon holding it)."""
    return attach(points, locate(locations(points, x, y), edges, poly, size), x, y, "inner", hot_rows)


def polygons_with_points(polygons: DataFrame, edges: DataFrame, points: DataFrame, poly: str = "poly_id",
                         size: float = POLYGON_CELL) -> DataFrame:
    held = locate(locations(points), edges, poly, size).select(poly).distinct()
    return key_join(polygons, held, [poly], "left_semi")


def polygons_near_points(polygons: DataFrame, edges: DataFrame, points: DataFrame, distance: float,
                         poly: str = "poly_id", size: float = POLYGON_CELL) -> DataFrame:
    """Polygons holding a point or having one within ``distance`` of an edge."""
    locs = locations(points)
    dots = locs.selectExpr("x AS x1", "y AS y1", "x AS x2", "y AS y2")
    near = segments_within(edges, [poly], dots, distance)
    hit = near.union(locate(locs, edges, poly, size).select(poly)).distinct()
    return key_join(polygons, hit, [poly], "left_semi")


def _ring_keys(edges: DataFrame, poly: str) -> list[str]:
    return [poly, *(["part"] if "part" in edges.columns else []), "ring"]


def ring_areas(edges: DataFrame, poly: str = "poly_id") -> DataFrame:
    """Signed shoelace area per ring."""
    return edges.groupBy(*_ring_keys(edges, poly)).agg(F.expr(f"sum({ring_term()}) / 2 AS ring_area"))


def areas(edges: DataFrame, poly: str = "poly_id") -> DataFrame:
    """Polygon area: outer rings minus holes, whatever the drawing direction."""
    return ring_areas(edges, poly).groupBy(poly).agg(
        F.expr("sum(IF(ring = 0, abs(ring_area), -abs(ring_area))) AS area"))


def _oriented(edges: DataFrame, poly: str) -> DataFrame:
    """Edges with weight +1/-1 that makes outer rings count positive and holes negative."""
    keys = _ring_keys(edges, poly)
    weights = ring_areas(edges, poly).selectExpr(*keys, "signum(ring_area) * IF(ring = 0, 1D, -1D) AS _w")
    return edges.join(weights, keys)


def circle_shares(locs: DataFrame, edges: DataFrame, radius: float, poly: str = "poly_id",
                  size: float = POLYGON_CELL) -> DataFrame:
    """``(x, y, poly, shared)``: exact area each polygon shares with the circle around a position.

    A position meets only the edges that reach its circle; whether the circle's reference
    point lies in the polygon settles the rest. Either makes contact, whatever the area: a
    polygon that only just reaches the circle is listed, with a share of zero or next to it.
    """
    grid = cell_size(radius)
    r = float(radius)
    near = cover_segments(_oriented(edges, poly).select(poly, "_w", *ENDS), grid, r)
    met = cell_join(with_cell(locs.select("x", "y"), grid), near, f"{point_segment_sq('x', 'y')} <= {num(r * r)}")
    steps, area = circle_edge_steps("x", "y", r)
    for step in steps:
        met = met.selectExpr("*", *[f"{e} AS {name}" for name, e in step.items()])
    by_edges = met.selectExpr("x", "y", poly, f"_w * {area} AS shared")
    rim = locs.selectExpr("x AS px", "y AS py", f"x + {num(r * math.cos(REFERENCE_ANGLE))} AS x",
                          f"y + {num(r * math.sin(REFERENCE_ANGLE))} AS y")
    held = rim.join(locate(locations(rim), edges, poly, size), ["x", "y"])
    full = held.selectExpr("px AS x", "py AS y", poly, f"{num(math.pi * r * r)} AS shared")
    return by_edges.union(full).groupBy("x", "y", poly).agg(F.greatest(F.sum("shared"), F.lit(0.0)).alias("shared"))


def areal_density(locs: DataFrame, edges: DataFrame, counts: DataFrame, radius: float, estimate: str = "estimate",
                  out: str = "density", poly: str = "poly_id") -> DataFrame:
    """Density per square mile in the circle around each position.

    Each polygon gives its count in proportion to the shared area; positions that
    meet no polygon are absent.
    """
    base = key_join(areas(edges, poly), counts.select(poly, estimate), [poly], "inner")
    shares = key_join(circle_shares(locs, edges, radius, poly), base, [poly], "inner")
    people = ratio(F.col("shared") * F.col(estimate), "area")
    return shares.groupBy("x", "y").agg(
        ratio(strict_sum(people), F.sum("shared") / F.lit(SQUARE_METRES_PER_SQUARE_MILE)).alias(out))


def _covered_edges(edges: DataFrame, poly: str, size: float) -> DataFrame:
    covered = cover_segments(edges.select(poly, *ENDS), size, TOUCH)
    return covered.withColumnsRenamed({c: f"e_{c}" for c in ENDS})


def _vertices(segments: DataFrame, line: str) -> DataFrame:
    return segments.selectExpr(line, "inline(array(struct(x1 AS x, y1 AS y), struct(x2 AS x, y2 AS y)))")


_MEETS = f"{segment_segment_sq(ENDS, _EDGE)} <= {num(TOUCH * TOUCH)}"


def lines_meeting_polygons(segments: DataFrame, edges: DataFrame, line: str = "line_id", poly: str = "poly_id",
                           size: float = POLYGON_CELL) -> DataFrame:
    """``(line, poly)`` pairs that intersect; a touched corner or a stretch along the boundary counts.

    A pair meets when a segment meets an edge, or when a vertex lies inside: a line that
    meets no edge is inside or outside as a whole.
    """
    segs = segments.select(line, *ENDS)
    by_edge = cell_join(cover_segments(segs, size), _covered_edges(edges, poly, size), _MEETS)
    starts = _vertices(segs, line)
    by_vertex = starts.join(locate(locations(starts), edges, poly, size), ["x", "y"])
    return by_edge.select(line, poly).union(by_vertex.select(line, poly)).distinct()


def lines_near_polygons(segments: DataFrame, edges: DataFrame, distance: float, line: str = "line_id",
                        poly: str = "poly_id", size: float = POLYGON_CELL) -> DataFrame:
    """Distinct lines that come within ``distance`` of any polygon or lie inside one."""
    near = segments_within(segments, [line], edges, distance)
    starts = key_join(_vertices(segments, line), near, [line], "left_anti")
    inner = starts.join(locate(locations(starts), edges, poly, size), ["x", "y"], "left_semi").select(line)
    return near.union(inner.distinct())


def clip_lines(segments: DataFrame, edges: DataFrame, keys: Sequence[str] = ("line_id", "seq"),
               poly: str = "poly_id", size: float = POLYGON_CELL) -> DataFrame:
    """Parts of the segments inside each polygon, as ``keys, piece, poly, x1..y2``.

    Polygons hold their boundary. Segments are cut to cell length first, so one piece meets
    few edges and its cuts by one polygon fit in one array. A piece that meets edges is cut
    where it crosses or touches them, and at both ends of an edge it runs along; of its parts
    those whose midpoint is in or on the polygon are kept. A piece that meets no edge of a
    polygon is kept or dropped as a whole.
    """
    pieces = cut_to_length(segments.select(*keys, *ENDS), size)
    ids = [*keys, "piece"]
    dx, dy, ex, ey = "(x2 - x1)", "(y2 - y1)", "(e_x2 - e_x1)", "(e_y2 - e_y1)"
    t = f"try_divide((e_x1 - x1) * {ey} - (e_y1 - y1) * {ex}, {dx} * {ey} - {dy} * {ex})"
    ends = [f"try_divide(({x} - x1) * {dx} + ({y} - y1) * {dy}, power({dx}, 2) + power({dy}, 2))" for x, y in (_EDGE[:2], _EDGE[2:])]
    along = " AND ".join(f"abs({side(ENDS, x, y)}) <= {num(TOUCH)} * {length()}" for x, y in (_EDGE[:2], _EDGE[2:]))
    stops = f"IF({along}, array({', '.join(clamp01(e) for e in ends)}), array({clamp01(t)}))"
    cuts = (cell_join(cover_segments(pieces, size), _covered_edges(edges, poly, size), _MEETS)
            .groupBy(*ids, poly, *ENDS).agg(F.expr(f"array_compact(array_distinct(flatten(collect_set({stops})))) AS ts")))
    spans = (cuts.withColumn("ts", F.expr("array_sort(array_union(ts, array(0D, 1D)))"))
             .selectExpr(*ids, poly, *ENDS, "inline(arrays_zip(slice(ts, 1, size(ts) - 1), slice(ts, 2, size(ts) - 1))) AS (a, b)")
             .where("b > a")
             .selectExpr(*ids, poly, f"x1 + {dx} * a AS x1", f"y1 + {dy} * a AS y1", f"x1 + {dx} * b AS x2", f"y1 + {dy} * b AS y2"))
    middle = ("(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y")
    kept_cut = _inside(spans.selectExpr("*", *middle), edges, poly, size)
    whole = pieces.selectExpr("*", *middle)
    held = whole.join(locate(locations(whole), edges, poly, size), ["x", "y"])
    kept_whole = held.join(cuts.select(*ids, poly), [*ids, poly], "left_anti")
    columns = [*ids, poly, *ENDS]
    return kept_cut.select(*columns).unionByName(kept_whole.select(*columns))


def clipped_lengths(clipped: DataFrame, keys: Sequence[str]) -> DataFrame:
    return clipped.groupBy(*keys).agg(F.expr(f"sum({length()}) AS length"))
