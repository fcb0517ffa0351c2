"""Geometry operators and spatial plans."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from crosstie.catalog.registry import query
from crosstie.catalog.relations import AXES, ORDER_FIXES, ORDER_SQL
from crosstie.catalog.rows import assets
from crosstie.catalog.sqltext import (
    ASSETS, CORRIDOR_CASE, CORRIDORS, GROUP, HISTORY, OUT_CLASSES, PASSENGER, PEDESTRIAN, RAIL, SEG, SKIP_CORRIDOR, WINDOW_YEARS,
    device, in_list, point_segment_sq, segment_segment_sq, within,
)
from crosstie.geo import hexgrid, match, polygons, project, shapes
from crosstie.geo.measure import length
from crosstie.geo.project import TM_92W30
from crosstie.operators import joins
from crosstie.plans import assets as asset_plans
from crosstie.plans import grids, reports

RADIUS = 1609.0


def rail(t):
    return asset_plans.labelled_rail(t.segments, t.lines, CORRIDORS, OUT_CLASSES, PASSENGER)


def rounded(df, digits=4, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Points, projection, extents ------------------------------------------------

@query("SELECT crossing_id, lon, lat FROM fx_crossings WHERE lon IS NOT NULL AND lat IS NOT NULL")
def geo_points(t):
    return t.crossings.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("crossing_id", "lon", "lat")


def _forward_sql() -> str:
    g = TM_92W30
    e2 = g.e2
    ep2 = e2 / (1 - e2)
    c = g.meridian_terms()
    return f"""p AS (SELECT crossing_id, lon, lat, radians(lat) AS phi, radians(lon - {g.lon0!r}) AS dl FROM fx_crossings WHERE lon IS NOT NULL),
q AS (SELECT *, {g.a!r} / sqrt(1 - {e2!r}::DOUBLE * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t, {ep2!r}::DOUBLE * cos(phi) * cos(phi) AS c, cos(phi) * dl AS a,
 {g.a!r} * ({c[0]!r}::DOUBLE * phi + ({c[1]!r})::DOUBLE * sin(2 * phi) + {c[2]!r}::DOUBLE * sin(4 * phi) + ({c[3]!r})::DOUBLE * sin(6 * phi)) AS m FROM p),
xy AS (SELECT crossing_id, lon, lat, {g.false_easting!r} + {g.k0!r}::DOUBLE * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep2!r}::DOUBLE) * a ** 5 / 120) AS x,
 {g.k0!r}::DOUBLE * (m - {g.arc_at_origin()!r}::DOUBLE + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24
  + (61 - 58 * t + t * t + 600 * c - 330 * {ep2!r}::DOUBLE) * a ** 6 / 720)) AS y FROM q)"""


@query(f"WITH {_forward_sql()} SELECT crossing_id, ROUND(x, 3) AS x, ROUND(y, 3) AS y FROM xy")
def geo_project(t):
    x, y = project.project("lon", "lat")
    return rounded(t.crossings.where(F.col("lon").isNotNull()).select("crossing_id", x.alias("x"), y.alias("y")), 3, "x", "y")


@query("SELECT crossing_id, ROUND(lon, 7) AS lon, ROUND(lat, 7) AS lat FROM fx_crossings WHERE lon IS NOT NULL")
def geo_unproject(t):
    x, y = project.project("lon", "lat")
    lon, lat = project.unproject("x", "y")
    grid = t.crossings.where(F.col("lon").isNotNull()).select("crossing_id", x.alias("x"), y.alias("y"))
    return rounded(grid.select("crossing_id", lon.alias("lon"), lat.alias("lat")), 7, "lon", "lat")


@query("""SELECT crossing_id, x - 2640 AS xmin, y - 2640 AS ymin, x + 2640 AS xmax, y + 2640 AS ymax FROM fx_crossings""")
def geo_extent(t):
    return t.crossings.select("crossing_id", (F.col("x") - 2640).alias("xmin"), (F.col("y") - 2640).alias("ymin"),
                              (F.col("x") + 2640).alias("xmax"), (F.col("y") + 2640).alias("ymax"))


@query(f"""WITH {ASSETS}, h AS (SELECT pedestrian, warn_dev, COUNT(*) AS n FROM assets GROUP BY 1, 2)
SELECT a.crossing_id, a.warn_dev, h.n, a.x, a.y FROM assets a JOIN h ON a.warn_dev = h.warn_dev AND a.pedestrian IS NOT DISTINCT FROM h.pedestrian""")
def geo_drop(t):
    located = assets(t)
    attributes = located.drop("x", "y", "lon", "lat")
    counts = attributes.groupBy("pedestrian", "warn_dev").agg(F.count(F.lit(1)).alias("n"))
    counted = joins.spread_join(attributes, counts, ["pedestrian", "warn_dev"], "inner", row_key=["crossing_id"]).select("crossing_id", "warn_dev", "n")
    return joins.key_join(counted, located.select("crossing_id", "x", "y"), ["crossing_id"])


# Points and lines -----------------------------------------------------------

_NEAR = f"""{RAIL}, cand AS (SELECT p.crossing_id, s.line_id, s.rail_corridor, {point_segment_sq('p.x', 'p.y')} AS sq FROM fx_crossings p CROSS JOIN rail s)"""


@query(f"WITH {_NEAR} SELECT DISTINCT crossing_id FROM cand WHERE sq <= 2500")
def geo_within_line(t):
    return match.within_lines(t.crossings.select("crossing_id", "x", "y"), rail(t), 50.0).select("crossing_id")


@query(f"""WITH {_NEAR}, b AS (SELECT crossing_id, MIN(sq) AS sq FROM cand WHERE sq <= 6969600 GROUP BY 1)
SELECT c.crossing_id, MIN(c.line_id) AS line_id, ROUND(sqrt(b.sq), 4) AS dist FROM cand c JOIN b ON c.crossing_id = b.crossing_id AND c.sq = b.sq GROUP BY c.crossing_id, b.sq""")
def geo_nearest(t):
    near = match.nearest_line(t.crossings.select("crossing_id", "x", "y"), rail(t), 2640.0, ["line_id"], dist_out="dist")
    return rounded(near, 4, "dist").select("crossing_id", "line_id", "dist")


@query(f"WITH {_NEAR} SELECT DISTINCT crossing_id, line_id, rail_corridor FROM cand WHERE sq <= 9000000")
def geo_within_join(t):
    near = match.join_within(t.crossings.select("crossing_id", "x", "y"), rail(t), 3000.0, ["line_id", "rail_corridor"])
    return near.select("crossing_id", "line_id", "rail_corridor")


@query("""SELECT a.crossing_id, COUNT(*) AS n_near FROM fx_crossings a JOIN fx_crossings b
 ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1609.0 * 1609.0 GROUP BY 1""")
def geo_neighbors(t):
    return match.neighbour_counts(t.crossings.select("crossing_id", "x", "y"), RADIUS).select("crossing_id", "n_near")


@query(f"""WITH {SEG}, m AS (SELECT s.* FROM seg s JOIN fx_lines l USING (line_id) WHERE l.net IS NULL), o AS (SELECT * FROM seg)
SELECT DISTINCT o.line_id FROM o JOIN m ON {segment_segment_sq('o.', 'm.')} <= 3500.0 * 3500.0""")
def geo_line_near_line(t):
    main = joins.semi(t.segments, t.lines.where(F.col("net").isNull()), ["line_id"])
    return match.lines_near_lines(t.lines, t.segments, main, 3500.0).select("line_id")


@query(f"""WITH {RAIL}, o AS (SELECT DISTINCT rail_corridor, CASE WHEN x2 < x1 THEN x2 ELSE x1 END AS x1, CASE WHEN x2 < x1 THEN y2 ELSE y1 END AS y1,
 CASE WHEN x2 < x1 THEN x1 ELSE x2 END AS x2, CASE WHEN x2 < x1 THEN y1 ELSE y2 END AS y2 FROM rail)
SELECT rail_corridor, COUNT(*) AS n_segments, ROUND(SUM(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 3) AS length FROM o GROUP BY 1""")
def geo_dissolve(t):
    merged = shapes.dissolve(rail(t), ["rail_corridor"])
    return rounded(merged.groupBy("rail_corridor").agg(F.count(F.lit(1)).alias("n_segments"),
                                                       F.expr(f"sum({length()}) AS length")), 3, "length")


# Polygons -------------------------------------------------------------------

@query("""SELECT poly_id, ABS(SUM(x1 * y2 - x2 * y1) FILTER (WHERE ring = 0)) / 2 - ABS(SUM(x1 * y2 - x2 * y1) FILTER (WHERE ring = 1)) / 2 AS area
 FROM fx_edges GROUP BY 1""".replace("SELECT poly_id, ABS", "SELECT poly_id, ROUND(ABS").replace("/ 2 AS area", "/ 2, 1) AS area"))
def geo_area(t):
    return rounded(polygons.areas(t.edges), 1, "area")


@query(within("fx_crossings"))
def geo_pip_join(t):
    return polygons.join_polygons(t.crossings.select("crossing_id", "x", "y"), t.edges).select("crossing_id", "poly_id")


@query("""WITH g AS (SELECT * FROM fx_crossings WHERE corridor = 'Valley'),
held AS (""" + within("g") + ") SELECT poly_id, name FROM fx_blocks WHERE poly_id IN (SELECT poly_id FROM held)")
def geo_poly_has_point(t):
    chosen = t.crossings.where(F.col("corridor") == "Valley")
    return polygons.polygons_with_points(t.blocks, t.edges, chosen).select("poly_id", "name")


@query("""WITH g AS (SELECT * FROM fx_crossings WHERE corridor = 'Harbor'),
held AS (""" + within("g") + f"""), near AS (SELECT DISTINCT s.poly_id FROM g JOIN fx_edges s ON {point_segment_sq('g.x', 'g.y')} <= 1609.0 * 1609.0)
SELECT poly_id, name FROM fx_blocks WHERE poly_id IN (SELECT poly_id FROM held) OR poly_id IN (SELECT poly_id FROM near)""")
def geo_poly_near_point(t):
    chosen = t.crossings.where(F.col("corridor") == "Harbor")
    return polygons.polygons_near_points(t.blocks, t.edges, chosen, RADIUS).select("poly_id", "name")


_VERTEX_IN = """vin AS (SELECT v.line_id, e.poly_id FROM fx_vertices v JOIN fx_edges e ON ((e.y1 > v.y) <> (e.y2 > v.y))
 AND v.x < e.x1 + (v.y - e.y1) * (e.x2 - e.x1) / NULLIF(e.y2 - e.y1, 0) GROUP BY v.line_id, v.seq, e.poly_id HAVING COUNT(*) % 2 = 1)"""


@query(f"""WITH {SEG}, {_VERTEX_IN} SELECT line_id, poly_id FROM vin UNION
 SELECT s.line_id, e.poly_id FROM seg s JOIN fx_edges e ON {segment_segment_sq('s.', 'e.')} <= 1e-12""")
def geo_line_poly(t):
    return polygons.lines_meeting_polygons(t.segments, t.edges).select("line_id", "poly_id")


@query(f"""WITH {SEG}, e AS (SELECT * FROM fx_edges WHERE poly_id IN (SELECT poly_id FROM fx_blocks WHERE estimate IS NULL)),
vin AS (SELECT v.line_id FROM fx_vertices v JOIN e ON ((e.y1 > v.y) <> (e.y2 > v.y))
 AND v.x < e.x1 + (v.y - e.y1) * (e.x2 - e.x1) / NULLIF(e.y2 - e.y1, 0) GROUP BY v.line_id, v.seq, e.poly_id HAVING COUNT(*) % 2 = 1)
SELECT line_id FROM vin UNION SELECT s.line_id FROM seg s JOIN e ON {segment_segment_sq('s.', 'e.')} <= 9000.0 * 9000.0""")
def geo_line_near_poly(t):
    unknown = joins.semi(t.edges, t.blocks.where(F.col("estimate").isNull()), ["poly_id"])
    return polygons.lines_near_polygons(t.segments, unknown, 9000.0)


def _clip_sql(segments: str = SEG) -> str:
    """Cut at crossings, touched points and the ends of edges that the segment runs along; keep what is in or on the polygon."""
    dx, dy = "(s.x2 - s.x1)", "(s.y2 - s.y1)"
    off = [f"ABS({dx} * (e.{y} - s.y1) - {dy} * (e.{x} - s.x1)) <= 1e-6 * sqrt({dx} ** 2 + {dy} ** 2)" for x, y in (("x1", "y1"), ("x2", "y2"))]
    at = [f"((e.{x} - s.x1) * {dx} + (e.{y} - s.y1) * {dy}) / ({dx} ** 2 + {dy} ** 2)" for x, y in (("x1", "y1"), ("x2", "y2"))]
    return f"""{segments},
met AS (SELECT s.line_id, s.seq, e.poly_id, CASE WHEN {off[0]} AND {off[1]} THEN [{at[0]}, {at[1]}]
  ELSE [((e.x1 - s.x1) * (e.y2 - e.y1) - (e.y1 - s.y1) * (e.x2 - e.x1)) / ({dx} * (e.y2 - e.y1) - {dy} * (e.x2 - e.x1))] END AS ts
  FROM seg s JOIN fx_edges e ON {segment_segment_sq('s.', 'e.')} <= 1e-12),
cut AS (SELECT DISTINCT line_id, seq, poly_id, LEAST(GREATEST(t, 0), 1) AS t FROM (SELECT line_id, seq, poly_id, UNNEST(ts) AS t FROM met)),
box AS (SELECT poly_id, MIN(x1) AS xlo, MAX(x1) AS xhi, MIN(y1) AS ylo, MAX(y1) AS yhi FROM fx_edges GROUP BY 1),
stops AS (SELECT line_id, seq, poly_id, t FROM cut UNION
  SELECT s.line_id, s.seq, b.poly_id, u.t FROM seg s JOIN box b ON GREATEST(s.x1, s.x2) >= b.xlo AND LEAST(s.x1, s.x2) <= b.xhi
   AND GREATEST(s.y1, s.y2) >= b.ylo AND LEAST(s.y1, s.y2) <= b.yhi CROSS JOIN (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS u(t)),
spans AS (SELECT *, LEAD(t) OVER (PARTITION BY line_id, seq, poly_id ORDER BY t) AS t2 FROM stops),
mids AS (SELECT p.line_id, p.seq, p.poly_id, p.t, p.t2, s.x1 + {dx} * (p.t + p.t2) / 2 AS x, s.y1 + {dy} * (p.t + p.t2) / 2 AS y,
  sqrt({dx} ** 2 + {dy} ** 2) * (p.t2 - p.t) AS len FROM spans p JOIN seg s ON s.line_id = p.line_id AND s.seq = p.seq WHERE p.t2 > p.t),
kept AS (SELECT m.line_id, m.seq, m.poly_id, m.t, m.t2, m.len FROM mids m JOIN fx_edges e ON e.poly_id = m.poly_id GROUP BY ALL
  HAVING COUNT(*) FILTER (WHERE ((e.y1 > m.y) <> (e.y2 > m.y)) AND m.x < e.x1 + (m.y - e.y1) * (e.x2 - e.x1) / NULLIF(e.y2 - e.y1, 0)) % 2 = 1
   OR MIN({point_segment_sq('m.x', 'm.y', 'e.')}) <= 1e-12)"""


CLIP_SQL = _clip_sql()
SIDINGS = "seg AS (SELECT * FROM fx_sidings)"


@query(f"WITH {_clip_sql(SIDINGS)} SELECT line_id, poly_id, ROUND(SUM(len), 3) AS length FROM kept GROUP BY 1, 2 HAVING SUM(len) > 1e-3")
def geo_clip_along(t):
    """Lines along polygon sides and over their corners."""
    clipped = polygons.clipped_lengths(polygons.clip_lines(t.sidings, t.edges), ["line_id", "poly_id"])
    return rounded(clipped.where("length > 1e-3"), 3, "length")


@query(f"WITH {SIDINGS} SELECT DISTINCT s.line_id, e.poly_id FROM seg s JOIN fx_edges e ON {segment_segment_sq('s.', 'e.')} <= 1e-12")
def geo_line_poly_along(t):
    """Every siding meets the boundary of the polygons it meets at all."""
    return polygons.lines_meeting_polygons(t.sidings, t.edges).select("line_id", "poly_id")


@query(f"WITH {CLIP_SQL} SELECT line_id, poly_id, ROUND(SUM(len), 3) AS length FROM kept GROUP BY 1, 2")
def geo_clip(t):
    clipped = polygons.clip_lines(t.segments, t.edges)
    return rounded(polygons.clipped_lengths(clipped, ["line_id", "poly_id"]), 3, "length")


def _share_sql(r: str = "1609.0") -> str:
    """Circle-polygon areas by the per-edge closed form, over all pairs whose boxes meet."""
    return f"""ring AS (SELECT poly_id, ring, SUM(x1 * y2 - x2 * y1) / 2 AS ra FROM fx_edges GROUP BY 1, 2),
full_area AS (SELECT poly_id, SUM(CASE WHEN ring = 0 THEN ABS(ra) ELSE -ABS(ra) END) AS area FROM ring GROUP BY 1),
box AS (SELECT poly_id, MIN(x1) AS xlo, MAX(x1) AS xhi, MIN(y1) AS ylo, MAX(y1) AS yhi FROM fx_edges GROUP BY 1),
rel AS (SELECT p.crossing_id, e.poly_id, SIGN(g.ra) * CASE WHEN e.ring = 0 THEN 1.0 ELSE -1.0 END AS w,
  e.x1 - p.x AS ax, e.y1 - p.y AS ay, e.x2 - p.x AS bx, e.y2 - p.y AS b_y FROM fx_crossings p JOIN box b
  ON p.x BETWEEN b.xlo - {r} AND b.xhi + {r} AND p.y BETWEEN b.ylo - {r} AND b.yhi + {r}
  JOIN fx_edges e ON e.poly_id = b.poly_id JOIN ring g ON g.poly_id = e.poly_id AND g.ring = e.ring),
co AS (SELECT *, (bx - ax) ** 2 + (b_y - ay) ** 2 AS qa, ax * (bx - ax) + ay * (b_y - ay) AS qb, ax * ax + ay * ay - {r} * {r} AS qc FROM rel),
ro AS (SELECT *, sqrt(GREATEST(qb * qb - qa * qc, 0)) AS root FROM co),
ts AS (SELECT *, LEAST(GREATEST((-qb - root) / qa, 0), 1) AS t1, LEAST(GREATEST((-qb + root) / qa, 0), 1) AS t2 FROM ro),
pq AS (SELECT *, ax + t1 * (bx - ax) AS px, ay + t1 * (b_y - ay) AS py, ax + t2 * (bx - ax) AS qx, ay + t2 * (b_y - ay) AS qy FROM ts),
contacts AS (SELECT p.crossing_id, e.poly_id FROM fx_crossings p JOIN box b ON p.x BETWEEN b.xlo - {r} AND b.xhi + {r} AND p.y BETWEEN b.ylo - {r} AND b.yhi + {r}
  JOIN fx_edges e ON e.poly_id = b.poly_id GROUP BY 1, 2 HAVING MIN({point_segment_sq('p.x', 'p.y', 'e.')}) <= {r} * {r}
  OR COUNT(*) FILTER (WHERE ((e.y1 > p.y) <> (e.y2 > p.y)) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / NULLIF(e.y2 - e.y1, 0)) % 2 = 1),
overlap AS (SELECT crossing_id, poly_id, SUM(w * ({r} * {r} / 2 * atan2(ax * py - ay * px, ax * px + ay * py) + (px * qy - py * qx) / 2
  + {r} * {r} / 2 * atan2(qx * b_y - qy * bx, qx * bx + qy * b_y))) AS area FROM pq GROUP BY 1, 2),
shares AS (SELECT crossing_id, poly_id, GREATEST(area, 0) AS shared FROM overlap JOIN contacts USING (crossing_id, poly_id)),
density AS (SELECT s.crossing_id, CASE WHEN COUNT(b.estimate) = COUNT(*) THEN SUM(s.shared * b.estimate / f.area) END / NULLIF(SUM(s.shared) / 2.59e6, 0) AS density
 FROM shares s JOIN full_area f USING (poly_id) JOIN fx_blocks b USING (poly_id) GROUP BY 1)"""


@query(f"WITH {_share_sql()} SELECT crossing_id, ROUND(density / 7, 5) AS density FROM density")
def geo_density(t):
    density = polygons.areal_density(shapes.locations(t.crossings), t.edges, t.blocks, RADIUS)
    out = match.attach(t.crossings.select("crossing_id", "x", "y"), density)
    return out.select("crossing_id", F.round(F.col("density") / 7, 5).alias("density"))


_NEAR_COUNT = """near AS (SELECT a.crossing_id, COUNT(*) AS n_near FROM fx_crossings a JOIN fx_crossings b
 ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1609.0 * 1609.0 GROUP BY 1)"""


def _density(t):
    out = reports.asset_density(t.crossings.select("crossing_id", "street", "railroad", "x", "y"), t.edges, t.blocks, RADIUS)
    return out.withColumn("density", F.round(F.col("density") / 7, 5))


@query(f"WITH {_share_sql()}, {_NEAR_COUNT} SELECT n.crossing_id, n.n_near, ROUND(d.density / 7, 5) AS density FROM near n LEFT JOIN density d USING (crossing_id)")
def pipe_density(t):
    return _density(t).select("crossing_id", "n_near", "density")


@query(f"""WITH {_share_sql()}, {_NEAR_COUNT}, a AS (SELECT n.crossing_id, n.n_near, ROUND(d.density / 7, 5) AS density FROM near n LEFT JOIN density d USING (crossing_id)),
m AS (SELECT n_near, MIN(density) AS density FROM a GROUP BY 1 HAVING COUNT(density) = COUNT(*) AND NOT BOOL_OR(isnan(density)))
SELECT a.n_near, a.density, a.crossing_id, c.street FROM a JOIN m ON a.n_near = m.n_near AND a.density = m.density JOIN fx_crossings c ON c.crossing_id = a.crossing_id""")
def pipe_density_sparsest(t):
    return reports.sparsest_by_count(_density(t)).select("n_near", "density", "crossing_id", "street")


@query(f"""WITH {_share_sql()}, {_NEAR_COUNT}, a AS (SELECT c.railroad, n.n_near, n.crossing_id, ROUND(d.density / 7, 5) AS density
  FROM near n JOIN fx_crossings c USING (crossing_id) LEFT JOIN density d USING (crossing_id))
SELECT * FROM (SELECT *, MIN(density) OVER w AS low, COUNT(density) OVER w = COUNT(*) OVER w AS known FROM a WINDOW w AS (PARTITION BY railroad, n_near))
 WHERE known AND density = low""".replace("SELECT * FROM (SELECT *,", "SELECT railroad, n_near, crossing_id, density FROM (SELECT *,"))
def pipe_density_sparsest_railroad(t):
    """Sparsest assets of every railroad and neighbour count."""
    return reports.sparsest_by_count(_density(t), ["railroad"]).select("railroad", "n_near", "crossing_id", "density")


@query("WITH held AS (" + within("fx_crossings") + ") SELECT h.crossing_id, b.name FROM held h JOIN fx_blocks b USING (poly_id)")
def pipe_jurisdiction(t):
    out = reports.jurisdictions(t.crossings.select("crossing_id", "x", "y"), t.edges, t.blocks.select("poly_id", "name"))
    return out.select("crossing_id", "name")


# Hexagonal grids ------------------------------------------------------------

HEX_WIDTH = grids.CELL_WIDTH
HEX_REACH = grids.CORRIDOR_DISTANCE


def _hex_sql() -> str:
    w, d = HEX_WIDTH, HEX_REACH
    h, rad = w * math.sqrt(3.0) / 2.0, w / math.sqrt(3.0)
    turns = ", ".join(f"({i}, {math.cos(math.radians(60 * i - 30))!r}::DOUBLE, {math.sin(math.radians(60 * i - 30))!r}::DOUBLE, "
                      f"{math.cos(math.radians(60 * i + 30))!r}::DOUBLE, {math.sin(math.radians(60 * i + 30))!r}::DOUBLE)" for i in range(6))
    return f"""{RAIL}, r AS (SELECT * FROM rail WHERE rail_corridor IS NOT NULL),
org AS (SELECT rail_corridor, MIN(LEAST(x1, x2)) - {d} AS x0, MIN(LEAST(y1, y2)) - {d} AS y0, MAX(GREATEST(x1, x2)) + {d} AS xm, MAX(GREATEST(y1, y2)) + {d} AS ym FROM r GROUP BY 1),
cells AS (SELECT o.rail_corridor, rw.row, cl.cell, o.x0 + cl.cell * {w}::DOUBLE + CASE WHEN rw.row % 2 <> 0 THEN {w / 2}::DOUBLE ELSE 0 END AS hx, o.y0 + rw.row * {h!r}::DOUBLE AS hy
 FROM org o, UNNEST(range(-2, CAST((ym - y0) / {h!r} AS BIGINT) + 3)) AS rw(row), UNNEST(range(-2, CAST((xm - x0) / {w} AS BIGINT) + 3)) AS cl(cell)),
pairs AS (SELECT c.*, s.x1, s.y1, s.x2, s.y2 FROM cells c JOIN r s ON s.rail_corridor = c.rail_corridor
 WHERE GREATEST(s.x1, s.x2) >= c.hx - {d + rad} AND LEAST(s.x1, s.x2) <= c.hx + {d + rad} AND GREATEST(s.y1, s.y2) >= c.hy - {d + rad} AND LEAST(s.y1, s.y2) <= c.hy + {d + rad}),
outline AS (SELECT p.rail_corridor, p.row, p.cell, p.hx, p.hy, p.x1 AS s_x1, p.y1 AS s_y1, p.x2 AS s_x2, p.y2 AS s_y2,
 p.hx + {rad!r} * u.c1 AS e_x1, p.hy + {rad!r} * u.s1 AS e_y1, p.hx + {rad!r} * u.c2 AS e_x2, p.hy + {rad!r} * u.s2 AS e_y2 FROM pairs p CROSS JOIN (VALUES {turns}) AS u(i, c1, s1, c2, s2)),
gaps AS (SELECT rail_corridor, row, cell, hx, hy, s_x1, s_y1, s_x2, s_y2, MIN({segment_segment_sq('s_', 'e_')}) AS sq,
 BOOL_AND(({'(e_x2 - e_x1) * (s_y1 - e_y1) - (e_y2 - e_y1) * (s_x1 - e_x1)'}) >= 0) AS holds FROM outline GROUP BY ALL),
hexes AS (SELECT rail_corridor, row, cell, MIN(CASE WHEN holds THEN 0 ELSE sq END) AS sq FROM gaps GROUP BY ALL)"""


@query(f"WITH {_hex_sql()} SELECT rail_corridor, row, cell FROM hexes WHERE sq <= {HEX_REACH} * {HEX_REACH}")
def geo_hex_grid(t):
    lines = rail(t).where(F.col("rail_corridor").isNotNull())
    return hexgrid.hex_cells(lines, HEX_REACH, HEX_WIDTH, ["rail_corridor"]).select("rail_corridor", "row", "cell")


def _inside_sql() -> str:
    """Length of each line piece inside each cell: the piece cut by the six side lines."""
    w = HEX_WIDTH
    turns = ", ".join(f"({math.cos(math.radians(60 * i))!r}::DOUBLE, {math.sin(math.radians(60 * i))!r}::DOUBLE)" for i in range(6))
    return f"""half AS (SELECT p.rail_corridor, p.row, p.cell, p.x1, p.y1, p.x2, p.y2, u.nx * (p.x1 - p.hx) + u.ny * (p.y1 - p.hy) AS ahead, u.nx * (p.x2 - p.x1) + u.ny * (p.y2 - p.y1) AS slope
 FROM pairs p CROSS JOIN (VALUES {turns}) AS u(nx, ny)),
spans AS (SELECT rail_corridor, row, cell, x1, y1, x2, y2, GREATEST(0, MAX(CASE WHEN slope < 0 THEN ({w / 2} - ahead) / slope END)) AS t1,
 LEAST(1, MIN(CASE WHEN slope > 0 THEN ({w / 2} - ahead) / slope END)) AS t2, BOOL_OR(slope = 0 AND ahead > {w / 2}) AS outside FROM half GROUP BY ALL),
inner_len AS (SELECT rail_corridor, row, cell, SUM(CASE WHEN outside THEN 0 ELSE GREATEST(t2 - t1, 0) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) END) AS line_length FROM spans GROUP BY ALL)"""


HEX_CUT_SQL = (f"WITH {_hex_sql()}, {_inside_sql()} SELECT h.rail_corridor, h.row, h.cell, ROUND(i.line_length, 3) AS line_length, h.sq <= 400 AS is_cut "
               f"FROM hexes h JOIN inner_len i USING (rail_corridor, row, cell) WHERE h.sq <= {HEX_REACH} * {HEX_REACH}")


@query(HEX_CUT_SQL)
def geo_hex_cut(t):
    lines = rail(t).where(F.col("rail_corridor").isNotNull())
    cells = hexgrid.hex_cells(lines, HEX_REACH, HEX_WIDTH, ["rail_corridor"])
    cut = hexgrid.mark_cut_cells(cells, lines, 20.0, HEX_REACH, HEX_WIDTH, ["rail_corridor"])
    return rounded(cut, 3, "line_length").select("rail_corridor", "row", "cell", "line_length", "is_cut")


@query(HEX_CUT_SQL.replace("SELECT h.rail_corridor, h.row, h.cell, ROUND(i.line_length, 3) AS line_length,",
                           "SELECT h.rail_corridor, CAST(h.row AS STRING) || '_' || CAST(h.cell AS STRING) AS id, CAST(h.row AS STRING) || '_' || CAST(h.cell AS STRING) AS name, 0 AS is_pass,"))
def pipe_grid(t):
    return grids.analysis_grid(rail(t)).select("rail_corridor", "id", "name", "is_pass", "is_cut")


# Spatial plans --------------------------------------------------------------

def _nearest_sql(points: str, d: float) -> str:
    return f"""cand AS (SELECT p.crossing_id, s.line_id, s.rail_corridor, {point_segment_sq('p.x', 'p.y')} AS sq FROM (SELECT DISTINCT crossing_id, x, y FROM {points}) p CROSS JOIN rail s),
best AS (SELECT crossing_id, arg_min(rail_corridor, struct_pack(sq := sq, line_id := line_id)) AS rc, arg_min(line_id, struct_pack(sq := sq, line_id := line_id)) AS rl FROM cand WHERE sq <= {d * d} GROUP BY 1),
near AS (SELECT b.crossing_id, r.rail_corridor FROM best b JOIN (SELECT DISTINCT line_id, rail_corridor FROM rail) r ON r.line_id = b.rl)"""


BASE_SQL = f"""{RAIL}, {HISTORY},
placed AS (SELECT c.* EXCLUDE (lon, lat, corridor), {device('c.')} AS warn_dev, COALESCE(c.lat, s.lat_survey) AS lat, COALESCE(c.lon, s.lon_survey) AS lon, s.grade1, s.grade2, s.road AS survey_road
 FROM fx_crossings c LEFT JOIN fx_survey s ON c.crossing_id = s.crossing_id WHERE c.reason_id <> 16 AND c.pos_xing = 1 AND c.type_xing = 3),
located AS (SELECT * FROM placed WHERE lat IS NOT NULL AND lon IS NOT NULL),
{_nearest_sql('located', 50.0)},
base AS (SELECT l.*, n.rail_corridor, {PEDESTRIAN} AS pedestrian, h.* EXCLUDE (crossing_id) FROM located l JOIN near n ON n.crossing_id = l.crossing_id
 LEFT JOIN history h ON h.crossing_id = l.crossing_id WHERE n.rail_corridor <> '{SKIP_CORRIDOR}'
 AND NOT EXISTS (SELECT 1 FROM fx_sheet x WHERE x.notes = 'Exclude' AND x.crossing_id = l.crossing_id))"""


def base_table(t):
    exclusions = t.sheet.where(F.col("notes") == "Exclude").select("crossing_id")
    return asset_plans.crossing_base(t.crossings.drop("corridor"), t.incidents, t.survey, rail(t), WINDOW_YEARS,
                                     exclusions, SKIP_CORRIDOR)


_BASE_COLUMNS = ["crossing_id", "rail_corridor", "warn_dev", "pedestrian", "lon", "lat", "grade1", "survey_road",
                 "inc_tot_all", "inc_fat_all", "inc_inj_all", "inc_tot_win", "inc_fat_win", "inc_inj_win"]


@query(f"WITH {BASE_SQL} SELECT {', '.join(_BASE_COLUMNS)} FROM base")
def pipe_base(t):
    return base_table(t).select(*_BASE_COLUMNS)


@query(f"WITH {BASE_SQL} SELECT rail_corridor, {GROUP} AS device_group, COUNT(*) AS n FROM base GROUP BY 1, 2")
def pipe_base_breakdown(t):
    out = asset_plans.corridor_breakdown(base_table(t)).withColumnRenamed("corridor", "rail_corridor")
    return out.select("rail_corridor", "device_group", "n")


@query(f"""WITH {RAIL}, located AS (SELECT * FROM fx_crossings WHERE pos_xing IN (2, 3) AND lat IS NOT NULL AND lon IS NOT NULL), {_nearest_sql('located', 100.0)}
SELECT l.crossing_id, CASE WHEN l.pos_xing = 2 THEN 'RR Under' ELSE 'RR Over' END AS position, n.rail_corridor FROM located l JOIN near n ON n.crossing_id = l.crossing_id WHERE n.rail_corridor <> 'Harbor'""")
def pipe_gradesep(t):
    out = asset_plans.grade_separations(t.crossings.drop("corridor"), rail(t), SKIP_CORRIDOR)
    return out.select("crossing_id", "position", "rail_corridor")


@query(f"""WITH {RAIL}, cand AS (SELECT p.crossing_id, {PEDESTRIAN.replace('purpose', 'p.purpose')} AS pedestrian, s.line_id, s.rail_corridor, {point_segment_sq('p.x', 'p.y')} AS sq
 FROM fx_crossings p CROSS JOIN rail s WHERE p.type_xing = 2 AND p.lat IS NOT NULL AND p.lon IS NOT NULL)
SELECT DISTINCT crossing_id, line_id, rail_corridor, pedestrian FROM cand WHERE sq <= 400 AND rail_corridor <> 'Harbor'""")
def pipe_private(t):
    out = asset_plans.private_crossings(t.crossings.drop("corridor"), rail(t), SKIP_CORRIDOR)
    return out.select("crossing_id", "line_id", "rail_corridor", "pedestrian")


@query(f"""WITH {ASSETS}, {ORDER_SQL} SELECT corridor, "order", crossing_id, warn_dev, corridor || '_' || CAST("order" AS STRING) || '_' || CAST(crossing_id AS STRING) AS name FROM w""")
def pipe_worksheet(t):
    return asset_plans.corridor_worksheet(assets(t), AXES, ORDER_FIXES).select("corridor", "order", "crossing_id", "warn_dev", "name")


@query(f"""WITH {CLIP_SQL} SELECT k.line_id, l.net, {CORRIDOR_CASE} AS rail_corridor, k.poly_id, ROUND(SUM(k.len), 3) AS length FROM kept k JOIN fx_lines l ON l.line_id = k.line_id
 WHERE (l.net IS NULL OR l.net NOT IN {in_list(OUT_CLASSES)}) AND l.passenger = '{PASSENGER}' GROUP BY 1, 2, 3, 4""")
def pipe_rail(t):
    clipped = asset_plans.rail_network(t.segments, t.lines, t.edges, CORRIDORS, PASSENGER)
    return rounded(polygons.clipped_lengths(clipped, ["line_id", "net", "rail_corridor", "poly_id"]), 3, "length")


@query(f"""WITH {SEG}, {_VERTEX_IN}, m AS (SELECT line_id FROM vin UNION SELECT s.line_id FROM seg s JOIN fx_edges e ON {segment_segment_sq('s.', 'e.')} <= 100000.0 * 100000.0)
SELECT COUNT(*) AS n_segments, ROUND(SUM(sqrt((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2)), 3) AS length FROM seg s JOIN fx_lines l USING (line_id)
 WHERE (l.net IS NULL OR l.net NOT IN {in_list(OUT_CLASSES)}) AND s.line_id IN (SELECT line_id FROM m)""")
def pipe_rail_context(t):
    merged = asset_plans.context_network(t.segments, t.lines, t.edges)
    return rounded(merged.agg(F.count(F.lit(1)).alias("n_segments"), F.expr(f"sum({length()}) AS length")), 3, "length")


@query(f"""WITH {RAIL}, main AS (SELECT * FROM rail WHERE rail_corridor = 'Valley'),
near_lines AS (SELECT DISTINCT o.line_id FROM seg o JOIN main m ON {segment_segment_sq('o.', 'm.')} <= 2640.0 * 2640.0),
near_points AS (SELECT DISTINCT p.crossing_id FROM fx_crossings p JOIN main s ON {point_segment_sq('p.x', 'p.y')} <= 2640.0 * 2640.0)
SELECT 'line' AS kind, line_id AS id FROM near_lines UNION ALL SELECT 'asset', crossing_id FROM near_points""")
def pipe_context(t):
    main = rail(t).where(F.col("rail_corridor") == "Valley")
    lines, points = asset_plans.proximity_context(main, t.segments, t.lines, t.crossings.select("crossing_id", "x", "y"))
    return lines.select(F.lit("line").alias("kind"), F.col("line_id").alias("id")).union(
        points.select(F.lit("asset").alias("kind"), F.col("crossing_id").alias("id")))


@query("""WITH g AS (SELECT * FROM fx_crossings WHERE corridor = 'Ridge'), held AS (""" + within("g")
       + ") SELECT poly_id, name FROM fx_blocks WHERE poly_id IN (SELECT poly_id FROM held)")
def pipe_counties(t):
    chosen = t.crossings.where(F.col("corridor") == "Ridge")
    return grids.corridor_polygons(t.blocks, t.edges, chosen).select("poly_id", "name")


@query(f"""WITH {ASSETS} SELECT CASE WHEN pedestrian = 'Yes' THEN 'Pedestrian' WHEN warn_dev IN ('Not Classified', 'StopSign', 'YieldSign', 'Crossbucks') THEN 'passive' ELSE 'active' END AS passive_cat,
 COUNT(*) AS n FROM assets GROUP BY 1""")
def pipe_passive_layer(t):
    return reports.passive_layer(assets(t)).groupBy("passive_cat").agg(F.count(F.lit(1)).alias("n"))
