"""Study-shaped views over the general test tables.

One text serves both engines: ``{table}`` names a source table and ``{ring_edges}``
the constant list of polygon edges, the only place where the dialects differ. The
plane grows with the tables (2,000 assets, 25 lines and 100 polygons per 100 km of
``y``), so densities stay the same at every scale factor.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Outer ring of a sheared 10 km cell and a 2 km square hole: (ring, seq, dx1, dy1, dx2, dy2).
RING_EDGES = [
    (0, 0, 0, 0, 10000, 1500), (0, 1, 10000, 1500, 10000, 11500),
    (0, 2, 10000, 11500, 0, 10000), (0, 3, 0, 10000, 0, 0),
    (1, 0, 4000, 4500, 4000, 6500), (1, 1, 4000, 6500, 6000, 6500),
    (1, 2, 6000, 6500, 6000, 4500), (1, 3, 6000, 4500, 4000, 4500),
]

# Lines from a cell's corner: along a shared side, along and across the hole, onto a corner (dx1, dy1, dx2, dy2).
SIDINGS = [(0, 2000, 0, 12000), (3000, 4500, 7000, 4500), (3000, 5500, 7000, 5500), (-500, 0, 0, 0)]

VIEWS = {
    "fx_crossings": """
SELECT p_partkey AS crossing_id, p_name AS street,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 < 2 THEN 'Valley' WHEN p_partkey % 5 < 4 THEN 'Ridge' ELSE 'Harbor' END AS corridor,
  CASE WHEN p_partkey % 17 = 0 THEN '3' ELSE '1' END AS gate_conf,
  CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'NR' WHEN p_partkey % 2 = 0 THEN '2' ELSE '0' END AS gates,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 6 AS STRING) END AS channel,
  CASE WHEN p_size % 3 = 0 THEN '1' ELSE '0' END AS flash, CASE WHEN p_size % 5 = 0 THEN '1' ELSE '0' END AS stop_std,
  CASE WHEN p_size % 7 = 0 THEN '1' ELSE '0' END AS yield_std, CASE WHEN p_size % 2 = 0 THEN '2' ELSE '0' END AS xbuck,
  CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN 2 ELSE 1 END AS purpose,
  CAST(1 + p_size % 3 AS INT) AS pos_xing, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END AS type_xing,
  CASE WHEN p_partkey % 41 = 0 THEN 16 WHEN p_partkey % 43 = 0 THEN NULL ELSE 14 END AS reason_id,
  CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'QUARRY IND-LD' ELSE 'north BELT' END AS subdiv_name,
  CAST(1 + p_size % 2 AS INT) AS main_trk, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_size % 3 AS INT) END AS siding_trk,
  CAST(p_partkey % 3 AS INT) AS industry_trk, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE 0 END AS transit_trk, CASE WHEN p_partkey % 8 = 1 THEN 1 ELSE 0 END AS yard_trk,
  CAST(p_partkey AS DOUBLE) / 8 AS milepost, p_brand AS railroad, CAST(20 + p_size AS INT) AS max_speed, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(25 + p_partkey % 4 * 10 AS INT) END AS hwy_speed,
  CAST(p_size AS INT) AS pass_cnt,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(-94.0 + ((p_partkey * 37) % 1000) * 0.004 AS DOUBLE) END AS lon,
  CAST(37.0 + ((p_partkey * 91) % 1000) * 0.003 AS DOUBLE) AS lat,
  CAST((p_partkey * 7919) % 10007 AS DOUBLE) * 10 AS x,
  CAST((p_partkey - p_partkey % 2000) * 50 AS DOUBLE)
  + CASE WHEN p_partkey % 2 = 0 THEN CAST(((p_partkey * 104729) % 25) * 4000 + (p_partkey * 31) % 1100 AS DOUBLE)
       ELSE CAST((p_partkey * 104729) % 10007 AS DOUBLE) * 10 END AS y
FROM {part}""",
    "fx_incidents": """
SELECT l_partkey AS crossing_id, lpad(CAST(year(l_shipdate) % 100 AS STRING), 2, '0') AS iyr,
  CASE WHEN l_quantity > 48 THEN '1' WHEN l_linenumber = 7 THEN NULL ELSE '0' END AS killed,
  CASE WHEN l_quantity > 40 THEN '1' ELSE '0' END AS injured,
  substr('ABCDEJKMZ', CAST(1 + l_suppkey % 9 AS INT), 1) AS veh_code,
  CAST(1 + l_suppkey % 6 AS STRING) AS pos_code, CAST(1 + l_partkey % 8 AS STRING) AS mot_code,
  CAST(month(l_shipdate) AS STRING) AS imo, CAST(day(l_shipdate) AS STRING) AS iday,
  CAST(1 + l_suppkey % 12 AS STRING) AS hr, CASE WHEN l_returnflag = 'R' THEN 'PM' ELSE 'AM' END AS ampm,
  CAST(l_linenumber * 7 AS STRING) AS mi,
  CASE WHEN l_linestatus = 'O' THEN 'VEHICLE ON NARROW ROAD' END AS narr1, CASE WHEN l_returnflag <> 'N' THEN 'STRUCK' END AS narr2,
  CASE WHEN l_linenumber < 3 THEN 'AT GATE' END AS narr3, CASE WHEN l_linenumber > 5 THEN 'NAMED WITNESS' END AS narr4, CASE WHEN l_suppkey % 5 = 0 THEN 'FOG' END AS narr5
FROM {lineitem}""",
    "fx_survey": """
SELECT s_suppkey * 3 AS crossing_id, s_name AS road, s_acctbal AS aadt, CAST(s_suppkey % 7 AS DOUBLE) AS grade1,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 5 AS DOUBLE) END AS grade2, CAST(38.5 AS DOUBLE) AS lat_survey, CAST(-92.0 AS DOUBLE) AS lon_survey FROM {supplier}
UNION ALL
SELECT s_suppkey * 6, s_name, s_acctbal, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(38.5 AS DOUBLE), CAST(-92.0 AS DOUBLE) FROM {supplier}""",
    "fx_sheet": """
SELECT p_partkey AS crossing_id,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 < 3 THEN 'Valley' ELSE 'Ridge' END AS corridor,
  CASE WHEN p_partkey % 10 = 0 THEN 'Pedestrian' WHEN p_partkey % 10 = 1 THEN 'Exclude' WHEN p_partkey % 10 = 2 THEN 'checked' END AS notes,
  CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_brand END AS railroad,
  CASE p_partkey % 7 WHEN 0 THEN 'Gates' WHEN 1 THEN 'FlashingOnly' WHEN 2 THEN 'Crossbucks' WHEN 3 THEN 'GatesWithMedian' WHEN 4 THEN 'StopSign' WHEN 5 THEN 'FourQuad' END AS warn_dev,
  CASE p_type WHEN 'STANDARD' THEN 'Closure' WHEN 'SMALL' THEN 'Gates; AFWS' WHEN 'LARGE' THEN 'Grade Separation'
    WHEN 'PROMO' THEN 'Lighting; AFWS; Security Gates' WHEN 'ECONOMY' THEN 'None' ELSE 'Public-to-Private' END AS all_desc,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'Closure' ELSE 'Gates; Lighting' END AS tier1_desc,
  CAST(p_size AS DOUBLE) AS daily_trains, CAST(p_size % 20 + 2 AS DOUBLE) AS total_trains,
  CAST((p_partkey * 53) % 4000 AS DOUBLE) AS adt, p_retailprice / 10000 AS est_before, p_retailprice / 20000 AS est_all, p_retailprice / 15000 AS est_t1,
  CAST(p_partkey % 2 AS INT) AS field_review
FROM {part}""",
    "fx_routes": """
SELECT o_custkey AS crossing_id, CASE o_orderstatus WHEN 'F' THEN 'base' ELSE 'closure' END AS scenario,
  o_custkey % 9 + CASE WHEN o_custkey % 11 = 0 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS trips, CAST(SUM(CAST(o_orderkey AS BIGINT)) AS DOUBLE) AS distance, CAST(COUNT(*) * 60 AS DOUBLE) AS duration
FROM {orders} WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3""",
    "fx_overlines": """
SELECT o_custkey AS crossing_id, CASE o_orderstatus WHEN 'F' THEN 'base' ELSE 'closure' END AS scenario, o_orderkey % 5 AS link_id,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 100 END AS trips FROM {orders} WHERE o_orderstatus IN ('F', 'O')""",
    "fx_adt": """
SELECT c_custkey AS crossing_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST((c_custkey * 17) % 3000 AS DOUBLE) END AS final_adt FROM {customer}""",
    "fx_od": """
SELECT event_id AS ingest_seq, CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS o_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'link' END AS o_name,
  CASE WHEN event_id % 2 = 0 THEN user_id END AS d_id, CASE WHEN event_id % 2 = 0 THEN 'link' ELSE event_type END AS d_name,
  CASE WHEN event_id % 97 = 5 THEN NULL ELSE CAST(FLOOR(value) AS DOUBLE) END AS od_vol, CAST(10000 + length(event_type) AS DOUBLE) AS o_total, CAST(20000 + length(event_type) AS DOUBLE) AS d_total,
  CASE WHEN event_id % 3 = 0 THEN 'weekday' ELSE 'all' END AS day_type,
  CASE WHEN event_id % 7 = 0 THEN 'peak' ELSE 'all day' END AS day_part
FROM {events}""",
    "fx_reports": """
SELECT user_id * 2 AS crossing_id, COUNT(*) AS total FROM {events} WHERE event_type = 'error' GROUP BY 1""",
    "fx_recs": """
SELECT p_partkey AS crossing_id, CASE WHEN p_partkey % 4 = 0 THEN 'Lighting' ELSE 'Closure' END AS rec_1,
  CASE WHEN p_partkey % 3 = 0 THEN 'Grade Separation' WHEN p_partkey % 3 = 1 THEN 'Upgrade with gates and lights' END AS rec_2,
  CASE WHEN p_size % 10 = 0 THEN 'Other study' END AS rec_3 FROM {part}""",
    "fx_bcr": """
SELECT s_suppkey AS crossing_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Gates' END AS tier1desc, 'Lighting' AS tier2desc,
  CAST(s_suppkey % 5 * 1000 AS DOUBLE) AS tier1cost, CAST(2500 AS DOUBLE) AS tier2cost, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_suppkey * 100 AS STRING) END AS tier1ben,
  CAST(s_suppkey * 50 AS STRING) AS tier2ben FROM {supplier}""",
    "fx_vertices": """
SELECT CAST((c_custkey - c_custkey % 60) / 60 AS BIGINT) AS line_id, c_custkey % 60 AS seq,
  CAST((c_custkey % 60) * 1500 + (CAST((c_custkey - c_custkey % 60) / 60 AS BIGINT) % 25) * 13 AS DOUBLE) AS x,
  CAST(CAST((c_custkey - c_custkey % 60) / 60 AS BIGINT) * 4000 + (((c_custkey % 60) * 37) % 11) * 100 AS DOUBLE) AS y FROM {customer}""",
    "fx_lines": """
SELECT line_id, CASE WHEN line_id % 6 = 0 THEN NULL WHEN line_id % 6 = 1 THEN 'O' ELSE 'M' END AS net,
  CASE WHEN line_id % 8 = 7 THEN NULL ELSE CAST(line_id % 5 AS INT) END AS subdiv,
  CASE WHEN line_id % 7 = 3 THEN 'C' WHEN line_id % 11 = 5 THEN NULL ELSE 'A' END AS passenger
FROM (SELECT DISTINCT CAST((c_custkey - c_custkey % 60) / 60 AS BIGINT) AS line_id FROM {customer}) l""",
    "fx_edges": """
SELECT poly_id, ring, seq, CAST(x0 + dx1 AS DOUBLE) AS x1, CAST(y0 + dy1 AS DOUBLE) AS y1, CAST(x0 + dx2 AS DOUBLE) AS x2, CAST(y0 + dy2 AS DOUBLE) AS y2
FROM (SELECT s_suppkey AS poly_id, CAST((s_suppkey % 10) * 10000 + 3.5 AS DOUBLE) AS x0,
        CAST((s_suppkey - s_suppkey % 10) * 1000 + (s_suppkey % 10) * 1500 - 7500 + 3.5 AS DOUBLE) AS y0 FROM {supplier}) p
{ring_edges}""",
    "fx_sidings": "\nUNION ALL\n".join(f"""SELECT s_suppkey * 4 + {k} AS line_id, 0 AS seq, CAST((s_suppkey % 10) * 10000 + 3.5 + {dx1} AS DOUBLE) AS x1,
  CAST((s_suppkey - s_suppkey % 10) * 1000 + (s_suppkey % 10) * 1500 - 7500 + 3.5 + {dy1} AS DOUBLE) AS y1,
  CAST((s_suppkey % 10) * 10000 + 3.5 + {dx2} AS DOUBLE) AS x2,
  CAST((s_suppkey - s_suppkey % 10) * 1000 + (s_suppkey % 10) * 1500 - 7500 + 3.5 + {dy2} AS DOUBLE) AS y2 FROM {{supplier}}"""
                                        for k, (dx1, dy1, dx2, dy2) in enumerate(SIDINGS)),
    "fx_blocks": """
SELECT s_suppkey AS poly_id, s_name AS name, CASE WHEN s_suppkey % 97 = 5 THEN NULL ELSE 1000 + s_suppkey * 37 + CAST(1 AS DOUBLE) / 7 END AS estimate FROM {supplier}""",
}

SOURCES = ("part", "lineitem", "supplier", "orders", "customer", "events")
_EDGE_COLUMNS = "ring, seq, dx1, dy1, dx2, dy2"


def view_sql(name: str) -> str:
    """The view's text for the SQL check."""
    rows = ", ".join(str(r) for r in RING_EDGES)
    return VIEWS[name].strip().format(
        ring_edges=f"CROSS JOIN (VALUES {rows}) AS e({_EDGE_COLUMNS})", **{t: t for t in SOURCES})


def with_views(sql: str) -> str:
    """Put the definitions of the views a query names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({view_sql(v)})" for v in used)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


class Tables:
    """The source tables of one directory and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._seen: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        view = f"fx_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._seen:
            self._seen[view] = self._view(view)
        return self._seen[view]

    def _view(self, view: str) -> DataFrame:
        rows = ", ".join(f"struct{r}" for r in RING_EDGES)
        text = VIEWS[view].replace("{ring_edges}", f"LATERAL VIEW inline(array({rows})) e AS {_EDGE_COLUMNS}")
        used = {t: self.source(t) for t in SOURCES if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def segments(self) -> DataFrame:
        from crosstie.geo.shapes import segments_from_vertices
        return segments_from_vertices(self.vertices)
