"""Sources and sinks: every query writes a table to the shared scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie.catalog.registry import query
from crosstie.geo.measure import ENDS, length
from crosstie.geo.shapes import edges_from_rings
from crosstie.plans.grids import export_parcels
from crosstie.session import scratch_path
from crosstie.sources import features, store, tables

# Short parts, so that the lines of the fixtures consist of several.
PART_POINTS = 25


@query("SELECT crossing_id, final_adt FROM fx_adt")
def src_csv(t):
    path = scratch_path(t.spark, "adt")
    tables.write_table_csv(t.adt, path)
    return tables.read_table_csv(t.spark, path, "crossing_id bigint, final_adt double")


@query("""SELECT CAST(crossing_id AS STRING) AS crossing_id, iyr, killed, NULL AS injured, hr FROM fx_incidents
 UNION ALL SELECT CAST(crossing_id AS STRING), iyr, NULL, injured, NULL FROM fx_incidents""")
def src_dir_strings(t):
    root = scratch_path(t.spark, "incidents")
    tables.write_table_csv(t.incidents.select("crossing_id", "iyr", "killed", "hr"), f"{root}/a")
    tables.write_table_csv(t.incidents.select("crossing_id", "iyr", "injured"), f"{root}/b")
    out = tables.read_dir_strings(t.spark, f"{root}/*")
    return out.select("crossing_id", "iyr", "killed", "injured", "hr")


@query("SELECT ingest_seq, od_vol, day_type FROM fx_od")
def src_pruned(t):
    path = scratch_path(t.spark, "od")
    tables.write_table_csv(t.od, path)
    keep = {"ingest_seq": "bigint", "od_vol": "double", "day_type": "string"}
    return tables.read_csv_pruned(t.spark, path, keep, t.od.columns)


@query("SELECT crossing_id, notes, adt FROM fx_sheet")
def src_sheet(t):
    folder = scratch_path(t.spark, "workbook")
    tables.write_sheet(t.sheet.select("crossing_id", "notes", "adt"), folder, "Master Sheet")
    return tables.read_sheet(t.spark, folder, "Master Sheet", "crossing_id bigint, notes string, adt double")


@query("SELECT line_id, COUNT(*) AS n_points, SUM(x) AS sum_x, SUM(y) AS sum_y FROM fx_vertices GROUP BY 1")
def src_geojson(t):
    path = scratch_path(t.spark, "lines")
    lines = features.lines_from_vertices(t.vertices, most_points=PART_POINTS)
    features.write_geojson(lines, path, features.LINE, ["line_id", "first_seq"])
    back = features.read_geojson(t.spark, path, features.LINE, "line_id: bigint, first_seq: bigint")
    return features.vertices_from_lines(back).groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("""SELECT a.line_id, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_vertices a
 JOIN fx_vertices b ON b.line_id = a.line_id AND b.seq = a.seq + 1""")
def src_features(t):
    path = scratch_path(t.spark, "features")
    features.write_features(features.lines_from_vertices(t.vertices, most_points=PART_POINTS), path)
    return features.segments_from_lines(features.read_features(t.spark, path)).select("line_id", "seq", *ENDS)


@query("SELECT poly_id, name, estimate FROM fx_blocks")
def src_reference(t):
    root = scratch_path(t.spark, "reference")
    store.checkpoint({"block_groups": t.blocks}, root)
    return store.read_reference(t.spark, root, "block_groups")


@query("SELECT 'incidents' AS name, COUNT(*) AS n FROM fx_incidents UNION ALL SELECT 'crossings', COUNT(*) FROM fx_crossings")
def snk_checkpoint(t):
    root = scratch_path(t.spark, "store")
    store.checkpoint({"incidents": t.incidents, "crossings": t.crossings}, root)
    parts = [store.restore(t.spark, root, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
             for n in ("incidents", "crossings")]
    return parts[0].union(parts[1])


@query("SELECT crossing_id, corridor, adt FROM fx_sheet")
def snk_csv(t):
    path = scratch_path(t.spark, "sheet")
    tables.write_table_csv(t.sheet.select("crossing_id", "corridor", "adt"), path)
    return tables.read_table_csv(t.spark, path, "crossing_id bigint, corridor string, adt double")


@query("SELECT crossing_id, street, x, y FROM fx_crossings")
def snk_geojson(t):
    path = scratch_path(t.spark, "points")
    features.write_geojson(t.crossings, path, features.POINT, ["crossing_id", "street"])
    return features.read_geojson(t.spark, path, features.POINT, "crossing_id: bigint, street: string")


@query("SELECT crossing_id, rec_1, rec_2 FROM fx_recs")
def snk_sheet(t):
    folder = scratch_path(t.spark, "export")
    tables.write_sheet(t.recs.select("crossing_id", "rec_1", "rec_2"), folder, "Teams")
    return tables.read_sheet(t.spark, folder, "Teams", "crossing_id bigint, rec_1 string, rec_2 string")


@query("SELECT s_suppkey AS parcel_id, s_name AS owner, CAST(4 AS BIGINT) AS n_edges, 4.0 * (s_suppkey + 1) AS perimeter FROM supplier"
       .replace("4.0 * (s_suppkey + 1)", "CAST(4 * (s_suppkey + 1) AS DOUBLE)"))
def snk_parcels(t):
    side = "CAST(s_suppkey + 1 AS DOUBLE)"
    corners = ", ".join(f"struct({x} AS x, {y} AS y)" for x, y in (("0D", "0D"), (side, "0D"), (side, side), ("0D", side), ("0D", "0D")))
    parcels = t.source("supplier").selectExpr("s_suppkey AS parcel_id", "s_name AS owner", f"array(array({corners})) AS rings")
    source, target = scratch_path(t.spark, "parcels"), scratch_path(t.spark, "parcels-json")
    features.write_features(parcels, source)
    export_parcels(t.spark, source, target, ["parcel_id", "owner"])
    back = features.read_geojson(t.spark, target, features.POLYGON, "parcel_id: bigint, owner: string")
    return edges_from_rings(back).groupBy("parcel_id", "owner").agg(
        F.count(F.lit(1)).alias("n_edges"), F.expr(f"sum({length()}) AS perimeter"))
