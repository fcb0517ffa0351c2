"""Joins, aggregates, windows, sorts, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie.catalog.registry import query
from crosstie.catalog.rows import CRASH_TIME, LEGEND, MOTORIST, POSITION, VEHICLE, assets, flag_sql
from crosstie.catalog.sqltext import (
    ASSETS, CORRIDOR_CASE, CORRIDORS, GROUP, HISTORY, IN_SCOPE, SEVERITY, WINDOW_YEARS, in_list,
)
from crosstie.functions import rules
from crosstie.functions.nulls import strict_sum
from crosstie.operators import joins, reshape, tables, windows
from crosstie.plans import assets as asset_plans
from crosstie.plans import closure, reports, risk

GATES = ("click", "error", "purchase", "signup", "view")


# Joins ---------------------------------------------------------------------

@query("""SELECT s.crossing_id, s.corridor, n.n, n.crossing_total FROM fx_sheet s LEFT JOIN
 (SELECT corridor, COUNT(*) AS n, SUM(crossing_id) AS crossing_total FROM (SELECT corridor, CAST(crossing_id AS BIGINT) AS crossing_id FROM fx_crossings) c GROUP BY 1) n
 ON s.corridor IS NOT DISTINCT FROM n.corridor""".replace("SUM(crossing_id)", "CAST(SUM(crossing_id) AS BIGINT)"))
def jn_natural_left(t):
    per = t.crossings.groupBy("corridor").agg(F.count(F.lit(1)).alias("n"), F.sum("crossing_id").alias("crossing_total"))
    sheet = t.sheet.select("crossing_id", "corridor")
    return joins.spread_join(sheet, per, joins.natural_keys(sheet, per), row_key=["crossing_id"])


@query("""SELECT c.crossing_id, s.road AS survey_road, s.aadt AS survey_aadt FROM fx_crossings c
 LEFT JOIN fx_survey s ON c.crossing_id = s.crossing_id""")
def jn_left_renamed(t):
    side = t.survey.select("crossing_id", F.col("road").alias("survey_road"), F.col("aadt").alias("survey_aadt"))
    return joins.key_join(t.crossings.select("crossing_id"), side)


@query("SELECT c.crossing_id, c.street, r.total FROM fx_crossings c LEFT JOIN fx_reports r ON c.crossing_id = r.crossing_id")
def jn_left_diff_keys(t):
    side = t.reports.select(F.col("crossing_id").alias("reported_id"), "total")
    return joins.key_join(t.crossings.select("crossing_id", "street"), side, [("crossing_id", "reported_id")])


@query("""SELECT a.crossing_id, r.trips, r.distance, a.final_adt FROM fx_routes r RIGHT JOIN fx_adt a ON r.crossing_id = a.crossing_id""")
def jn_right(t):
    return joins.key_join(t.routes.select("crossing_id", "trips", "distance"), t.adt, ["crossing_id"], "right")


@query("""SELECT COALESCE(l.link_id, o.link_id) AS link_id, l.final_adt, o.volume FROM
 (SELECT crossing_id * 2 AS link_id, final_adt FROM fx_adt) l FULL JOIN
 (SELECT COALESCE(o_id, d_id) AS link_id, SUM(od_vol) AS volume FROM fx_od GROUP BY 1) o ON l.link_id = o.link_id""")
def jn_full(t):
    links = t.adt.select((F.col("crossing_id") * 2).alias("segment_id"), "final_adt")
    flows = t.od.groupBy(F.coalesce("o_id", "d_id").alias("link_id")).agg(F.sum("od_vol").alias("volume"))
    return joins.key_join(links, flows, [("segment_id", "link_id")], "full").withColumnRenamed("segment_id", "link_id")


@query("SELECT crossing_id, street FROM fx_crossings WHERE crossing_id IN (SELECT crossing_id FROM fx_survey)")
def jn_semi(t):
    return joins.semi(t.crossings.select("crossing_id", "street"), t.survey, ["crossing_id"])


@query("""SELECT crossing_id, corridor FROM fx_crossings c WHERE NOT EXISTS
 (SELECT 1 FROM fx_sheet s WHERE s.notes = 'Exclude' AND s.crossing_id = c.crossing_id)""")
def jn_anti(t):
    return joins.anti(t.crossings.select("crossing_id", "corridor"), t.sheet.where(F.col("notes") == "Exclude"), ["crossing_id"])


@query(f"SELECT line_id, net, subdiv, passenger, {CORRIDOR_CASE} AS rail_corridor FROM fx_lines")
def jn_lookup(t):
    return joins.lookup(t.lines, "subdiv", CORRIDORS, "rail_corridor")


TIERED_SQL = """WITH d AS (SELECT crossing_id || '_' || n AS bc_id, description FROM
  (SELECT CAST(crossing_id AS STRING) AS crossing_id, 'tier1' AS n, tier1desc AS description FROM fx_bcr UNION ALL
   SELECT CAST(crossing_id AS STRING), 'tier2', tier2desc FROM fx_bcr) u),
c AS (SELECT crossing_id || '_tier1' AS bc_id, tier1cost AS cost FROM fx_bcr UNION ALL SELECT crossing_id || '_tier2', tier2cost FROM fx_bcr),
b AS (SELECT crossing_id || '_tier1' AS bc_id, tier1ben AS benefit FROM fx_bcr UNION ALL SELECT crossing_id || '_tier2', tier2ben FROM fx_bcr)
"""


@query(TIERED_SQL + "SELECT d.bc_id, d.description, c.cost, b.benefit FROM d LEFT JOIN c USING (bc_id) LEFT JOIN b USING (bc_id)")
def jn_composite(t):
    described = reports.tiered(t.bcr, ["tier1desc", "tier2desc"], "description")
    costs = reports.tiered(t.bcr, ["tier1cost", "tier2cost"], "cost")
    benefits = reports.tiered(t.bcr, ["tier1ben", "tier2ben"], "benefit")
    return joins.key_join(joins.key_join(described, costs, ["bc_id"]), benefits, ["bc_id"])


@query(TIERED_SQL + """SELECT d.bc_id, d.description, c.cost, TRY_CAST(b.benefit AS DOUBLE) AS benefit,
 ROUND(TRY_CAST(b.benefit AS DOUBLE) / NULLIF(c.cost, 0), 6) AS ratio
 FROM d LEFT JOIN c USING (bc_id) LEFT JOIN b USING (bc_id) WHERE d.description IS NOT NULL""")
def pipe_bcr(t):
    out = reports.benefit_cost(t.bcr, t.bcr, ["tier1ben", "tier2ben"], ["tier1desc", "tier2desc"], ["tier1cost", "tier2cost"])
    return out.withColumn("ratio", F.round("ratio", 6))


# Aggregations --------------------------------------------------------------

@query(f"WITH {ASSETS} SELECT corridor, warn_dev, COUNT(*) AS n FROM assets GROUP BY 1, 2")
def agg_count(t):
    return tables.count_by(assets(t), "corridor", "warn_dev")


@query("SELECT COUNT(*) AS n FROM fx_crossings")
def agg_total(t):
    return t.crossings.agg(F.count(F.lit(1)).alias("n"))


YEARS_SQL = f"""y AS (SELECT crossing_id, iyr, COUNT(*) FILTER (WHERE sev = 'PDO') AS "PDO", COUNT(*) FILTER (WHERE sev = 'Injury') AS "Injury",
 COUNT(*) FILTER (WHERE sev = 'Fatal') AS "Fatal", COUNT(*) AS total
 FROM (SELECT *, {SEVERITY} AS sev FROM fx_incidents) i GROUP BY 1, 2)"""


@query(f"WITH {YEARS_SQL} SELECT * FROM y")
def agg_incident_year(t):
    return asset_plans.incident_years(t.incidents)


def _hist(where: str = "") -> str:
    return (f'WITH {YEARS_SQL} SELECT crossing_id, CAST(SUM(total) AS BIGINT) AS inc_tot, CAST(SUM("Fatal") AS BIGINT) AS inc_fat, '
            f'CAST(SUM("Injury") AS BIGINT) AS inc_inj FROM y {where} GROUP BY 1')


_HIST = {"inc_tot": "total", "inc_fat": "Fatal", "inc_inj": "Injury"}


@query(_hist())
def agg_hist_all(t):
    return tables.sums_by(asset_plans.incident_years(t.incidents), ["crossing_id"], _HIST)


@query(_hist(f"WHERE iyr IN {in_list(WINDOW_YEARS)}"))
def agg_hist_window(t):
    years = asset_plans.incident_years(t.incidents.where(F.col("iyr").isin(*WINDOW_YEARS)))
    return tables.sums_by(years, ["crossing_id"], _HIST)


OD_SIDE_SQL = """side AS (SELECT *, CASE WHEN o_id IS NULL THEN o_name ELSE d_name END AS gate,
 CASE WHEN o_id IS NULL THEN d_id ELSE o_id END AS link_id, CASE WHEN o_id IS NULL THEN o_total ELSE d_total END AS gate_total
 FROM fx_od WHERE day_type = 'all' AND day_part = 'all day'),
share AS (SELECT gate, link_id, CASE WHEN COUNT(od_vol) = COUNT(*) THEN SUM(od_vol) END AS volume, arg_min(gate_total, ingest_seq) AS gate_total FROM side GROUP BY 1, 2),
pct AS (SELECT gate, link_id, round_even(volume / gate_total * 100, 0) AS trip_percent FROM share)"""


@query(f"WITH {OD_SIDE_SQL} SELECT * FROM share")
def agg_consolidate(t):
    return closure.whole_period(closure.gate_side(t.od)).groupBy("gate", "link_id").agg(
        strict_sum("od_vol").alias("volume"), F.min_by("gate_total", "ingest_seq").alias("gate_total"))


def _strict(c: str) -> str:
    return f"CASE WHEN COUNT({c}) = COUNT(*) THEN SUM({c}) END"


CORRIDOR_SQL = f"""WITH e AS (SELECT *, total_trains * adt AS exp_ind,
  CASE WHEN regexp_matches(all_desc, 'Clos|Grade Sep') THEN 0.0 ELSE total_trains * adt END AS exp_all,
  CASE WHEN regexp_matches(tier1_desc, 'Clos|Grade Sep') THEN 0.0 ELSE total_trains * adt END AS exp_t1
 FROM fx_sheet WHERE {IN_SCOPE} AND corridor IS NOT NULL),
s AS (SELECT corridor, {_strict('est_before')} AS est_inc_before, {_strict('est_all')} AS est_inc_after_all, {_strict('est_t1')} AS est_inc_after_t1,
 {_strict('exp_ind')} AS exp_ind_tot, {_strict('exp_all')} AS exp_ind_all, {_strict('exp_t1')} AS exp_ind_t1 FROM e GROUP BY 1),
m AS (SELECT *, 1 - est_inc_after_all / NULLIF(est_inc_before, 0) AS percent_red_all, 1 - est_inc_after_t1 / NULLIF(est_inc_before, 0) AS percent_red_t1,
 est_inc_before - est_inc_after_all AS delta_inc_all, est_inc_before - est_inc_after_t1 AS delta_inc_t1,
 (exp_ind_all - exp_ind_tot) / NULLIF(exp_ind_tot, 0) AS percent_exp_ind_red_all, (exp_ind_t1 - exp_ind_tot) / NULLIF(exp_ind_tot, 0) AS percent_exp_ind_red_t1,
 exp_ind_tot - exp_ind_all AS delta_exp_ind_all, exp_ind_tot - exp_ind_t1 AS delta_exp_ind_t1 FROM s)
"""


def _rounded(df, *keys, digits=5):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


@query(CORRIDOR_SQL + "SELECT corridor, " + ", ".join(f"ROUND({m}, 5) AS {m}" for m in risk.SUMMARY_METRICS) + " FROM m")
def agg_corridor_rollup(t):
    return _rounded(risk.corridor_summary(t.sheet), "corridor")


@query(CORRIDOR_SQL + ", l AS (UNPIVOT m ON " + ", ".join(risk.SUMMARY_METRICS) + " INTO NAME metric VALUE v) "
       """SELECT metric, ROUND(MAX(v) FILTER (WHERE corridor = 'Valley'), 5) AS "Valley",
 ROUND(MAX(v) FILTER (WHERE corridor = 'Ridge'), 5) AS "Ridge" FROM l GROUP BY 1""")
def pipe_corridor(t):
    return _rounded(risk.corridor_summary_table(t.sheet, ["Valley", "Ridge"]), "metric")


def _tally(c: str, first_tier: bool) -> str:
    flags = {n: flag_sql(c, w) for n, w in rules.TREATMENT_FLAGS.items()}
    if first_tier:
        flags["gates"] = f"({flag_sql(c, 'Gates')} - {flag_sql(c, 'Security')})"
    more = f" AND {c} IS NOT NULL" if first_tier else ""
    sums = ", ".join(f"CAST({_strict(f)} AS BIGINT) AS {n}" for n, f in flags.items())
    return f"SELECT corridor, {sums} FROM fx_sheet WHERE {IN_SCOPE} AND corridor IS NOT NULL{more} GROUP BY 1"


@query(_tally("all_desc", False))
def agg_treatment_tally_all(t):
    return risk.treatment_tally(t.sheet)


@query(_tally("tier1_desc", True))
def agg_treatment_tally_t1(t):
    return risk.treatment_tally(t.sheet, first_tier=True)


@query("SELECT 'all' AS tier, corridor, closures, afws, lighting, other, public_to_private, security_gates, grade_seps, NULL AS gates FROM ("
       + _tally("all_desc", False) + ") a UNION ALL SELECT 't1', corridor, closures, afws, lighting, other, public_to_private, security_gates, grade_seps, gates FROM ("
       + _tally("tier1_desc", True) + ") b")
def pipe_tally(t):
    first = risk.treatment_tally(t.sheet, first_tier=True).withColumn("tier", F.lit("t1"))
    return tables.union_by_name(risk.treatment_tally(t.sheet).withColumn("tier", F.lit("all")), first)


@query("SELECT corridor, CAST(FLOOR(daily_trains) AS DOUBLE) AS bin, COUNT(*) AS n FROM fx_sheet GROUP BY 1, 2")
def agg_histogram(t):
    return tables.histogram(t.sheet, ["corridor"], "daily_trains", 1.0)


MODES = ("daily_trains", "total_trains", "adt")
_MODES_SQL = " UNION ALL ".join(f"SELECT '{m}' AS mode, {m} AS volume FROM fx_sheet" for m in MODES)


@query(f"""SELECT mode, CAST(FLOOR(log10(volume) * 10) AS BIGINT) AS bin, COUNT(*) AS n FROM ({_MODES_SQL}) v WHERE volume > 0 GROUP BY 1, 2""")
def pipe_modes(t):
    return reports.mode_volumes(t.sheet, MODES)


@query("""SELECT scenario, CAST(FLOOR(log10(distance) * 5) AS BIGINT) AS bin, COUNT(*) AS n FROM fx_routes WHERE distance > 0 GROUP BY 1, 2""")
def agg_log_histogram(t):
    return tables.log_histogram(t.routes, ["scenario"], "distance", 5)


# Windows -------------------------------------------------------------------

AXES = {"Valley": "x", "Ridge": "y"}
ORDER_FIXES = {("Valley", 5): 6, ("Valley", 6): 5, ("Ridge", 20): 18}
ORDER_SQL = """o AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY corridor ORDER BY CASE corridor WHEN 'Valley' THEN x ELSE y END, crossing_id) AS INT) AS ord0
 FROM assets WHERE corridor IN ('Valley', 'Ridge')),
w AS (SELECT *, CASE WHEN corridor = 'Valley' AND ord0 = 5 THEN 6 WHEN corridor = 'Valley' AND ord0 = 6 THEN 5
 WHEN corridor = 'Ridge' AND ord0 = 20 THEN 18 ELSE ord0 END AS "order" FROM o)"""


@query(f"WITH {ASSETS}, {ORDER_SQL} SELECT corridor, crossing_id, ord0 AS \"order\" FROM w")
def win_corridor_order(t):
    listed = t.crossings.where(F.col("corridor").isin(*AXES)).withColumn(
        "pos", F.when(F.col("corridor") == "Valley", F.col("x")).otherwise(F.col("y")))
    return windows.number_in_order(listed.select("corridor", "crossing_id", "pos"), ["corridor"],
                                   [F.col("pos"), F.col("crossing_id")], "order").drop("pos")


RECS_SQL = f"""long AS (SELECT crossing_id, 'rec_1' AS rec_num, rec_1 AS recommendation FROM fx_recs WHERE rec_1 IS NOT NULL UNION ALL
 SELECT crossing_id, 'rec_2', rec_2 FROM fx_recs WHERE rec_2 IS NOT NULL UNION ALL SELECT crossing_id, 'rec_3', rec_3 FROM fx_recs WHERE rec_3 IS NOT NULL),
legend AS (SELECT recommendation, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*), recommendation) * 10 AS INT) AS legend_order,
 {LEGEND.format(c='recommendation')} AS legend_group FROM long GROUP BY recommendation)"""


@query(f"WITH {RECS_SQL} SELECT recommendation, n, legend_order, legend_group FROM legend")
def win_ordinal(t):
    return reports.recommendation_legend(reports.recommendations_long(t.recs))


@query("""SELECT crossing_id, corridor, daily_trains, RANK() OVER (PARTITION BY corridor ORDER BY daily_trains)
 + (COUNT(*) OVER (PARTITION BY corridor, daily_trains) - 1) / 2.0 AS rank FROM fx_sheet""".replace(
    "RANK() OVER (PARTITION BY corridor ORDER BY daily_trains)\n +", "CAST(RANK() OVER (PARTITION BY corridor ORDER BY daily_trains) AS DOUBLE) +"))
def win_avg_rank(t):
    return windows.average_rank(t.sheet.select("crossing_id", "corridor", "daily_trains"), ["corridor"], "daily_trains", "rank")


@query("""SELECT crossing_id, corridor, adt FROM (SELECT crossing_id, corridor, adt, MIN(adt) OVER (PARTITION BY corridor) AS m FROM fx_sheet) s WHERE adt = m""")
def win_group_min(t):
    return windows.keep_group_min(t.sheet.select("crossing_id", "corridor", "adt"), ["corridor"], "adt")


# Sorts and sets ------------------------------------------------------------

@query("SELECT crossing_id, corridor, adt FROM fx_sheet ORDER BY corridor NULLS LAST, adt NULLS LAST, crossing_id")
def srt_asc(t):
    return tables.sort_last(t.sheet.select("crossing_id", "corridor", "adt"), "corridor", "adt", "crossing_id")


@query("SELECT crossing_id, final_adt FROM fx_adt ORDER BY final_adt DESC NULLS LAST, crossing_id")
def srt_desc(t):
    return tables.sort_last(t.adt, "-final_adt", "crossing_id")


@query("SELECT crossing_id, street, lon, lat FROM fx_crossings WHERE crossing_id = 11")
def srt_pick(t):
    return t.crossings.where(F.col("crossing_id") == 11).select("crossing_id", "street", "lon", "lat")


@query("""SELECT crossing_id, street, CAST(NULL AS DOUBLE) AS aadt FROM fx_crossings
 UNION ALL SELECT crossing_id, NULL, aadt FROM fx_survey""")
def set_union(t):
    return tables.union_by_name(t.crossings.select("crossing_id", "street"), t.survey.select("crossing_id", "aadt"))


@query("""SELECT COALESCE(a.crossing_id, b.crossing_id) AS crossing_id, COALESCE(a.n, 0) AS n_left, COALESCE(b.n, 0) AS n_right,
 CASE WHEN a.n IS NULL THEN 'only_right' WHEN b.n IS NULL THEN 'only_left' ELSE 'both' END AS status FROM
 (SELECT crossing_id, COUNT(*) AS n FROM fx_crossings WHERE reason_id <> 16 GROUP BY 1) a FULL JOIN
 (SELECT crossing_id, COUNT(*) AS n FROM fx_survey GROUP BY 1) b ON a.crossing_id = b.crossing_id""")
def set_reconcile(t):
    return joins.reconcile(t.crossings.where(F.col("reason_id") != 16), t.survey, "crossing_id")


# Reshaping -----------------------------------------------------------------

_YEARS = ("95", "96", "97", "98", "99", "00", "01")


def _pivot_sql(fill: bool) -> str:
    def cell(y):
        c = f"COUNT(*) FILTER (WHERE iyr = '{y}')"
        return f'{c if fill else f"NULLIF({c}, 0)"} AS "{y}"'
    rest = "COUNT(*) FILTER (WHERE iyr IS NULL OR iyr NOT IN ('" + "', '".join(_YEARS) + "'))"
    return (f"SELECT {VEHICLE} AS vehicle, pos_code, {', '.join(cell(y) for y in _YEARS)}, {rest if fill else f'NULLIF({rest}, 0)'} AS rest "
            "FROM fx_incidents GROUP BY 1, 2")


def _vehicles(t):
    return t.incidents.withColumn("vehicle", rules.decode("veh_code", rules.VEHICLE_CODES, "Other"))


@query(_pivot_sql(True))
def rsh_wide(t):
    return reshape.widen_counts(_vehicles(t), ["vehicle", "pos_code"], "iyr", _YEARS, rest="rest")


@query(_pivot_sql(False))
def rsh_wide_nofill(t):
    return reshape.widen_counts(_vehicles(t), ["vehicle", "pos_code"], "iyr", _YEARS, fill=False, rest="rest")


ROUTES_SQL = """wide AS (SELECT crossing_id, trips, MAX(distance) FILTER (WHERE scenario = 'base') AS distance_base,
 MAX(distance) FILTER (WHERE scenario = 'closure') AS distance_closure, MAX(duration) FILTER (WHERE scenario = 'base') AS duration_base,
 MAX(duration) FILTER (WHERE scenario = 'closure') AS duration_closure FROM fx_routes GROUP BY 1, 2)"""


@query(f"WITH {ROUTES_SQL} SELECT * FROM wide")
def rsh_wide_multi(t):
    return closure.route_totals_wide(t.routes)


@query(f"WITH {RECS_SQL} SELECT crossing_id, rec_num, recommendation FROM long")
def rsh_long(t):
    return reports.recommendations_long(t.recs)


SPREAD_SQL = f"""{OD_SIDE_SQL},
wide AS (SELECT COALESCE(link_id, 0) AS link_id, """ + ", ".join(
    f"COALESCE(MAX(trip_percent) FILTER (WHERE gate = '{g}'), 0) AS \"{g}\"" for g in GATES) + """,
 COALESCE(SUM(trip_percent), 0) AS tot_vol FROM pct GROUP BY 1)"""


@query(f"""WITH {SPREAD_SQL}, other AS (SELECT COALESCE(link_id, 0) AS link_id,
 COALESCE(SUM(trip_percent) FILTER (WHERE gate IS NULL OR gate NOT IN ('{GATES[0]}', '{GATES[1]}')), 0) AS rest FROM pct GROUP BY 1)
SELECT w.link_id, w."{GATES[0]}", w."{GATES[1]}", o.rest, w.tot_vol FROM wide w JOIN other o ON o.link_id = w.link_id""")
def rsh_spread_total(t):
    return reshape.spread_total(closure.trip_percent(t.od), "link_id", "gate", GATES[:2], "trip_percent", "tot_vol", "rest")


@query("SELECT crossing_id, daily_trains + total_trains + adt AS total FROM fx_sheet")
def rsh_row_total(t):
    return reshape.row_total(t.sheet, MODES, "total").select("crossing_id", "total")


@query("""WITH s AS (SELECT corridor, CAST(COUNT(*) AS DOUBLE) AS n, SUM(pass_cnt) * 1.0 AS trains, CAST(MAX(pass_cnt) AS DOUBLE) AS busiest FROM fx_crossings GROUP BY 1),
u AS (SELECT corridor, 'n' AS metric, n AS v FROM s UNION ALL SELECT corridor, 'trains', CAST(trains AS DOUBLE) FROM s UNION ALL SELECT corridor, 'busiest', busiest FROM s)
SELECT metric, MAX(v) FILTER (WHERE corridor = 'Valley') AS "Valley", MAX(v) FILTER (WHERE corridor = 'Ridge') AS "Ridge",
 MAX(v) FILTER (WHERE corridor = 'Harbor') AS "Harbor", MAX(v) FILTER (WHERE corridor IS NULL) AS "NA" FROM u GROUP BY 1""")
def rsh_transpose(t):
    per = t.crossings.groupBy("corridor").agg(F.count(F.lit(1)).alias("n"), F.sum("pass_cnt").alias("trains"),
                                              F.max("pass_cnt").alias("busiest"))
    return reshape.transpose(per, "corridor", ["Valley", "Ridge", "Harbor", None], ["n", "trains", "busiest"])


# Tabular plans -------------------------------------------------------------

_TITLE = ("array_to_string(list_transform(regexp_extract_all(subdiv_name, '([a-zA-Z]+|[^a-zA-Z]+)'), "
          "lambda p: upper(p[1]) || lower(p[2:])), '')")


@query(f"""WITH {HISTORY}, b AS (SELECT c.crossing_id, c.milepost, c.railroad, c.max_speed, c.hwy_speed, c.subdiv_name, s.grade1, s.grade2, COALESCE(h.inc_fat_win, 0) AS inc_fat_win,
  COALESCE(h.inc_inj_win, 0) AS inc_inj_win, COALESCE(h.inc_tot_win, 0) AS inc_tot_win FROM fx_crossings c
  LEFT JOIN fx_survey s ON c.crossing_id = s.crossing_id LEFT JOIN history h ON h.crossing_id = c.crossing_id WHERE c.reason_id <> 16)
SELECT crossing_id, milepost, railroad, max_speed, hwy_speed, {_TITLE} AS subdiv_name, inc_fat_win, inc_inj_win, inc_tot_win - inc_fat_win - inc_inj_win AS inc_pdo_win, inc_tot_win,
 grade1 + grade2 AS grade_change FROM b""")
def pipe_master(t):
    history = asset_plans.incident_history(t.incidents, WINDOW_YEARS)
    base = joins.key_join(asset_plans.surveyed_inventory(t.crossings, t.survey), history, ["crossing_id"])
    return asset_plans.master_base(base)


@query(f"""WITH {ASSETS}, {HISTORY}, b AS (SELECT a.corridor, {GROUP} AS device_group, h.inc_fat_win, h.inc_inj_win,
  h.inc_tot_win - h.inc_fat_win - h.inc_inj_win AS pdo FROM assets a LEFT JOIN history h ON a.crossing_id = h.crossing_id)
SELECT corridor, device_group, COUNT(*) AS n, COUNT(*) FILTER (WHERE inc_fat_win > 0) AS n_fatal,
 COUNT(*) FILTER (WHERE inc_inj_win > 0) AS n_injury, COUNT(*) FILTER (WHERE pdo > 0) AS n_pdo FROM b GROUP BY 1, 2""")
def pipe_breakdown(t):
    history = asset_plans.incident_history(t.incidents, WINDOW_YEARS)
    return asset_plans.corridor_breakdown(joins.key_join(assets(t), history, ["crossing_id"]), "corridor")


@query("""SELECT crossing_id, subdiv_name, pass_cnt FROM fx_crossings c WHERE crossing_id IN (SELECT crossing_id FROM fx_survey)
 AND pass_cnt > 0 AND (subdiv_name IS NULL OR subdiv_name NOT IN ('QUARRY IND-LD', 'Mill Ind Ld'))
 AND NOT EXISTS (SELECT 1 FROM fx_sheet s WHERE s.notes = 'Exclude' AND s.crossing_id = c.crossing_id)""")
def pipe_surveyed(t):
    out = asset_plans.surveyed_subset(t.crossings, t.survey, ("QUARRY IND-LD", "Mill Ind Ld"),
                                      t.sheet.where(F.col("notes") == "Exclude"))
    return out.select("crossing_id", "subdiv_name", "pass_cnt")


@query(f"""WITH {ROUTES_SQL}, x AS (SELECT crossing_id, (distance_closure - distance_base) / NULLIF(trips, 0) AS extra_dist_per_veh,
  (duration_closure - duration_base) / NULLIF(trips, 0) / 60 AS extra_dur_per_veh_min FROM wide)
SELECT x.crossing_id, ROUND(x.extra_dist_per_veh, 5) AS extra_dist_per_veh, ROUND(x.extra_dur_per_veh_min, 5) AS extra_dur_per_veh_min, a.final_adt,
 round_even(x.extra_dur_per_veh_min * a.final_adt / 60, 2) AS ex_veh_hr,
 round_even(x.extra_dist_per_veh * a.final_adt / 1609.34, 2) AS ex_veh_mi, '' AS text FROM x LEFT JOIN fx_adt a ON x.crossing_id = a.crossing_id""")
def pipe_detour(t):
    out = closure.closure_detour(t.routes, t.adt)
    return out.withColumns({c: F.round(c, 5) for c in ("extra_dist_per_veh", "extra_dur_per_veh_min")})


@query("""WITH s AS (SELECT crossing_id, AVG(duration) AS avg_chg_duration, MAX(duration) AS max_chg_duration, MIN(duration) AS min_chg_duration FROM fx_routes GROUP BY 1)
SELECT a.crossing_id, ROUND(s.avg_chg_duration, 5) AS avg_chg_duration, s.max_chg_duration, s.min_chg_duration, a.final_adt,
 round_even(s.avg_chg_duration / 3600 * a.final_adt, 2) AS veh_hrs FROM s RIGHT JOIN fx_adt a ON s.crossing_id = a.crossing_id""")
def pipe_delay(t):
    stats = t.routes.groupBy("crossing_id").agg(F.avg("duration").alias("avg_chg_duration"), F.max("duration").alias("max_chg_duration"),
                                                F.min("duration").alias("min_chg_duration"))
    return closure.closure_delay(stats, t.adt).withColumn("avg_chg_duration", F.round("avg_chg_duration", 5))


@query("""SELECT crossing_id, link_id, CAST(SUM(trips) FILTER (WHERE scenario = 'base') AS BIGINT) AS base, CAST(SUM(trips) FILTER (WHERE scenario = 'closure') AS BIGINT) AS closure,
 CAST(SUM(trips) FILTER (WHERE scenario = 'closure') - SUM(trips) FILTER (WHERE scenario = 'base') AS BIGINT) AS delta FROM fx_overlines GROUP BY 1, 2""")
def pipe_scenario(t):
    return closure.scenario_volumes(t.overlines)


@query(f"""WITH {SPREAD_SQL}, l AS (SELECT crossing_id * 2 AS link_id, final_adt FROM fx_adt)
SELECT COALESCE(l.link_id, w.link_id) AS link_id, l.final_adt, """ + ", ".join(f'w."{g}"' for g in GATES) + ", "
       + " + ".join(f'w."{g}"' for g in GATES) + " AS tot_vol FROM l FULL JOIN wide w ON l.link_id = w.link_id")
def pipe_gate_share(t):
    links = t.adt.select((F.col("crossing_id") * 2).alias("link_id"), "final_adt")
    return closure.gate_trip_share(t.od, links, GATES)


@query(f"""WITH {ASSETS}, c AS (SELECT {VEHICLE} AS vehicle, a.corridor FROM fx_incidents i JOIN assets a ON i.crossing_id = a.crossing_id)
SELECT vehicle, NULLIF(COUNT(*) FILTER (WHERE corridor = 'Valley'), 0) AS "Valley", NULLIF(COUNT(*) FILTER (WHERE corridor = 'Ridge'), 0) AS "Ridge",
 NULLIF(COUNT(*) FILTER (WHERE corridor IS NULL), 0) AS "NA",
 NULLIF(COUNT(*) FILTER (WHERE corridor NOT IN ('Valley', 'Ridge')), 0) AS rest FROM c GROUP BY 1""")
def pipe_crash_vehicles(t):
    return reports.crashes_by(reports.crash_summary(t.incidents, t.crossings), "vehicle", ["Valley", "Ridge", None])


@query(f"""WITH c AS (SELECT {MOTORIST} AS motorist, a.corridor FROM fx_incidents i JOIN fx_crossings a ON i.crossing_id = a.crossing_id)
SELECT motorist, NULLIF(COUNT(*) FILTER (WHERE corridor = 'Valley'), 0) AS "Valley", NULLIF(COUNT(*) FILTER (WHERE corridor = 'Ridge'), 0) AS "Ridge",
 NULLIF(COUNT(*) FILTER (WHERE corridor IS NULL OR corridor NOT IN ('Valley', 'Ridge')), 0) AS rest FROM c GROUP BY 1""")
def pipe_crash_actions(t):
    return reports.crashes_by(reports.crash_summary(t.incidents, t.crossings), "motorist", ["Valley", "Ridge"])


@query(f"""SELECT i.crossing_id, a.corridor, {CRASH_TIME} AS crash_time, {VEHICLE} AS vehicle, {POSITION} AS position, {MOTORIST} AS motorist,
 {SEVERITY} AS severity, concat_ws(' ', narr1, narr2, narr3, narr4, narr5) AS narrative FROM fx_incidents i JOIN fx_crossings a ON i.crossing_id = a.crossing_id""")
def pipe_crash(t):
    return reports.crash_summary(t.incidents, t.crossings)


@query("""SELECT a.crossing_id, a.corridor, ROUND(s.est_before + s.est_all + s.est_t1, 6) AS est_ann FROM fx_crossings a
 LEFT JOIN fx_sheet s ON a.crossing_id = s.crossing_id""")
def pipe_predicted(t):
    model = t.sheet.select("crossing_id", F.col("est_before").alias("est_pdo"), F.col("est_all").alias("est_inj"), F.col("est_t1").alias("est_fat"))
    return reports.predicted_crashes(t.crossings, model).select("crossing_id", "corridor", F.round("est_ann", 6).alias("est_ann"))


@query("""SELECT * FROM (SELECT a.crossing_id, a.corridor, a.street, COALESCE(r.total, 0) AS total FROM fx_crossings a
 LEFT JOIN fx_reports r ON a.crossing_id = r.crossing_id) b WHERE total > 0 ORDER BY total DESC, crossing_id""")
def pipe_blocked(t):
    return tables.sort_last(reports.blocked_reports(t.crossings, t.reports).where(F.col("total") > 0), "-total", "crossing_id")


@query("""SELECT total, COUNT(*) AS n FROM (SELECT COALESCE(r.total, 0) AS total FROM fx_crossings a
 LEFT JOIN fx_reports r ON a.crossing_id = r.crossing_id) b GROUP BY 1""")
def pipe_blocked_counts(t):
    return tables.count_by(reports.blocked_reports(t.crossings, t.reports), "total")


@query(f"""WITH {RECS_SQL} SELECT l.crossing_id, l.rec_num, l.recommendation, g.legend_order, g.legend_group,
 CAST(RANK() OVER (PARTITION BY g.legend_group ORDER BY g.legend_order) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY g.legend_group, g.legend_order) - 1) / 2.0 AS rank
 FROM long l JOIN legend g ON l.recommendation = g.recommendation""")
def pipe_recs(t):
    return reports.recommendation_ranks(t.recs)


@query(f"""WITH {RECS_SQL} SELECT recommendation, COUNT(*) FILTER (WHERE rec_num = 'rec_1') AS rec_1, COUNT(*) FILTER (WHERE rec_num = 'rec_2') AS rec_2,
 COUNT(*) FILTER (WHERE rec_num = 'rec_3') AS rec_3, COUNT(*) AS total FROM long GROUP BY 1""")
def pipe_recs_summary(t):
    return reports.recommendation_summary(t.recs)


@query(f"""WITH {ASSETS}, {ORDER_SQL} SELECT crossing_id, warn_dev, CAST("order" AS STRING) || ': ' || COALESCE(street, 'NA') || ' (' || CAST(crossing_id AS STRING) || ')' AS name
 FROM w WHERE warn_dev IS NULL OR warn_dev NOT IN ('FlashingOnly', 'Gates', 'GatesWithMedian')""")
def pipe_itinerary(t):
    listed = asset_plans.corridor_worksheet(assets(t), AXES, ORDER_FIXES)
    return reports.passive_itinerary(listed).select("crossing_id", "warn_dev", "name")


_LISTED = "listed AS (SELECT * FROM fx_sheet WHERE railroad IS NOT NULL AND (notes IS NULL OR notes <> 'Exclude'))"


@query(f"""WITH {_LISTED} SELECT i.crossing_id, i.iyr, i.veh_code, COUNT(*) AS n FROM fx_incidents i WHERE CAST(i.iyr AS INT) >= 96 AND i.crossing_id IN
 (SELECT crossing_id FROM listed WHERE corridor = 'Valley' AND (warn_dev IS NULL OR warn_dev NOT IN ('Gates', 'GatesWithMedian'))) GROUP BY 1, 2, 3""")
def pipe_passive_crash(t):
    return tables.count_by(reports.passive_crash_subset(t.incidents, t.sheet, 96, "Valley"), "crossing_id", "iyr", "veh_code")


@query(f"""WITH {_LISTED} SELECT corridor, railroad, COUNT(*) AS n FROM listed GROUP BY 1, 2""")
def pipe_sheet_railroads(t):
    return reports.railroads_by_corridor(t.sheet)


@query("""SELECT s.crossing_id, c.street, c.lon AS x, c.lat AS y, 0 AS review_status FROM fx_sheet s JOIN fx_crossings c ON s.crossing_id = c.crossing_id
 WHERE s.notes IS NULL AND s.field_review = 1 AND c.lon IS NOT NULL""")
def pipe_field(t):
    located = joins.key_join(t.sheet, t.crossings.select("crossing_id", "street", F.col("lon").alias("x"), F.col("lat").alias("y")), ["crossing_id"], "inner")
    return reports.field_review(located).select("crossing_id", "street", "x", "y", "review_status")
