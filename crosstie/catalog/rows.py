"""Projections, filters, classifiers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie.catalog.registry import query
from crosstie.catalog.sqltext import (
    ASSETS, EXISTING, GROUP, PASSIVE, PEDESTRIAN, SEVERITY, SKIP_SUBDIVISIONS, device, in_list,
)
from crosstie.functions import measures, nulls, rules, text
from crosstie.operators import joins, tables
from crosstie.plans import closure, risk


def assets(t):
    """Inventory with device class and pedestrian flag."""
    return t.crossings.withColumns({
        "warn_dev": rules.warning_device("gate_conf", "gates", "channel", "flash", "stop_std", "yield_std", "xbuck"),
        "pedestrian": rules.pedestrian_flag("purpose")})


# Projections ---------------------------------------------------------------

@query("SELECT crossing_id, street AS road_name, pass_cnt AS trains, lon AS x_deg, lat AS y_deg FROM fx_crossings")
def prj_rename(t):
    return t.crossings.select("crossing_id", F.col("street").alias("road_name"), F.col("pass_cnt").alias("trains"),
                              F.col("lon").alias("x_deg"), F.col("lat").alias("y_deg"))


@query("SELECT crossing_id, tier1cost, tier2cost, tier1ben, tier2ben FROM fx_bcr")
def prj_drop(t):
    return t.bcr.drop("tier1desc", "tier2desc")


@query("""SELECT ingest_seq, o_id AS o_zone_id, o_name AS o_zone_name, d_id AS d_zone_id, d_name AS d_zone_name,
 od_vol AS stl, o_total, d_total, day_type, day_part FROM fx_od""")
def prj_rename_map(t):
    return t.od.withColumnsRenamed({"o_id": "o_zone_id", "o_name": "o_zone_name", "d_id": "d_zone_id",
                                    "d_name": "d_zone_name", "od_vol": "stl"})


@query("SELECT crossing_id, adt AS final_adt_v2, daily_trains, est_before AS est_1_yr_incidents FROM fx_sheet")
def prj_clean_names(t):
    raw = t.sheet.select(F.col("crossing_id").alias("CrossingID"), F.col("adt").alias("Final ADT V2"),
                         F.col("daily_trains").alias("Daily Trains"), F.col("est_before").alias("Est 1-yr Incidents"))
    return tables.with_clean_names(raw)


@query("""SELECT crossing_id, grade1 + grade2 AS grade_change, ROUND(aadt / 1000, 6) AS aadt_k FROM fx_survey""")
def prj_transmute(t):
    return t.survey.select("crossing_id", (F.col("grade1") + F.col("grade2")).alias("grade_change"),
                           F.round(F.col("aadt") / 1000, 6).alias("aadt_k"))


@query("SELECT crossing_id, '' AS text, 0 AS review_status FROM fx_sheet")
def prj_const(t):
    return t.sheet.select("crossing_id", F.lit("").alias("text"), F.lit(0).alias("review_status"))


@query("""SELECT c.crossing_id, COALESCE(c.lon, s.lon_survey) AS lon, COALESCE(c.lat, s.lat_survey) AS lat
 FROM fx_crossings c LEFT JOIN fx_survey s ON c.crossing_id = s.crossing_id""")
def prj_fallback(t):
    joined = joins.key_join(t.crossings, t.survey, ["crossing_id"])
    return joined.select("crossing_id", F.coalesce("lon", "lon_survey").alias("lon"),
                         F.coalesce("lat", "lat_survey").alias("lat"))


@query("""SELECT ingest_seq, CASE WHEN o_id IS NULL THEN o_name ELSE d_name END AS gate,
 CASE WHEN o_id IS NULL THEN d_id ELSE o_id END AS link_id,
 CASE WHEN o_id IS NULL THEN o_total ELSE d_total END AS gate_total FROM fx_od""")
def prj_role_swap(t):
    return closure.gate_side(t.od).select("ingest_seq", "gate", "link_id", "gate_total")


@query("""SELECT crossing_id, CASE crossing_id WHEN 3 THEN 2 WHEN 8 THEN 0 ELSE pass_cnt END AS pass_cnt,
 CASE crossing_id WHEN 5 THEN 'Good option' WHEN 6 THEN 'Not viable' ELSE '' END AS note FROM fx_crossings""")
def prj_override(t):
    noted = t.crossings.select("crossing_id", "pass_cnt", F.lit("").alias("note"))
    fixed = joins.override(noted, "crossing_id", {3: 2, 8: 0}, "pass_cnt")
    return joins.override(fixed, "crossing_id", {5: "Good option", 6: "Not viable"}, "note")


@query("SELECT DISTINCT subdiv_name FROM fx_crossings")
def prj_distinct(t):
    return t.crossings.select("subdiv_name").distinct()


# Filters -------------------------------------------------------------------

@query("""SELECT crossing_id, reason_id, lon FROM fx_crossings
 WHERE reason_id <> 16 AND lon IS NOT NULL AND pos_xing = 1""")
def flt_compare(t):
    return t.crossings.where((F.col("reason_id") != 16) & F.col("lon").isNotNull() & (F.col("pos_xing") == 1)).select(
        "crossing_id", "reason_id", "lon")


@query("SELECT crossing_id, pos_xing FROM fx_crossings WHERE pos_xing IN (2, 3)")
def flt_in(t):
    return t.crossings.where(F.col("pos_xing").isin(2, 3)).select("crossing_id", "pos_xing")


@query(f"""SELECT crossing_id, subdiv_name FROM fx_crossings
 WHERE subdiv_name IS NULL OR subdiv_name NOT IN {in_list(SKIP_SUBDIVISIONS)}""")
def flt_not_in_keep_null(t):
    return t.crossings.where(nulls.not_in_keep_null("subdiv_name", SKIP_SUBDIVISIONS)).select("crossing_id", "subdiv_name")


@query("""SELECT crossing_id, notes FROM fx_sheet
 WHERE notes IS NULL OR NOT regexp_matches(notes, 'Pedestrian|Exclude')""")
def flt_regex_keep_null(t):
    return t.sheet.where(nulls.missing_or_not_matching("notes", "Pedestrian|Exclude")).select("crossing_id", "notes")


@query("SELECT ingest_seq, day_type, day_part, od_vol FROM fx_od WHERE day_type = 'all' AND day_part = 'all day'")
def flt_period(t):
    return closure.whole_period(t.od).select("ingest_seq", "day_type", "day_part", "od_vol")


# Classifiers ---------------------------------------------------------------

@query(f"SELECT {SEVERITY} AS severity, iyr, COUNT(*) AS n FROM fx_incidents GROUP BY 1, 2")
def cls_severity(t):
    return tables.count_by(t.incidents.withColumn("severity", rules.severity("killed", "injured")), "severity", "iyr")


@query(f"SELECT crossing_id, {device()} AS warn_dev FROM fx_crossings")
def cls_warning_device(t):
    return assets(t).select("crossing_id", "warn_dev")


@query(f"WITH {ASSETS} SELECT crossing_id, {GROUP} AS device_group FROM assets")
def cls_device_group(t):
    return assets(t).select("crossing_id", rules.device_group("warn_dev").alias("device_group"))


@query("""SELECT crossing_id, CASE WHEN pos_xing = 2 THEN 'RR Under' WHEN pos_xing <> 2 THEN 'RR Over' END AS position
 FROM fx_crossings WHERE pos_xing IN (2, 3)""")
def cls_position(t):
    return t.crossings.where(F.col("pos_xing").isin(2, 3)).select(
        "crossing_id", rules.separation_position("pos_xing").alias("position"))


@query(f"SELECT crossing_id, {PEDESTRIAN} AS pedestrian FROM fx_crossings")
def cls_pedestrian(t):
    return t.crossings.select("crossing_id", rules.pedestrian_flag("purpose").alias("pedestrian"))


@query(f"""WITH {ASSETS} SELECT crossing_id, CASE WHEN pedestrian = 'Yes' THEN 'Pedestrian'
 WHEN warn_dev IN {PASSIVE} THEN 'passive' ELSE 'active' END AS passive_cat FROM assets""")
def cls_passive(t):
    return assets(t).select("crossing_id", rules.passive_category("pedestrian", "warn_dev").alias("passive_cat"))


@query(f"WITH {ASSETS} SELECT crossing_id, {EXISTING} AS existing FROM assets")
def cls_existing(t):
    return assets(t).select("crossing_id", rules.existing_class("warn_dev").alias("existing"))


RISK_FIXES = {7: "pass_to_FL"}


def _proposed(c: str) -> str:
    return (f"CASE WHEN {c} = 'Closure' THEN 'closure' WHEN regexp_matches({c}, 'Grade Separation') THEN 'grade_sep' "
            f"WHEN regexp_matches({c}, 'Security Gates') THEN 'gates' WHEN regexp_matches({c}, 'Gates|AFWS|Lighting|Other') THEN 'gates' "
            f"WHEN regexp_matches({c}, 'Public-to') THEN 'priv' WHEN regexp_matches({c}, 'None') THEN existing END")


def _category(tag: str) -> str:
    return (f"CASE WHEN crossing_id = 7 THEN 'pass_to_FL' WHEN regexp_matches(change_{tag}, 'closure') THEN 'closure' "
            f"WHEN regexp_matches(change_{tag}, 'grade_sep') THEN 'grade_sep' WHEN existing = new_{tag} THEN 'None' ELSE change_{tag} END")


def _base_red(tag: str) -> str:
    c, n, k = f"cat_{tag}", "daily_trains", "tot_tracks"
    tier1 = f"WHEN regexp_matches(change_{tag}, 'to_NA') THEN 0.0" if tag == "t1" else ""
    return f"""CAST(CASE WHEN {c} IN ('closure', 'grade_sep') THEN 1.0 WHEN {c} = 'None' THEN 0.0
 WHEN {c} = 'pass_to_gates' AND {n} <= 10 AND {k} <= 1 THEN 0.75 WHEN {c} = 'pass_to_gates' AND {n} <= 10 AND {k} > 1 THEN 0.86
 WHEN {c} = 'pass_to_gates' AND {n} > 10 AND {k} <= 1 THEN 0.80 WHEN {c} = 'pass_to_gates' AND {n} > 10 AND {k} > 1 THEN 0.78
 WHEN {c} = 'FL_to_gates' AND {n} <= 10 AND {k} <= 1 THEN 0.89 WHEN {c} = 'FL_to_gates' AND {n} <= 10 AND {k} > 1 THEN 0.65
 WHEN {c} = 'FL_to_gates' AND {n} > 10 AND {k} <= 1 THEN 0.69 WHEN {c} = 'FL_to_gates' AND {n} > 10 AND {k} > 1 THEN 0.63
 WHEN {c} = 'pass_to_FL' THEN 0.75 WHEN {c} = 'pass_to_priv' THEN 0.0 {tier1} ELSE 99.0 END AS DOUBLE)"""


def _effect(c: str, word: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{word}') THEN CAST(0.05 AS DOUBLE) WHEN NOT regexp_matches({c}, '{word}') THEN CAST(0 AS DOUBLE) END"


RISK_SQL = f"""WITH {ASSETS},
r0 AS (SELECT a.crossing_id, a.industry_trk + a.main_trk + a.siding_trk + a.transit_trk + a.yard_trk AS tot_tracks, s.* EXCLUDE (crossing_id),
  {EXISTING.replace('warn_dev', 's.warn_dev')} AS existing
 FROM assets a LEFT JOIN (SELECT * FROM fx_sheet WHERE corridor IS NOT NULL AND notes IS NULL) s ON a.crossing_id = s.crossing_id),
r1 AS (SELECT *, {_proposed('all_desc')} AS new_all, {_proposed('tier1_desc')} AS new_t1 FROM r0),
r2 AS (SELECT *, existing || '_to_' || COALESCE(new_all, 'NA') AS change_all, existing || '_to_' || COALESCE(new_t1, 'NA') AS change_t1 FROM r1),
r3 AS (SELECT *, {_category('all')} AS cat_all, {_category('t1')} AS cat_t1 FROM r2),
r4 AS (SELECT *, {_base_red('all')} AS base_red_all, {_base_red('t1')} AS base_red_t1 FROM r3)"""


def _risk(t):
    return risk.risk_reduction(assets(t), t.sheet, RISK_FIXES)


@query(RISK_SQL + " SELECT crossing_id, existing, new_all, new_t1 FROM r4")
def cls_treatment(t):
    return _risk(t).select("crossing_id", "existing", "new_all", "new_t1")


@query(RISK_SQL + " SELECT crossing_id, change_all, cat_all, change_t1, cat_t1 FROM r4")
def cls_change(t):
    return _risk(t).select("crossing_id", "change_all", "cat_all", "change_t1", "cat_t1")


@query(RISK_SQL + """ SELECT crossing_id, base_red_all, base_red_t1, base_red_all = 99 AS unclassified_all,
 base_red_t1 = 99 AS unclassified_t1 FROM r4""")
def cls_base_risk(t):
    return _risk(t).select("crossing_id", "base_red_all", "base_red_t1", "unclassified_all", "unclassified_t1")


@query(RISK_SQL + f""" SELECT crossing_id, corridor, warn_dev, tot_tracks, cat_all, cat_t1, base_red_all, base_red_t1,
 ROUND(1 - (1 - base_red_all) * (1 - {_effect('all_desc', 'AFWS')}) * (1 - {_effect('all_desc', 'Lighting')}), 6) AS final_red_all,
 ROUND(1 - (1 - base_red_t1) * (1 - {_effect('tier1_desc', 'AFWS')}) * (1 - {_effect('tier1_desc', 'Lighting')}), 6) AS final_red_t1 FROM r4""")
def pipe_risk(t):
    return _risk(t).select("crossing_id", "corridor", "warn_dev", "tot_tracks", "cat_all", "cat_t1", "base_red_all",
                           "base_red_t1", F.round("final_red_all", 6).alias("final_red_all"),
                           F.round("final_red_t1", 6).alias("final_red_t1"))


VEHICLE = ("CASE veh_code WHEN 'A' THEN 'Auto' WHEN 'B' THEN 'Truck' WHEN 'C' THEN 'Truck-Trailer' WHEN 'D' THEN 'Pickup Truck' "
           "WHEN 'E' THEN 'Van' WHEN 'K' THEN 'Pedestrian' ELSE 'Other' END")
POSITION = ("CASE pos_code WHEN '1' THEN 'Stalled/Stuck on Crossing' WHEN '2' THEN 'Stopped on Crossing' "
            "WHEN '3' THEN 'Moving over Crossing' WHEN '5' THEN 'Blocked by Crossing Gates' END")
MOTORIST = ("CASE mot_code WHEN '1' THEN 'Went Around Gates' WHEN '3' THEN 'Did Not Stop' WHEN '4' THEN 'Stopped on Crossing' "
            "WHEN '5' THEN 'Other' WHEN '7' THEN 'Went Through Gate' END")


@query(f"""SELECT {VEHICLE} AS vehicle, {POSITION} AS position, {MOTORIST} AS motorist, COUNT(*) AS n
 FROM fx_incidents GROUP BY 1, 2, 3""")
def cls_decode(t):
    coded = t.incidents.select(
        rules.decode("veh_code", rules.VEHICLE_CODES, "Other").alias("vehicle"),
        rules.decode("pos_code", rules.POSITION_CODES).alias("position"),
        rules.decode("mot_code", rules.MOTORIST_CODES).alias("motorist"))
    return tables.count_by(coded, "vehicle", "position", "motorist")


LEGEND = ("CASE WHEN {c} IN ('Advanced flashing warning signs', 'Lighting', 'Signing and pavement markings') THEN '1: Universal' "
          "WHEN {c} = 'Upgrade with gates and lights' THEN '2: Gates and Lights' WHEN {c} = 'Closure' THEN '3: Closure' "
          "WHEN {c} = 'Grade Separation' THEN '4: Grade Separation' ELSE '5: Other' END")


@query(f"""SELECT crossing_id, {LEGEND.format(c='rec_1')} AS group_1, {LEGEND.format(c='rec_2')} AS group_2,
 {LEGEND.format(c='rec_3')} AS group_3 FROM fx_recs""")
def cls_legend(t):
    return t.recs.select("crossing_id", *[rules.legend_group(f"rec_{i}").alias(f"group_{i}") for i in (1, 2, 3)])


@query("""SELECT crossing_id, CASE WHEN regexp_matches(all_desc, 'Clos|Grade Sep') THEN 0.0 ELSE total_trains * adt END AS exp_all,
 CASE WHEN regexp_matches(tier1_desc, 'Clos|Grade Sep') THEN 0.0 ELSE total_trains * adt END AS exp_t1 FROM fx_sheet""")
def cls_exposure(t):
    exposure = F.col("total_trains") * F.col("adt")
    return t.sheet.select("crossing_id", rules.exposure_after("all_desc", exposure).alias("exp_all"),
                          rules.exposure_after("tier1_desc", exposure).alias("exp_t1"))


def flag_sql(c: str, word: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{word}') THEN 1 WHEN NOT regexp_matches({c}, '{word}') THEN 0 END"


@query("SELECT crossing_id, " + ", ".join(f"{flag_sql('tier1_desc', w)} AS {n}" for n, w in rules.TREATMENT_FLAGS.items())
       + f", {flag_sql('tier1_desc', 'Gates')} - {flag_sql('tier1_desc', 'Security')} AS gates FROM fx_sheet")
def cls_flags(t):
    flags = rules.treatment_flags("tier1_desc", with_gates=True)
    return t.sheet.select("crossing_id", *[c.alias(n) for n, c in flags.items()])


# Scalar functions ----------------------------------------------------------

@query("""SELECT crossing_id, TRY_CAST(gates AS DOUBLE) AS gates, TRY_CAST(tier AS DOUBLE) AS tier FROM
 (SELECT c.crossing_id, c.gates, b.tier1ben AS tier FROM fx_crossings c LEFT JOIN fx_bcr b ON c.crossing_id = b.crossing_id) j""")
def fn_try_number(t):
    joined = joins.key_join(t.crossings.select("crossing_id", "gates"), t.bcr.select("crossing_id", F.col("tier1ben").alias("tier")),
                            ["crossing_id"])
    return joined.select("crossing_id", nulls.to_number("gates").alias("gates"), nulls.to_number("tier").alias("tier"))


@query("SELECT crossing_id, COALESCE(siding_trk, 0) AS siding_trk, COALESCE(corridor, 'none') AS corridor FROM fx_crossings")
def fn_fill(t):
    return t.crossings.select("crossing_id", F.coalesce("siding_trk", F.lit(0)).alias("siding_trk"),
                              F.coalesce("corridor", F.lit("none")).alias("corridor"))


@query("""SELECT crossing_id, COALESCE(corridor, 'NA') || '_' || CAST(crossing_id AS STRING) AS label,
 COALESCE(subdiv_name, 'NA') || ' / ' || COALESCE(channel, 'NA') AS place FROM fx_crossings""")
def fn_label(t):
    return t.crossings.select("crossing_id", nulls.paste("corridor", F.lit("_"), "crossing_id").alias("label"),
                              nulls.paste("subdiv_name", "channel", sep=" / ").alias("place"))


@query("SELECT crossing_id, regexp_matches(all_desc, 'Gates|AFWS') AS has_gates, regexp_matches(tier1_desc, 'Clos') AS closes FROM fx_sheet")
def fn_detect(t):
    return t.sheet.select("crossing_id", F.col("all_desc").rlike("Gates|AFWS").alias("has_gates"),
                          F.col("tier1_desc").rlike("Clos").alias("closes"))


@query("""SELECT c_custkey, regexp_extract('key=' || chr(39) || c_name || chr(39), '''(.*?)''', 1) AS name FROM customer""")
def fn_extract(t):
    quoted = F.concat(F.lit("key='"), F.col("c_name"), F.lit("'"))
    return t.source("customer").select("c_custkey", F.regexp_extract(quoted, "(?<=').*?(?=')", 0).alias("name"))


@query("""SELECT concat_ws(' ', narr1, narr2) AS narrative,
 REPLACE(COALESCE(narr1, 'NA') || ' ' || COALESCE(narr2, 'NA'), ' NA', '') AS literal, COUNT(*) AS n FROM fx_incidents GROUP BY 1, 2""")
def fn_narrative(t):
    merged = t.incidents.select(text.narrative("narr1", "narr2").alias("narrative"),
                                text.narrative("narr1", "narr2", literal=True).alias("literal"))
    return tables.count_by(merged, "narrative", "literal")


@query("""SELECT crossing_id, array_to_string(list_transform(regexp_extract_all(subdiv_name, '([a-zA-Z]+|[^a-zA-Z]+)'),
 lambda p: upper(p[1]) || lower(p[2:])), '') AS subdiv_name FROM fx_crossings""")
def fn_title(t):
    return t.crossings.select("crossing_id", text.title_case("subdiv_name").alias("subdiv_name"))


@query("SELECT crossing_id, substr('tier1desc_' || CAST(crossing_id AS STRING), 1, 5) AS tier, substr(street, 1, 5) AS street5 FROM fx_crossings")
def fn_prefix(t):
    return t.crossings.select("crossing_id", text.prefix(F.concat(F.lit("tier1desc_"), F.col("crossing_id").cast("string")), 5).alias("tier"),
                              text.prefix("street", 5).alias("street5"))


@query("""SELECT crossing_id, round_even((adt + 0.5) / 2, 0) AS half, round_even((adt + 1) / 8, 2) AS eighth FROM fx_sheet""")
def fn_round(t):
    return t.sheet.select("crossing_id", measures.half_even((F.col("adt") + 0.5) / 2).alias("half"),
                          measures.half_even((F.col("adt") + 1) / 8, 2).alias("eighth"))


CRASH_HOUR = "CASE WHEN ampm = 'PM' AND CAST(hr AS INT) < 12 THEN CAST(hr AS INT) + 12 ELSE CAST(hr AS INT) END"
CRASH_TIME = (f"TRY_CAST(CAST(2000 + CAST(iyr AS INT) AS STRING) || '-' || lpad(imo, 2, '0') || '-' || lpad(iday, 2, '0') || ' ' || "
              f"lpad(CAST({CRASH_HOUR} AS STRING), 2, '0') || ':' || lpad(mi, 2, '0') || ':00' AS TIMESTAMP)")


@query(f"SELECT {CRASH_TIME} AS crash_time, {CRASH_HOUR} AS hour24, COUNT(*) AS n FROM fx_incidents GROUP BY 1, 2")
def fn_crash_time(t):
    hour = measures.hour_24("hr", "ampm")
    timed = t.incidents.select(measures.crash_timestamp("iyr", "imo", "iday", hour, "mi").alias("crash_time"),
                               hour.alias("hour24"))
    return tables.count_by(timed, "crash_time", "hour24")


@query("""SELECT crossing_id, scenario, ROUND(duration / 3600, 6) AS hours, ROUND(distance / 1609.34, 4) AS miles,
 ROUND(distance / 2.59e6, 8) AS square_miles FROM fx_routes""")
def fn_units(t):
    return t.routes.select("crossing_id", "scenario", F.round(measures.seconds_to_hours("duration"), 6).alias("hours"),
                           F.round(measures.metres_to_miles("distance"), 4).alias("miles"),
                           F.round(measures.square_metres_to_square_miles("distance"), 8).alias("square_miles"))


@query("""SELECT c.crossing_id, c.main_trk + c.siding_trk AS tot_tracks, s.grade1 + s.grade2 AS grade_change
 FROM fx_crossings c LEFT JOIN fx_survey s ON c.crossing_id = s.crossing_id""")
def fn_totals(t):
    joined = joins.key_join(t.crossings, t.survey, ["crossing_id"])
    return joined.select("crossing_id", nulls.total("main_trk", "siding_trk").alias("tot_tracks"),
                         nulls.total("grade1", "grade2").alias("grade_change"))


@query("""SELECT crossing_id, ROUND(1 - (1 - est_before) * (1 - est_all) * (1 - CASE WHEN regexp_matches(tier1_desc, 'Lighting') THEN 0.05
 WHEN NOT regexp_matches(tier1_desc, 'Lighting') THEN 0.0 END), 6) AS combined FROM fx_sheet""")
def fn_combine(t):
    light = nulls.if_else(F.col("tier1_desc").rlike("Lighting"), F.lit(0.05), F.lit(0.0))
    return t.sheet.select("crossing_id", F.round(measures.combine_effects("est_before", "est_all", light), 6).alias("combined"))


@query("SELECT crossing_id, total_trains * adt AS exp_ind FROM fx_sheet")
def fn_exposure(t):
    return t.sheet.select("crossing_id", (F.col("total_trains") * F.col("adt")).alias("exp_ind"))


@query("SELECT crossing_id, COALESCE(grade1, 0) AS grade1, COALESCE(grade2, 0) AS grade2 FROM fx_survey")
def fn_across(t):
    zero = nulls.across(["grade1", "grade2"], lambda c: F.coalesce(c, F.lit(0.0)))
    return t.survey.withColumns(zero).select("crossing_id", "grade1", "grade2")
