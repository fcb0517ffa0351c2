"""Study products on small literal tables."""

from pyspark.sql import functions as F

from crosstie.geo.project import TM_92W30, project
from crosstie.plans import assets, closure, reports, risk

INVENTORY = ("crossing_id int, reason_id int, pos_xing int, type_xing int, purpose int, lon double, lat double, gate_conf string, "
             "gates string, channel string, flash string, stop_std string, yield_std string, xbuck string")


def test_base_projects_survey_coordinates(spark):
    devices = ("1", "2", None, "0", "0", "0", "0")
    inventory = spark.createDataFrame([
        (1, 14, 1, 3, 1, -92.0, 38.5, *devices),    # on the line
        (2, 14, 1, 3, None, None, None, *devices),  # placed by the survey
        (3, 16, 1, 3, 1, -92.0, 38.5, *devices),    # closed
        (4, 14, 1, 3, 1, -91.0, 38.5, *devices),    # far away
        (5, 14, 1, 3, 1, -92.0, 38.5, *devices),    # excluded
        (6, 14, 1, 3, 1, None, 38.5, *devices)], INVENTORY)  # cannot be placed
    survey = spark.createDataFrame([(2, "A", 10.0, 1.0, 2.0, 38.5, -92.0), (2, "B", 10.0, 1.0, None, 38.5, -92.0)],
                                   "crossing_id int, road string, aadt double, grade1 double, grade2 double, lat_survey double, lon_survey double")
    x, y = project(F.lit(-92.0), F.lit(38.5), TM_92W30)
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    rail = spark.createDataFrame([(1, 0, "Valley", at.x - 500, at.y + 10, at.x + 500, at.y + 10)],
                                 "line_id int, seq int, rail_corridor string, x1 double, y1 double, x2 double, y2 double")
    incidents = spark.createDataFrame([(1, "22", "1", "0"), (1, "10", None, "2"), (2, "09", "0", "0")],
                                      "crossing_id int, iyr string, killed string, injured string")
    exclusions = spark.createDataFrame([(5,)], "crossing_id int")
    base = assets.crossing_base(inventory, incidents, survey, rail, ("22", "21"), exclusions, "Harbor", grid=TM_92W30)
    found = sorted((r.crossing_id, r.pedestrian, r.warn_dev, r.survey_road, r.inc_tot_all, r.inc_fat_win) for r in base.collect())
    assert found == [(1, "No", "Gates", None, 2, 1), (2, None, "Gates", "A", 1, None), (2, None, "Gates", "B", 1, None)]
    rows = {(r.crossing_id, r.grade_change, r.inc_pdo_win) for r in assets.master_base(base.withColumn("subdiv_name", F.lit("A B")), []).collect()}
    assert rows == {(1, None, 0), (2, 3.0, 0), (2, None, 0)}


def test_worksheet_order_and_fix(spark):
    base = spark.createDataFrame([(i, "Valley", float(10 - i), 0.0) for i in range(4)], "crossing_id int, corridor string, x double, y double")
    sheet = assets.corridor_worksheet(base, {"Valley": "x"}, {("Valley", 1): 2, ("Valley", 2): 1})
    assert {r.crossing_id: (r.order, r.name) for r in sheet.collect()} == {
        3: (2, "Valley_2_3"), 2: (1, "Valley_1_2"), 1: (3, "Valley_3_1"), 0: (4, "Valley_4_0")}


def test_detour_per_vehicle(spark):
    routes = spark.createDataFrame([(1, "base", 2, 1000.0, 60.0), (1, "closure", 2, 5000.0, 300.0), (2, "base", 0, 1.0, 1.0),
                                    (2, "closure", 0, 2.0, 2.0)], "crossing_id int, scenario string, trips int, distance double, duration double")
    adt = spark.createDataFrame([(1, 100.0)], "crossing_id int, final_adt double")
    out = {r.crossing_id: r for r in closure.closure_detour(routes, adt).collect()}
    assert (out[1].extra_dist_per_veh, out[1].extra_dur_per_veh_min, out[1].ex_veh_hr) == (2000.0, 2.0, 3.33)
    assert out[2].extra_dist_per_veh is None and out[2].ex_veh_mi is None


TRACKS = "industry_trk int, main_trk int, siding_trk int, transit_trk int, yard_trk int"


def test_risk_effects_combine(spark):
    base = spark.createDataFrame([(1, 0, 1, 0, 0, 0), (2, 0, 1, 1, 0, 0), (3, 1, 1, 0, 0, None), (4, 1, 0, 0, 0, 1)], f"crossing_id int, {TRACKS}")
    sheet = spark.createDataFrame([
        (1, "Valley", None, "Crossbucks", "Gates; AFWS; Lighting", None, 5.0), (2, "Valley", "Exclude", "Gates", "Closure", None, 5.0),
        (3, None, None, "Crossbucks", "Closure", "Closure", 5.0), (4, "Valley", None, "FlashingOnly", "Gates", "Closure", 5.0)],
        "crossing_id int, corridor string, notes string, warn_dev string, all_desc string, tier1_desc string, daily_trains double")
    rows = {r.crossing_id: r for r in risk.risk_reduction(base, sheet).collect()}
    assert rows[1].cat_all == "pass_to_gates" and abs(rows[1].final_red_all - (1 - 0.25 * 0.95 * 0.95)) < 1e-12
    assert rows[1].cat_t1 == "pass_to_NA" and rows[1].base_red_t1 == 0.0 and rows[1].final_red_t1 is None
    # Out of scope: the asset stays, nothing of the sheet is taken over, its own notes neither.
    assert all(rows[i].all_desc is None and rows[i].corridor is None and rows[i].notes is None for i in (2, 3))
    assert (rows[4].tot_tracks, rows[4].base_red_all, rows[4].base_red_t1) == (2, 0.65, 1.0) and rows[3].tot_tracks is None


def test_passive_crashes_of_the_listed_sheet(spark):
    incidents = spark.createDataFrame([(1, "9"), (1, "18"), (2, "20"), (None, "20"), (3, "19"), (4, "20"), (5, "21"), (6, "22")], "crossing_id int, iyr string")
    sheet = spark.createDataFrame([(1, "A", "r", None, "Crossbucks"), (2, "A", "r", None, "Gates"), (3, "A", None, None, None),
                                   (4, "A", "r", "Exclude", None), (5, "B", "r", "Pedestrian", None), (6, "A", "s", "Pedestrian", None)],
                                  "crossing_id int, corridor string, railroad string, notes string, warn_dev string")
    found = lambda c: sorted((r.crossing_id, r.iyr) for r in reports.passive_crash_subset(incidents, sheet, 18, c).collect())
    assert found(None) == [(1, "18"), (5, "21"), (6, "22")] and found("A") == [(1, "18"), (6, "22")]
    assert {(r.corridor, r.railroad): r.n for r in reports.railroads_by_corridor(sheet).collect()} == {("A", "r"): 2, ("B", "r"): 1, ("A", "s"): 1}


def test_volumes_per_link_and_narratives_of_all_parts(spark):
    lines = spark.createDataFrame([(1, 7, "base", 3), (1, 7, "base", 4), (1, 7, "closure", 9), (1, 8, "closure", 2), (2, 7, "base", 1)],
                                  "crossing_id int, link_id int, scenario string, trips int")
    assert {(r.crossing_id, r.link_id): (r.base, r.closure, r.delta) for r in closure.scenario_volumes(lines).collect()} == {
        (1, 7): (7, 9, 2), (1, 8): (None, 2, None), (2, 7): (1, None, None)}
    assert closure.scenario_volumes(lines, crossing_id=2).count() == 1
    codes = ", ".join(f"{c} string" for c in ("iyr", "imo", "iday", "hr", "ampm", "mi", "veh_code", "pos_code", "mot_code", "killed", "injured"))
    crash = spark.createDataFrame([(1, *["1"] * 4, "AM", *["1"] * 6, "ON", None, "THE", "NARROW", "ROAD")],
                                  f"crossing_id int, {codes}, narr1 string, narr2 string, narr3 string, narr4 string, narr5 string")
    listed = spark.createDataFrame([(1, "A")], "crossing_id int, corridor string")
    assert reports.crash_summary(crash, listed).first().narrative == "ON THE NARROW ROAD"
    assert reports.crash_summary(crash, listed, literal=True).first().narrative == "ON THERROW ROAD"


def test_passenger_lines(spark):
    segments = spark.createDataFrame([(i, 0, 0.0, 0.0, 1.0, 1.0) for i in range(4)], "line_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    lines = spark.createDataFrame([(0, None, 1, "A"), (1, "M", 1, "C"), (2, "M", 1, None), (3, "O", 1, "A")], "line_id int, net string, subdiv int, passenger string")
    kept = lambda p: {r.line_id for r in assets.labelled_rail(segments, lines, {1: "x"}, passenger=p).collect()}
    assert kept("A") == {0} and kept(None) == {0, 1, 2}
