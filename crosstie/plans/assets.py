"""Asset tables: the public base, separations, private assets, worksheets.

Inputs are DataFrames with these columns (others pass through):
inventory ``crossing_id, reason_id, pos_xing, type_xing, purpose, lon, lat`` plus device
texts, ``x, y`` in grid metres; incidents ``crossing_id, iyr, killed, injured``; survey
``crossing_id, lon_survey, lat_survey, grade1, grade2, road, aadt``; rail segments
``line_id, rail_corridor, x1..y2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.functions import rules
from crosstie.functions.nulls import not_in_keep_null, paste
from crosstie.functions.text import title_case
from crosstie.geo.match import join_within, lines_near_lines, nearest_line, within_lines
from crosstie.geo.polygons import clip_lines, lines_near_polygons
from crosstie.geo.project import TM_92W30, TransverseMercator, project, unproject
from crosstie.geo.shapes import dissolve
from crosstie.operators.joins import anti, key_join, semi
from crosstie.operators.reshape import row_total, widen_counts
from crosstie.operators.windows import number_in_order

# Search distances in metres.
PUBLIC_DISTANCE = 50.0
SEPARATION_DISTANCE = 100.0
PRIVATE_JOIN_DISTANCE = 20.0
CONTEXT_DISTANCE = 2640.0
CONTEXT_NETWORK_DISTANCE = 100_000.0
OUT_OF_SERVICE_CLASSES = ("A", "O", "R", "T", "X")
CLOSED_REASON = 16


def incident_years(incidents: DataFrame) -> DataFrame:
    """Incidents per asset and year, one column per severity, zero-filled, with a total."""
    rated = incidents.withColumn("severity", rules.severity("killed", "injured"))
    wide = widen_counts(rated, ["crossing_id", "iyr"], "severity", rules.SEVERITIES)
    return row_total(wide, rules.SEVERITIES, "total")


def incident_history(incidents: DataFrame, window: Sequence[str]) -> DataFrame:
    """Totals per asset over all years and over the given years, in one aggregation.

    Assets without an incident in the window have missing window totals.
    """
    sev = rules.severity("killed", "injured")
    recent = F.coalesce(F.col("iyr").isin(*window), F.lit(False))
    in_window = F.count_if(recent)

    def counts(name: str, cond: Column) -> list[Column]:
        return [F.count_if(cond).alias(f"inc_{name}_all"),
                F.when(in_window > 0, F.count_if(cond & recent)).alias(f"inc_{name}_win")]

    return incidents.groupBy("crossing_id").agg(
        *counts("tot", F.lit(True)), *counts("fat", sev == "Fatal"), *counts("inj", sev == "Injury"))


def surveyed_inventory(inventory: DataFrame, survey: DataFrame) -> DataFrame:
    """Open assets with survey attributes, fallback coordinates and the device class."""
    side = survey.select("crossing_id", "lon_survey", "lat_survey", "grade1", "grade2",
                         F.col("road").alias("survey_road"), F.col("aadt").alias("survey_aadt"))
    joined = key_join(inventory.where(F.col("reason_id") != CLOSED_REASON), side, ["crossing_id"])
    return joined.withColumns({
        "lat": F.coalesce("lat", "lat_survey"), "lon": F.coalesce("lon", "lon_survey"),
        "warn_dev": rules.warning_device("gate_conf", "gates", "channel", "flash", "stop_std", "yield_std", "xbuck"),
    }).drop("lat_survey", "lon_survey")


def crossing_base(inventory: DataFrame, incidents: DataFrame, survey: DataFrame, rail: DataFrame,
                  window: Sequence[str], exclusions: DataFrame, skip_corridor: str,
                  distance: float = PUBLIC_DISTANCE, grid: TransverseMercator | None = None) -> DataFrame:
    """Public at-grade assets on the studied corridors with history, survey and device class.

    With ``grid`` the position is projected from the coordinates, the survey's where the
    inventory has none. Without it the inventory's ``x, y`` are used and the spatial step
    runs first, so that survey and history are joined to the few assets that remain. The
    within-distance filter and the nearest-corridor join are one pass.
    """
    public = inventory.where((F.col("pos_xing") == 1) & (F.col("type_xing") == 3))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if grid is None:
        on_line = surveyed_inventory(nearest_line(public, rail, distance, ["rail_corridor"]), survey).where(located)
    else:
        x, y = project("lon", "lat", grid)
        placed = surveyed_inventory(public, survey).where(located).withColumns({"x": x, "y": y})
        on_line = nearest_line(placed, rail, distance, ["rail_corridor"])
    kept = anti(on_line.where(F.col("rail_corridor") != skip_corridor), exclusions, ["crossing_id"])
    flagged = kept.withColumn("pedestrian", rules.pedestrian_flag("purpose"))
    return key_join(flagged, incident_history(incidents, window), ["crossing_id"])


def grade_separations(inventory: DataFrame, rail: DataFrame, skip_corridor: str,
                      distance: float = SEPARATION_DISTANCE) -> DataFrame:
    separated = inventory.where(F.col("pos_xing").isin(2, 3) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    near = nearest_line(separated, rail, distance, ["rail_corridor"])
    return (near.where(F.col("rail_corridor") != skip_corridor)
            .withColumn("position", rules.separation_position("pos_xing")))


def private_crossings(inventory: DataFrame, rail: DataFrame, skip_corridor: str,
                      distance: float = PUBLIC_DISTANCE, join_distance: float = PRIVATE_JOIN_DISTANCE,
                      at_grade_only: bool = False) -> DataFrame:
    """Private assets, one row per corridor line within the join distance."""
    private = inventory.where((F.col("type_xing") == 2) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if at_grade_only:
        private = private.where(F.col("pos_xing") == 1)
    # A line within the join distance is within the wider filter distance as well.
    near = private if join_distance <= distance else within_lines(private, rail, distance)
    joined = join_within(near, rail, join_distance, ["line_id", "rail_corridor"])
    return (joined.where(F.col("rail_corridor") != skip_corridor)
            .withColumn("pedestrian", rules.pedestrian_flag("purpose")))


def surveyed_subset(inventory: DataFrame, survey: DataFrame, skip_subdivisions: Sequence[str],
                    exclusions: DataFrame) -> DataFrame:
    """Assets in the survey with passenger trains, outside the listed subdivisions and ids."""
    listed = semi(inventory, survey, ["crossing_id"]).where(F.col("pass_cnt") > 0)
    return anti(listed.where(not_in_keep_null("subdiv_name", skip_subdivisions)), exclusions, ["crossing_id"])


def corridor_worksheet(base: DataFrame, axes: dict[str, str], fixes: dict[tuple[str, int], int],
                       corridor: str = "corridor", grid=TM_92W30) -> DataFrame:
    """Assets numbered along their corridor, with coordinates in degrees and a label.

    ``axes`` names the coordinate to follow per corridor; ``fixes`` moves single numbers
    where the track doubles back.
    """
    listed = base.where(F.col(corridor).isin(*axes) & F.col("x").isNotNull() & F.col("y").isNotNull())
    pos = rules.choose([(F.col(corridor) == name, F.col(axis)) for name, axis in axes.items()])
    numbered = number_in_order(listed.withColumn("_pos", pos), [corridor],
                               [F.col("_pos"), F.col("crossing_id")], "order").drop("_pos")
    order = rules.choose([((F.col(corridor) == c) & (F.col("order") == o), n) for (c, o), n in fixes.items()],
                         F.col("order")) if fixes else F.col("order")
    lon, lat = unproject("x", "y", grid)
    return numbered.withColumns({"order": order, "lon": lon, "lat": lat}).withColumn(
        "name", paste(corridor, F.lit("_"), "order", F.lit("_"), "crossing_id"))


def corridor_breakdown(base: DataFrame, corridor: str = "rail_corridor") -> DataFrame:
    """Per corridor and device group: assets, and those with fatal, injury or damage-only history."""
    damage_only = F.col("inc_tot_win") - F.col("inc_fat_win") - F.col("inc_inj_win")
    return base.groupBy(F.col(corridor).alias("corridor"), rules.device_group("warn_dev").alias("device_group")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("inc_fat_win") > 0).alias("n_fatal"),
        F.count_if(F.col("inc_inj_win") > 0).alias("n_injury"), F.count_if(damage_only > 0).alias("n_pdo"))


def master_base(base: DataFrame, own: Sequence[str] = ("milepost", "railroad", "max_speed", "hwy_speed")) -> DataFrame:
    """Export table: own columns of the asset, title-cased subdivision, zero-filled history, damage-only count, grade change."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("inc_fat_win", "inc_inj_win", "inc_tot_win")}
    return base.withColumns(zero).select(
        "crossing_id", *own, title_case("subdiv_name").alias("subdiv_name"), "inc_fat_win", "inc_inj_win",
        (F.col("inc_tot_win") - F.col("inc_fat_win") - F.col("inc_inj_win")).alias("inc_pdo_win"),
        "inc_tot_win", (F.col("grade1") + F.col("grade2")).alias("grade_change"))


def labelled_rail(segments: DataFrame, lines: DataFrame, corridors: dict[int, str],
                  skip_classes: Sequence[str] = OUT_OF_SERVICE_CLASSES, passenger: str | None = None) -> DataFrame:
    """Segments of lines in service with their corridor, through a constant subdivision table.

    ``passenger`` keeps the lines with this passenger operator only; a missing one is another.
    """
    if passenger is not None:
        lines = lines.where(F.col("passenger") == passenger)
    open_lines = lines.where(not_in_keep_null("net", skip_classes)).withColumn(
        "rail_corridor", rules.decode(F.col("subdiv"), corridors))
    return key_join(segments, open_lines.select("line_id", "net", "rail_corridor"), ["line_id"], "inner")


def rail_network(segments: DataFrame, lines: DataFrame, edges: DataFrame, corridors: dict[int, str],
                 passenger: str | None = None, poly: str = "poly_id") -> DataFrame:
    """Lines in service (of one passenger operator, if named) clipped to the area, with their corridor."""
    rail = labelled_rail(segments, lines, corridors, passenger=passenger)
    clipped = clip_lines(rail, edges, ["line_id", "seq"], poly)
    return key_join(clipped, lines.select("line_id", "net", rules.decode(F.col("subdiv"), corridors).alias("rail_corridor")),
                    ["line_id"], "inner")


def context_network(segments: DataFrame, lines: DataFrame, edges: DataFrame,
                    distance: float = CONTEXT_NETWORK_DISTANCE) -> DataFrame:
    """Lines in service near the area, merged into one set of segments."""
    open_lines = lines.where(not_in_keep_null("net", OUT_OF_SERVICE_CLASSES))
    rail = semi(segments, open_lines, ["line_id"])
    near = lines_near_polygons(rail, edges, distance)
    return dissolve(semi(rail, near, ["line_id"]))


def proximity_context(rail: DataFrame, segments: DataFrame, lines: DataFrame, assets: DataFrame,
                      distance: float = CONTEXT_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """Lines and assets around the corridor."""
    return (lines_near_lines(lines, segments, rail, distance), within_lines(assets, rail, distance))
