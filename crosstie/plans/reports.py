"""Crash, blocked-asset, volume, benefit-cost and recommendation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.functions import rules
from crosstie.functions.measures import crash_timestamp, hour_24
from crosstie.functions.nulls import not_in_keep_null, paste, ratio, to_integer, to_number
from crosstie.functions.text import narrative, prefix
from crosstie.geo.match import attach, neighbours_by_position
from crosstie.geo.polygons import areal_density, join_polygons
from crosstie.geo.shapes import locations
from crosstie.operators.joins import key_join, spread_join
from crosstie.operators.reshape import lengthen, row_total, widen_counts
from crosstie.operators.tables import count_by, log_histogram
from crosstie.operators.windows import average_rank, keep_group_min, number_in_order

REC_COLUMNS = ("rec_1", "rec_2", "rec_3")
NARRATIVE_PARTS = ("narr1", "narr2", "narr3", "narr4", "narr5")


def crash_summary(incidents: DataFrame, assets: DataFrame, parts: Sequence[str] = NARRATIVE_PARTS, literal: bool = False) -> DataFrame:
    """Decoded incidents of the studied assets with corridor, time and narrative.

    Incidents per asset can be very uneven: a small asset table is broadcast, else the
    join deals busy assets out.
    """
    joined = spread_join(incidents, assets.select("crossing_id", "corridor"), ["crossing_id"], "inner")
    return joined.select(
        "crossing_id", "corridor",
        crash_timestamp("iyr", "imo", "iday", hour_24("hr", "ampm"), "mi").alias("crash_time"),
        rules.decode("veh_code", rules.VEHICLE_CODES, "Other").alias("vehicle"),
        rules.decode("pos_code", rules.POSITION_CODES).alias("position"),
        rules.decode("mot_code", rules.MOTORIST_CODES).alias("motorist"),
        rules.severity("killed", "injured").alias("severity"),
        narrative(*parts, literal=literal).alias("narrative"))


def crashes_by(crashes: DataFrame, what: str, corridors: Sequence[str]) -> DataFrame:
    """Crash counts by one attribute and corridor, other corridors as ``rest``; combinations that do not occur stay missing."""
    return widen_counts(crashes, [what], "corridor", corridors, fill=False, rest="rest")


def predicted_crashes(assets: DataFrame, model: DataFrame) -> DataFrame:
    total = F.col("est_pdo") + F.col("est_inj") + F.col("est_fat")
    return key_join(assets.select("crossing_id", "corridor"), model.withColumn("est_ann", total), ["crossing_id"])


def blocked_reports(assets: DataFrame, reports: DataFrame) -> DataFrame:
    """Report counts for every asset, 0 where there is none."""
    return key_join(assets.select("crossing_id", "corridor", "street"), reports, ["crossing_id"]).fillna(0, ["total"])


def mode_volumes(volumes: DataFrame, modes: Sequence[str], bins_per_decade: int = 10) -> DataFrame:
    """Log-scale volume histogram per mode."""
    long = lengthen(volumes.select(*modes), modes, "mode", "volume")
    return log_histogram(long, ["mode"], "volume", bins_per_decade)


def tiered(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """Wide tier columns to long under a composite id (asset, tier)."""
    long = lengthen(df.select("crossing_id", *cols), cols, "name", value)
    return long.select(paste("crossing_id", prefix("name", 5), sep="_").alias("bc_id"), value)


def benefit_cost(benefits: DataFrame, costs: DataFrame, benefit_cols: Sequence[str], desc_cols: Sequence[str],
                 cost_cols: Sequence[str]) -> DataFrame:
    """Benefit-cost ratio per described tier; a zero cost or unreadable benefit gives no ratio."""
    described = tiered(costs, desc_cols, "description").where(F.col("description").isNotNull())
    joined = key_join(described, tiered(costs, cost_cols, "cost"), ["bc_id"])
    joined = key_join(joined, tiered(benefits, benefit_cols, "benefit"), ["bc_id"])
    return (joined.withColumn("benefit", to_number("benefit"))
            .withColumn("ratio", ratio("benefit", "cost")))


def recommendations_long(recs: DataFrame, cols: Sequence[str] = REC_COLUMNS) -> DataFrame:
    return lengthen(recs.select("crossing_id", *cols), cols, "rec_num", "recommendation", drop_null=True)


def recommendation_legend(long: DataFrame) -> DataFrame:
    """Per recommendation: count, legend position (rarest first, steps of ten) and legend group."""
    counts = count_by(long, "recommendation")
    ordered = number_in_order(counts, [], [F.col("n"), F.col("recommendation")], "legend_order")
    return ordered.withColumns({"legend_order": F.col("legend_order") * 10,
                                "legend_group": rules.legend_group("recommendation")})


def recommendation_summary(recs: DataFrame, cols: Sequence[str] = REC_COLUMNS) -> DataFrame:
    """Recommendations by priority column, zero-filled, with a total."""
    wide = widen_counts(recommendations_long(recs, cols), ["recommendation"], "rec_num", cols)
    return row_total(wide, cols, "total")


def recommendation_ranks(recs: DataFrame) -> DataFrame:
    """Every recommendation with its legend data and its tie-averaged rank inside the legend group."""
    long = recommendations_long(recs)
    legend = recommendation_legend(long).drop("n")
    placed = spread_join(long, legend, ["recommendation"], row_key=["crossing_id", "rec_num"])
    return average_rank(placed, ["legend_group"], "legend_order", "rank")


def passive_itinerary(assets: DataFrame) -> DataFrame:
    """Assets without active warning, with a visit label."""
    passive = assets.where(not_in_keep_null("warn_dev", ("FlashingOnly", "Gates", "GatesWithMedian")))
    return passive.withColumn("name", paste("order", F.lit(": "), "street", F.lit(" ("), "crossing_id", F.lit(")")))


def listed_sheet(sheet: DataFrame) -> DataFrame:
    """Rows of the master sheet with a railroad that are not excluded."""
    return sheet.where(F.col("railroad").isNotNull() & not_in_keep_null("notes", ("Exclude",)))


def railroads_by_corridor(sheet: DataFrame) -> DataFrame:
    """Listed assets per corridor and railroad."""
    return count_by(listed_sheet(sheet), "corridor", "railroad")


def passive_crash_subset(incidents: DataFrame, sheet: DataFrame, since: int, corridor: str | None = None) -> DataFrame:
    """Incidents since a two-digit year at listed assets (of one corridor, if named) without gates by the sheet."""
    listed = listed_sheet(sheet)
    if corridor is not None:
        listed = listed.where(F.col("corridor") == corridor)
    ungated = listed.where(not_in_keep_null("warn_dev", ("Gates", "GatesWithMedian")))
    recent = incidents.where(to_integer("iyr") >= since)
    return spread_join(recent, ungated.select("crossing_id"), ["crossing_id"], "left_semi")


def field_review(sheet: DataFrame) -> DataFrame:
    """Located assets flagged for a visit and without notes, with an open status."""
    picked = sheet.where(F.col("x").isNotNull() & F.col("notes").isNull() & (F.col("field_review") == 1))
    return picked.withColumn("review_status", F.lit(0))


def asset_density(assets: DataFrame, edges: DataFrame, counts: DataFrame, radius: float) -> DataFrame:
    """Neighbouring assets and population density around every asset.

    Both are worked out per position and brought back to the assets in one join.
    """
    near = neighbours_by_position(assets, radius, "n_near")
    density = areal_density(locations(assets), edges, counts, radius)
    return attach(assets, near.join(density, ["x", "y"], "left"))


def sparsest_by_count(density: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """For every neighbour count (of each group ``within``) the assets of lowest density; none where a density is missing."""
    return keep_group_min(density, [*within, "n_near"], "density")


def jurisdictions(assets: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Named areas each asset lies in (one row per area)."""
    return key_join(join_polygons(assets, edges), names, ["poly_id"], "inner")


def passive_layer(assets: DataFrame) -> DataFrame:
    return assets.withColumn("passive_cat", rules.passive_category("pedestrian", "warn_dev"))

