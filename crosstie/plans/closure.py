"""Cost of closing an asset: detours, delays, link volumes and gate trip shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.functions.measures import half_even, metres_to_miles, seconds_to_hours
from crosstie.functions.nulls import ratio, strict_sum
from crosstie.operators.joins import key_join
from crosstie.operators.reshape import spread_total, widen

SCENARIOS = ("base", "closure")


def route_totals_wide(routes: DataFrame) -> DataFrame:
    """``distance`` and ``duration`` per scenario; assets whose trips differ by scenario keep two rows."""
    return widen(routes, ["crossing_id", "trips"], "scenario", SCENARIOS, ["distance", "duration"])


def closure_detour(routes: DataFrame, adt: DataFrame) -> DataFrame:
    """Extra distance and time per vehicle, and vehicle hours and miles per day."""
    wide = route_totals_wide(routes).select(
        "crossing_id",
        ratio(F.col("distance_closure") - F.col("distance_base"), "trips").alias("extra_dist_per_veh"),
        (ratio(F.col("duration_closure") - F.col("duration_base"), "trips") / 60).alias("extra_dur_per_veh_min"))
    return key_join(wide, adt, ["crossing_id"]).withColumns({
        "ex_veh_hr": half_even(F.col("extra_dur_per_veh_min") * F.col("final_adt") / 60, 2),
        "ex_veh_mi": half_even(metres_to_miles(F.col("extra_dist_per_veh") * F.col("final_adt")), 2),
        "text": F.lit("")})


def closure_delay(stats: DataFrame, adt: DataFrame) -> DataFrame:
    """Revised method: average added seconds times traffic, for every asset with a traffic row."""
    joined = key_join(stats, adt, ["crossing_id"], "right")
    hours = seconds_to_hours("avg_chg_duration") * F.col("final_adt")
    return joined.withColumn("veh_hrs", half_even(hours, 2)).where(F.col("crossing_id").isNotNull())


def scenario_volumes(overlines: DataFrame, keys: Sequence[str] = ("crossing_id", "link_id"), crossing_id=None) -> DataFrame:
    """Trips per asset and link under both scenarios and their difference (all assets unless one is named).

    A link that is missing in a scenario has no volume there and no difference.
    """
    if crossing_id is not None:
        overlines = overlines.where(F.col("crossing_id") == crossing_id)
    wide = widen(overlines, list(keys), "scenario", SCENARIOS, ["trips"], agg=F.sum)
    return wide.withColumn("delta", F.col("closure") - F.col("base"))


def gate_side(od: DataFrame) -> DataFrame:
    """Pick gate name, link and gate total from whichever end is not the link."""
    gate_is_origin = F.col("o_id").isNull()

    def pick(a, b):
        return F.when(gate_is_origin, F.col(a)).otherwise(F.col(b))

    return od.withColumns({"gate": pick("o_name", "d_name"), "link_id": pick("d_id", "o_id"),
                           "gate_total": pick("o_total", "d_total")})


def whole_period(od: DataFrame, day_type: str = "all", day_part: str = "all day") -> DataFrame:
    return od.where((F.col("day_type") == day_type) & (F.col("day_part") == day_part))


def trip_percent(od: DataFrame) -> DataFrame:
    """Share of a gate's trips per link, in whole percent; duplicate rows are consolidated, one missing volume makes it missing."""
    merged = whole_period(gate_side(od)).groupBy("gate", "link_id").agg(
        strict_sum("od_vol").alias("volume"), F.min_by("gate_total", "ingest_seq").alias("gate_total"))
    return merged.select("gate", "link_id", half_even(ratio("volume", "gate_total") * 100).alias("trip_percent"))


def gate_trip_share(od: DataFrame, links: DataFrame, gates: Sequence[str]) -> DataFrame:
    """One column per gate plus the total, on every link and every observed id."""
    wide = spread_total(trip_percent(od), "link_id", "gate", gates, "trip_percent", "tot_vol")
    return key_join(links, wide, ["link_id"], "full")
