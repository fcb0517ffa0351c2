"""Treatment effects and corridor roll-ups from the master sheet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.functions import rules
from crosstie.functions.measures import combine_effects
from crosstie.functions.nulls import if_else, missing_or_not_matching, ratio, strict_sum
from crosstie.operators.joins import key_join
from crosstie.operators.reshape import transpose
from crosstie.operators.tables import sums_by

SUMMARY_METRICS = (
    "est_inc_before", "est_inc_after_all", "est_inc_after_t1", "exp_ind_tot", "exp_ind_all", "exp_ind_t1",
    "percent_red_all", "percent_red_t1", "delta_inc_all", "delta_inc_t1",
    "percent_exp_ind_red_all", "percent_exp_ind_red_t1", "delta_exp_ind_all", "delta_exp_ind_t1")


# Words of a treatment text that reduce the risk by themselves, and by how much; track counts of an asset.
EFFECTS = {"signs": ("AFWS", 0.05), "light": ("Lighting", 0.05)}
TRACKS = ("industry_trk", "main_trk", "siding_trk", "transit_trk", "yard_trk")
OUT_OF_SCOPE = "Pedestrian|Exclude"


def _treatment(df: DataFrame, text: str, tag: str, first_tier: bool, fixes: dict) -> DataFrame:
    fixed = rules.decode(F.col("crossing_id"), fixes) if fixes else None
    df = df.withColumn(f"new_{tag}", rules.proposed_class(text, "existing"))
    df = df.withColumn(f"change_{tag}", rules.change_text("existing", f"new_{tag}"))
    df = df.withColumn(f"cat_{tag}", rules.change_category("existing", f"new_{tag}", fixed))
    base = rules.base_reduction(f"cat_{tag}", "daily_trains", "tot_tracks",
                                F.col(f"change_{tag}") if first_tier else None)
    parts = {f"{name}_red_{tag}": if_else(F.col(text).rlike(word), F.lit(share), F.lit(0.0)) for name, (word, share) in EFFECTS.items()}
    df = df.withColumns({f"base_red_{tag}": base} | parts)
    return df.withColumns({
        f"final_red_{tag}": combine_effects(f"base_red_{tag}", *parts),
        f"unclassified_{tag}": F.col(f"base_red_{tag}") == rules.UNCLASSIFIED_RISK})


def scoped_sheet(sheet: DataFrame) -> DataFrame:
    """Rows of the master sheet with a corridor and without notes."""
    return sheet.where(F.col("corridor").isNotNull() & F.col("notes").isNull())


def risk_reduction(base: DataFrame, sheet: DataFrame, fixes: dict | None = None, tracks: Sequence[str] = TRACKS) -> DataFrame:
    """Risk reduction of all-tier and first-tier treatments for every asset not marked out.

    ``base`` has ``crossing_id`` and the track counts, whose sum is missing when one of them
    is. Device, trains and treatments come from the sheet, from its rows in scope: an asset
    without one stays with missing treatments. ``fixes`` sets the change category of single
    assets.
    """
    total = reduce(add, [F.col(c) for c in tracks])
    df = key_join(base.select("crossing_id", total.alias("tot_tracks")), scoped_sheet(sheet), ["crossing_id"])
    df = df.where(missing_or_not_matching("notes", OUT_OF_SCOPE)).withColumn("existing", rules.existing_class("warn_dev"))
    df = _treatment(df, "all_desc", "all", False, fixes or {})
    return _treatment(df, "tier1_desc", "t1", True, fixes or {})


def exposed_sheet(sheet: DataFrame) -> DataFrame:
    """Sheet rows in scope with exposure before and after each treatment set."""
    kept = sheet.where(missing_or_not_matching("notes", OUT_OF_SCOPE) & F.col("corridor").isNotNull())
    kept = kept.withColumn("exp_ind", F.col("total_trains") * F.col("adt"))
    return kept.withColumns({"exp_t1": rules.exposure_after("tier1_desc", "exp_ind"),
                             "exp_all": rules.exposure_after("all_desc", "exp_ind")})


def corridor_summary(sheet: DataFrame) -> DataFrame:
    """Incidents and exposure per corridor before and after. Incident reductions are positive,
    exposure changes negative, as in the study."""
    sums = sums_by(exposed_sheet(sheet), ["corridor"], {
        "est_inc_before": "est_before", "est_inc_after_all": "est_all", "est_inc_after_t1": "est_t1",
        "exp_ind_tot": "exp_ind", "exp_ind_all": "exp_all", "exp_ind_t1": "exp_t1"})

    def c(name):
        return F.col(name)

    out = {}
    for tag in ("all", "t1"):
        out[f"percent_red_{tag}"] = 1 - ratio(f"est_inc_after_{tag}", "est_inc_before")
        out[f"delta_inc_{tag}"] = c("est_inc_before") - c(f"est_inc_after_{tag}")
        out[f"percent_exp_ind_red_{tag}"] = ratio(c(f"exp_ind_{tag}") - c("exp_ind_tot"), "exp_ind_tot")
        out[f"delta_exp_ind_{tag}"] = c("exp_ind_tot") - c(f"exp_ind_{tag}")
    return sums.withColumns(out).select("corridor", *SUMMARY_METRICS)


def corridor_summary_table(sheet: DataFrame, corridors: Sequence[str]) -> DataFrame:
    return transpose(corridor_summary(sheet), "corridor", corridors, SUMMARY_METRICS)


def treatment_tally(sheet: DataFrame, first_tier: bool = False) -> DataFrame:
    """How often each treatment is proposed, per corridor.

    First-tier rows without text are left out; in the all-tier tally one such row makes
    the corridor's count missing.
    """
    text = "tier1_desc" if first_tier else "all_desc"
    kept = sheet.where(missing_or_not_matching("notes", OUT_OF_SCOPE) & F.col("corridor").isNotNull())
    if first_tier:
        kept = kept.where(F.col(text).isNotNull())
    flags = rules.treatment_flags(text, with_gates=first_tier)
    return kept.groupBy("corridor").agg(*[strict_sum(flag).cast("bigint").alias(name) for name, flag in flags.items()])
