"""Ordered-rule classifiers.

``choose`` builds one CASE expression: the first rule that is true wins, a rule
with a missing condition does not match. All presets return plain columns, so a
classification never adds a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosstie.functions.nulls import col, if_else, paste, to_integer, to_number

# Class names and code tables that results are compared on.
PASSIVE_DEVICES = ("Not Classified", "StopSign", "YieldSign", "Crossbucks")
SEVERITIES = ("PDO", "Injury", "Fatal")
VEHICLE_CODES = {
    "A": "Auto", "B": "Truck", "C": "Truck-Trailer", "D": "Pickup Truck",
    "E": "Van", "J": "Other", "K": "Pedestrian", "M": "Other",
}
POSITION_CODES = {
    "1": "Stalled/Stuck on Crossing", "2": "Stopped on Crossing",
    "3": "Moving over Crossing", "5": "Blocked by Crossing Gates",
}
MOTORIST_CODES = {
    "1": "Went Around Gates", "3": "Did Not Stop", "4": "Stopped on Crossing",
    "5": "Other", "7": "Went Through Gate",
}
LEGEND_GROUPS = {
    "1: Universal": ("Advanced flashing warning signs", "Lighting", "Signing and pavement markings"),
    "2: Gates and Lights": ("Upgrade with gates and lights",),
    "3: Closure": ("Closure",),
    "4: Grade Separation": ("Grade Separation",),
}
UNCLASSIFIED_RISK = 99.0
# Reduction by change, for (<=10 trains, <=1 track), (<=10, >1), (>10, <=1), (>10, >1).
DEVICE_REDUCTIONS = {
    "pass_to_gates": (0.75, 0.86, 0.80, 0.78),
    "FL_to_gates": (0.89, 0.65, 0.69, 0.63),
}
FLAT_REDUCTIONS = {"closure": 1.0, "grade_sep": 1.0, "None": 0.0, "pass_to_FL": 0.75, "pass_to_priv": 0.0}
TREATMENT_FLAGS = {
    "closures": "Closure", "afws": "AFWS", "lighting": "Lighting", "other": "Other",
    "public_to_private": "Public-to", "security_gates": "Security", "grade_seps": "Sep",
}


def choose(rules, default=None) -> Column:
    """CASE from ``[(condition, value), ...]``."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def decode(c: str | Column, codes: dict, default: str | None = None) -> Column:
    """Code to label through a constant map."""
    pairs = [F.lit(v) for kv in codes.items() for v in kv]
    label = F.try_element_at(F.create_map(*pairs), col(c))
    return label if default is None else F.coalesce(label, F.lit(default))


def severity(killed, injured) -> Column:
    return choose([(to_number(killed) > 0, "Fatal"), (to_number(injured) > 0, "Injury")], "PDO")


def warning_device(gate_conf, gates, channel, flash, stop_std, yield_std, xbuck) -> Column:
    g, f, s = to_number(gates), to_number(flash), to_number(stop_std)
    bare = (g == 0) & (f == 0)
    return choose([
        (to_number(gate_conf) == 3, "FourQuad"),
        ((g > 0) & F.coalesce(to_number(channel).isin(1.0, 2.0, 3.0, 4.0), F.lit(False)), "GatesWithMedian"),
        (g > 0, "Gates"),
        ((f > 0) & (g == 0), "FlashingOnly"),
        (bare & (s > 0), "StopSign"),
        (bare & (to_number(yield_std) > 0), "YieldSign"),
        (bare & (s == 0) & (to_number(xbuck) > 0), "Crossbucks"),
    ], "Not Classified")


def device_group(device) -> Column:
    """Three-way group. Four-quadrant gates count as passive here, unlike in ``existing_class``."""
    d = col(device)
    return choose([(d.isin("Gates", "GatesWithMedian"), "Gates"),
                   (d == "FlashingOnly", "Flashing Lights Only")], "Passive")


def separation_position(pos) -> Column:
    return if_else(col(pos) == 2, F.lit("RR Under"), F.lit("RR Over"))


def pedestrian_flag(purpose) -> Column:
    return if_else(col(purpose) == 1, F.lit("No"), F.lit("Yes"))


def passive_category(pedestrian, device) -> Column:
    return choose([(col(pedestrian) == "Yes", "Pedestrian"),
                   (col(device).isin(*PASSIVE_DEVICES), "passive")], "active")


def existing_class(device) -> Column:
    return choose([(col(device).isin(*PASSIVE_DEVICES), "pass"), (col(device) == "FlashingOnly", "FL")], "gates")


def proposed_class(text, existing) -> Column:
    """Protection class after treatment, from free text; missing text stays missing."""
    t = col(text)
    return choose([
        (t == "Closure", "closure"),
        (t.rlike("Grade Separation"), "grade_sep"),
        (t.rlike("Security Gates"), "gates"),
        (t.rlike("Gates|AFWS|Lighting|Other"), "gates"),
        (t.rlike("Public-to"), "priv"),
        (t.rlike("None"), col(existing)),
    ])


def change_text(existing, proposed) -> Column:
    return paste(existing, F.lit("_to_"), proposed)


def change_category(existing, proposed, overrides: Column | None = None) -> Column:
    change = change_text(existing, proposed)
    rules = [(change.rlike("closure"), "closure"), (change.rlike("grade_sep"), "grade_sep"),
             (col(existing) == col(proposed), "None")]
    cat = choose(rules, change)
    return cat if overrides is None else F.coalesce(overrides, cat)


def base_reduction(category, trains, tracks, change: Column | None = None) -> Column:
    """Risk reduction of a change; 99 marks a change the table does not cover.

    Passing ``change`` adds the first-tier rule: no proposed class means no reduction.
    """
    c, n, k = col(category), col(trains), col(tracks)
    rules = [(c == name, value) for name, value in FLAT_REDUCTIONS.items()]
    for name, by_use in DEVICE_REDUCTIONS.items():
        uses = ((n <= 10) & (k <= 1), (n <= 10) & (k > 1), (n > 10) & (k <= 1), (n > 10) & (k > 1))
        rules += [((c == name) & use, value) for use, value in zip(uses, by_use)]
    if change is not None:
        rules.append((change.rlike("to_NA"), 0.0))
    return choose(rules, UNCLASSIFIED_RISK)


def legend_group(text) -> Column:
    return choose([(col(text).isin(*names), label) for label, names in LEGEND_GROUPS.items()], "5: Other")


def exposure_after(text, exposure) -> Column:
    return choose([(col(text).rlike("Clos|Grade Sep"), 0.0)], col(exposure))


def text_flag(text, pattern: str) -> Column:
    return if_else(col(text).rlike(pattern), F.lit(1), F.lit(0))


def treatment_flags(text, with_gates: bool = False) -> dict[str, Column]:
    flags = {name: text_flag(text, pattern) for name, pattern in TREATMENT_FLAGS.items()}
    if with_gates:
        flags["gates"] = text_flag(text, "Gates") - text_flag(text, "Security")
    return flags
