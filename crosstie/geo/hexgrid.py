"""Hexagonal analysis cells along lines.

Cells are pointy-topped hexagons; ``width`` is the distance between opposite sides.
The lattice starts at the lower-left corner of the grown bounding box of each group
of lines. Cells are generated from the segments they lie near, never from the whole
bounding box.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.geo.measure import ENDS, length, num, point_segment_sq, segment_segment_sq
from crosstie.geo.shapes import boxes, cut_to_length
from crosstie.operators.joins import key_join, spread_join

# Most lattice origins (groups of lines) that are sent to every task.
MOST_ORIGINS = 10_000
# Corner directions of a pointy-topped hexagon, counter-clockwise, for unit circumradius.
_CORNERS = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (-30, 30, 90, 150, 210, 270)]


def _row_height(width: float) -> float:
    return width * math.sqrt(3.0) / 2.0


def _hex_distance_sq(width: float) -> str:
    """Squared distance from the segment to the outline of the hexagon at (hx, hy); 0 where they cross."""
    radius = width / math.sqrt(3.0)
    corners = [(f"hx + {num(radius * c)}", f"hy + {num(radius * s)}") for c, s in _CORNERS]
    sides = ", ".join(f"struct({a[0]} AS ax, {a[1]} AS ay, {b[0]} AS bx, {b[1]} AS by)"
                      for a, b in zip(corners, corners[1:] + corners[:1]))
    gap = segment_segment_sq(("e.ax", "e.ay", "e.bx", "e.by"), ENDS)
    return f"array_min(transform(array({sides}), e -> {gap}))"


def _with_origin(pieces: DataFrame, origin: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the lattice origin of each piece's group.

    The groups are few and large, so a join by group would gather them in as many tasks. Up to
    ``MOST_ORIGINS`` origins, which are counted first, are sent to all tasks; of more groups the
    large ones are dealt out.
    """
    few = origin.limit(MOST_ORIGINS + 1).collect()
    if len(few) > MOST_ORIGINS:
        return spread_join(pieces, origin, keys, "inner", row_key=ENDS)
    return pieces.join(F.broadcast(pieces.sparkSession.createDataFrame(few, origin.schema)), list(keys))


def _lattice_near(segments: DataFrame, origin: DataFrame, keys: Sequence[str], reach: float, width: float) -> DataFrame:
    """Pieces of the segments with every lattice cell whose centre may lie within ``reach``."""
    pieces = _with_origin(cut_to_length(segments, width).drop("piece"), origin, keys)
    r, w, h = num(reach), num(width), num(_row_height(width))
    return (pieces
            .selectExpr("*", f"explode(sequence(floor((least(y1, y2) - {r} - y0) / {h}), ceil((greatest(y1, y2) + {r} - y0) / {h}))) AS row")
            .selectExpr("*", f"explode(sequence(floor((least(x1, x2) - {r} - x0) / {w}) - 1, ceil((greatest(x1, x2) + {r} - x0) / {w}))) AS cell")
            .selectExpr("*", f"x0 + cell * {w} + IF(pmod(row, 2) = 1, {num(width / 2)}, 0D) AS hx", f"y0 + row * {h} AS hy")
            .where(f"{point_segment_sq('hx', 'hy')} <= {num(reach ** 2)}"))


def _grouped(segments: DataFrame, distance: float, groups: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Segments, lattice origin per group, and the group keys (one constant key without groups)."""
    keys = list(groups) or ["_all"]
    work = segments.select(*groups, *ENDS) if groups else segments.selectExpr("0 AS _all", *ENDS)
    origin = boxes(work, keys).selectExpr(*keys, f"xlo - {num(distance)} AS x0", f"ylo - {num(distance)} AS y0")
    return work, origin, keys


def hex_cells(segments: DataFrame, distance: float, width: float, groups: Sequence[str] = ()) -> DataFrame:
    """Cells within ``distance`` of the lines: ``groups, row, cell, hx, hy``; one row per cell.

    A cell is in when its centre is closer than ``distance`` plus the inner radius, out
    beyond ``distance`` plus the outer radius, and only in between is the hexagon tested
    side by side.
    """
    work, origin, keys = _grouped(segments, distance, groups)
    lattice = _lattice_near(work, origin, keys, distance + width / math.sqrt(3.0), width)
    sure = f"{point_segment_sq('hx', 'hy')} <= {num((distance + width / 2) ** 2)}"
    near = lattice.where(f"CASE WHEN {sure} THEN true ELSE {_hex_distance_sq(width)} <= {num(distance ** 2)} END")
    return near.select(*groups, "row", "cell", "hx", "hy").distinct()


def _inside_steps(width: float) -> tuple[dict[str, str], str]:
    """Length of the segment inside the hexagon at (hx, hy): the segment cut by the six side lines.

    Returned are the helper columns (position and slope against each side) and the length.
    """
    half = num(width / 2)
    cols, enter, leave, outside = {}, ["0D"], ["1D"], []
    for i in range(6):
        nx, ny = num(math.cos(math.radians(60 * i))), num(math.sin(math.radians(60 * i)))
        cols[f"_at{i}"] = f"{nx} * (x1 - hx) + {ny} * (y1 - hy)"
        cols[f"_sl{i}"] = f"{nx} * (x2 - x1) + {ny} * (y2 - y1)"
        t = f"try_divide({half} - _at{i}, _sl{i})"
        enter.append(f"CASE WHEN _sl{i} < 0 THEN {t} END")
        leave.append(f"CASE WHEN _sl{i} > 0 THEN {t} END")
        outside.append(f"(_sl{i} = 0 AND _at{i} > {half})")
    inside = f"greatest(least({', '.join(leave)}) - greatest({', '.join(enter)}), 0D) * {length()}"
    return cols, f"CASE WHEN {' OR '.join(outside)} THEN 0D ELSE {inside} END"


def mark_cut_cells(cells: DataFrame, segments: DataFrame, strip: float, distance: float, width: float,
                   groups: Sequence[str] = ()) -> DataFrame:
    """Add ``is_cut`` (line within ``strip`` of the cell) and ``line_length`` inside the cell.

    ``distance``, ``width`` and ``groups`` are those the cells were made with.
    """
    work, origin, keys = _grouped(segments, distance, groups)
    if not groups:
        cells = cells.selectExpr("*", "0 AS _all")
    near = _lattice_near(work, origin, keys, strip + width / math.sqrt(3.0), width)
    helpers, inside = _inside_steps(width)
    near = near.selectExpr("*", *[f"{e} AS {name}" for name, e in helpers.items()]).selectExpr("*", f"{inside} AS _in")
    touch = f"CASE WHEN _in > 0 THEN true ELSE {_hex_distance_sq(width)} <= {num(strip ** 2)} END"
    cut = near.groupBy(*keys, "row", "cell").agg(F.sum("_in").alias("line_length"), F.expr(f"bool_or({touch}) AS is_cut"))
    out = key_join(cells, cut, [*keys, "row", "cell"], "left").fillna(0.0, ["line_length"]).fillna(False, ["is_cut"])
    return out if groups else out.drop("_all")
