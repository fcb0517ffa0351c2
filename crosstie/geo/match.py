"""Points against lines: within a distance, nearest, and neighbour counts.

"Inside the buffer of a line" is evaluated as "distance to the line <= d"; no buffer
polygon is built. Work is done on distinct positions and attached to the rows
afterwards, so copies of a position cost one computation and the result keeps every
input row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.geo.measure import ENDS, num, point_segment_sq, segment_segment_sq
from crosstie.geo.shapes import CELL, MIN_CELL, cell_of, cell_size, cover_segments, locations, with_cell
from crosstie.operators.joins import HOT_ROWS, hot_keys, key_join, spread_join
from crosstie.session import stored

# Two cells with more entries than this (on average) are halved before their entries are compared one by one.
CROWD = 128
# Levels of halving; what they leave undecided is compared one by one.
DEEPEST = 24
DEEPEST_LINES = 4
# Points of a cell beyond which it is cut into FINE x FINE cells (FINE a power of two); metres that cover rounding.
CROWDED_CELL = 20_000
FINE = 32
ROUNDING = 1e-6
_FINE_CELL = ("_fx", "_fy")

# The nine offsets of a 3 x 3 block.
_AROUND = "explode(array({})) AS _o".format(", ".join(
    f"struct({i} AS i, {j} AS j)" for i in (-1, 0, 1) for j in (-1, 0, 1)))


def cell_join(left: DataFrame, right: DataFrame, exact: str, how: str = "inner",
              keys: Sequence[str] = CELL) -> DataFrame:
    """Equi-join on grid keys with an exact residual test (SQL over both sides' columns).

    Apart from the keys the two sides must have different column names. Grid keys are
    never grouping keys of the next step, so a crowded cell can be split by the
    adaptive skew join: its output is shuffled again anyway.
    """
    cond = " AND ".join([*(f"{k} = _r_{k}" for k in keys), f"({exact})"])
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(right, F.expr(cond), how).drop(*(f"_r_{k}" for k in keys))


def attach(points: DataFrame, found: DataFrame, x: str = "x", y: str = "y", how: str = "inner",
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bring per-position results back to every row at that position."""
    found = found.withColumnsRenamed({"x": x, "y": y})
    return spread_join(points, found, [x, y], how, hot_rows)


def _near(points: DataFrame, segments: DataFrame, distance: float, wanted: str, crowd: int = CROWDED_CELL) -> DataFrame:
    """Points ``x, y`` with the segments within ``distance``: ``all`` of them, at least the ``nearest`` of
    each point, or for ``any`` the points alone.

    Points of a cell meet the segments listed under it. Cells of more than ``crowd`` points
    (a bounded list, counted with a combine) are cut into fine ones first, of which each
    meets only the segments that ``fine_candidates`` leaves. This is planned only if the
    count finds such a cell; the rows are the same either way.
    """
    size = cell_size(distance)
    how = "left_semi" if wanted == "any" else "inner"
    cover = cover_segments(segments, size, distance)
    exact = f"{point_segment_sq('x', 'y')} <= {num(distance ** 2)}"
    placed = with_cell(points, size)
    if placed.groupBy(*CELL).count().where(F.col("count") > crowd).isEmpty():
        return cell_join(placed, cover, exact, how).drop(*CELL)
    hot = hot_keys(placed, CELL, crowd).select(*[f"_h_{c}" for c in CELL], F.lit(True).alias("_crowd"))
    on = " AND ".join([*(f"{c} = _h_{c}" for c in CELL), "NOT isnan(x)", "NOT isnan(y)"])
    placed = placed.join(F.broadcast(hot), F.expr(on), "left").drop(*[f"_h_{c}" for c in CELL])
    plain = cell_join(placed.where("_crowd IS NULL"), cover, exact, how)
    own = placed.where("_crowd").selectExpr("*", f"{cell_of('x', size / FINE)} AS _fx", f"{cell_of('y', size / FINE)} AS _fy")
    dense = cell_join(own, fine_candidates(own, cover, distance, wanted), exact, how, _FINE_CELL).drop(*_FINE_CELL)
    return plain.unionByName(dense).drop("_crowd", *CELL)


def fine_candidates(own: DataFrame, cover: DataFrame, distance: float, wanted: str) -> DataFrame:
    """Segments that the points of each fine cell have to be compared with, under ``_fx, _fy``.

    The distance of a segment to the middle of a cell's points, less and more half the
    diagonal of their bounds, holds for all of them. Segments out of reach go. The least
    upper bound of a cell drops those that cannot be the nearest of any point; where it is
    within ``distance``, any point of the cell has that one segment near.
    """
    cells = (own.groupBy(*CELL, *_FINE_CELL).agg(*[F.expr(f"{f}({v}) AS _{v}{end}") for v in "xy" for f, end in (("min", "lo"), ("max", "hi"))])
             .selectExpr(*CELL, *_FINE_CELL, "(_xlo + _xhi) / 2 AS _px", "(_ylo + _yhi) / 2 AS _py",
                         f"sqrt(power(_xhi - _xlo, 2) + power(_yhi - _ylo, 2)) / 2 + {num(ROUNDING)} AS _half"))
    rest = [c for c in cover.columns if c not in CELL]
    met = (cell_join(cells, cover, "true").selectExpr(*rest, *_FINE_CELL, "_half", f"sqrt({point_segment_sq('_px', '_py')}) AS _middle")
           .where(f"_middle - _half <= {num(distance)}"))
    if wanted != "all":
        bound = met.groupBy(*_FINE_CELL).agg(F.expr("min(_middle + _half) AS _bound"))
        left = "_middle - _half <= _bound" if wanted == "nearest" else f"_bound > {num(distance)} OR _middle + _half = _bound"
        met = cell_join(met, bound, left, "inner", _FINE_CELL)
    return met.select(*rest, *_FINE_CELL)


def within_lines(points: DataFrame, segments: DataFrame, distance: float, x: str = "x", y: str = "y",
                 crowd: int = CROWDED_CELL) -> DataFrame:
    """Points no farther than ``distance`` from any line (each kept once)."""
    renamed = points.withColumnsRenamed({x: "x", y: "y"}) if (x, y) != ("x", "y") else points
    kept = _near(renamed, segments.select(*ENDS), distance, "any", crowd)
    return kept.withColumnsRenamed({"x": x, "y": y}) if (x, y) != ("x", "y") else kept


def nearest_line(points: DataFrame, segments: DataFrame, distance: float, attributes: Sequence[str],
                 line: str = "line_id", x: str = "x", y: str = "y", dist_out: str | None = None,
                 how: str = "inner", hot_rows: int = HOT_ROWS, crowd: int = CROWDED_CELL) -> DataFrame:
    """Attributes of the nearest line, for points with a line within ``distance``.

    One row per point row; equal distances go to the lowest line id. The inner form
    is the within-distance filter and the nearest-line join in one pass: a point that
    passes the filter has its nearest line among the candidates by construction.
    """
    rest = [a for a in attributes if a != line]
    cand = _near(locations(points, x, y), segments.select(line, *rest, *ENDS), distance, "nearest", crowd)
    first = ", ".join([f"{point_segment_sq('x', 'y')} AS _sq", line, *rest])
    best = cand.groupBy("x", "y").agg(F.expr(f"min(struct({first})) AS _b"))
    out = [f"_b.{a} AS {a}" for a in attributes]
    if dist_out:
        out.append(f"sqrt(_b._sq) AS {dist_out}")
    return attach(points, best.selectExpr("x", "y", *out), x, y, how, hot_rows)


def join_within(points: DataFrame, segments: DataFrame, distance: float, attributes: Sequence[str],
                line: str = "line_id", x: str = "x", y: str = "y", hot_rows: int = HOT_ROWS,
                crowd: int = CROWDED_CELL) -> DataFrame:
    """One row per (point row, line within ``distance``)."""
    rest = [a for a in attributes if a != line]
    cand = _near(locations(points, x, y), segments.select(line, *rest, *ENDS), distance, "all", crowd)
    pairs = cand.select("x", "y", line, *rest).distinct().select("x", "y", *attributes)
    return attach(points, pairs, x, y, "inner", hot_rows)


def near_cells(mine: DataFrame, theirs: DataFrame, distance: float, fine: float) -> DataFrame:
    """Pairs of cells ``fine`` wide, listed on two sides, that have room for a distance of ``distance`` or less.

    With the entries of each side (``m``, ``o_m``); ``sure`` where any two segments listed
    there are close enough: a segment lies within one cell of the cells it is listed under.
    """
    reach = float(distance) / fine
    k = max(math.ceil(reach), 1)
    bx, by = f"floor(cx / {k})", f"floor(cy / {k})"
    a = (mine.groupBy(*CELL).agg(F.count(F.lit(1)).alias("m")).selectExpr(*CELL, "m", _AROUND)
         .selectExpr(*CELL, "m", f"{bx} + _o.i AS bx", f"{by} + _o.j AS by"))
    b = (theirs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("o_m"))
         .selectExpr("cx AS ox", "cy AS oy", "o_m", f"{bx} AS bx", f"{by} AS by"))
    return _cell_reach(a.join(b, ["bx", "by"]), reach)


def _cell_reach(pairs: DataFrame, reach: float) -> DataFrame:
    # The allowance is for the rounding of steps along a segment.
    gap = "power(greatest(abs(ox - cx) - 1, 0), 2) + power(greatest(abs(oy - cy) - 1, 0), 2)"
    sure = f"power(abs(ox - cx) + 3, 2) + power(abs(oy - cy) + 3, 2) <= {num(reach ** 2)}"
    return pairs.where(f"{gap} <= {num(reach ** 2 + 1e-6)}").selectExpr(*CELL, "m", "ox", "oy", "o_m", f"{sure} AS sure")


def segments_within(segments: DataFrame, keys: Sequence[str], others: DataFrame, distance: float,
                    split: int = 8, crowd: int = CROWD) -> DataFrame:
    """Distinct ``keys`` of the segments that come within ``distance`` of any other segment.

    Fine cells are judged first. A cell that has a cell of the others close enough as a
    whole is accepted with everything in it, one that has none in reach is dropped. Undecided
    pairs of cells that are crowded are halved, for keys not accepted yet, and judged again;
    only segments listed in the undecided pairs that are left are compared one by one.
    """
    keys = list(keys)
    size = max(float(distance) / split, MIN_CELL / 2)
    theirs = stored(cover_segments(others.select(*ENDS), size), "others")
    mine = stored(cover_segments(segments.select(*keys, *ENDS), size), "segments")
    tops = [t.groupBy(*CELL).count().agg(F.max("count")).first()[0] or 0 for t in (mine, theirs)]
    may_crowd = tops[0] * tops[1] > crowd ** 2
    pairs = near_cells(mine, theirs, distance, size)
    crowded = f"CAST(m AS DOUBLE) * o_m > {num(crowd ** 2)}"
    accepted, compared = [], []
    for level in range(DEEPEST_LINES + 1):
        if may_crowd:
            pairs = stored(pairs, "cell-pairs")
        sure = pairs.where("sure").select(*CELL).distinct()
        taken = key_join(mine, sure, list(CELL), "left_semi").select(*keys).distinct()
        accepted.append(taken)
        rim = key_join(pairs.where("NOT sure"), sure, list(CELL), "left_anti")
        left = key_join(mine, taken, keys, "left_anti")
        last = level == DEEPEST_LINES or not may_crowd or rim.where(crowded).isEmpty()
        compared.append(_close(left, rim if last else rim.where(f"NOT ({crowded})"), theirs, keys, distance))
        if last:
            break
        wide = rim.where(crowded).selectExpr("cx AS px", "cy AS py", "ox AS qx", "oy AS qy")
        size /= 2
        mine = stored(_halved(left, wide.selectExpr("px AS cx", "py AS cy").distinct(), size), "segments")
        theirs = stored(_halved(theirs, wide.selectExpr("qx AS cx", "qy AS cy").distinct(), size), "others")
        a = mine.groupBy(*CELL).agg(F.count(F.lit(1)).alias("m")).selectExpr("*", "shiftright(cx, 1) AS px", "shiftright(cy, 1) AS py")
        b = (theirs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("o_m"))
             .selectExpr("cx AS ox", "cy AS oy", "o_m", "shiftright(cx, 1) AS qx", "shiftright(cy, 1) AS qy"))
        pairs = _cell_reach(wide.join(a, ["px", "py"]).join(b, ["qx", "qy"]), float(distance) / size)
    return reduce(DataFrame.unionAll, [*accepted, *compared]).distinct()


def _close(mine: DataFrame, pairs: DataFrame, theirs: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Keys of the segments within ``distance`` of one of the others, over the listed pairs of cells."""
    o_ends = [f"o_{c}" for c in ENDS]
    exact = f"{segment_segment_sq(ENDS, o_ends)} <= {num(distance ** 2)}"
    listed = (cell_join(mine, pairs.select(*CELL, "ox", "oy"), "true").drop(*CELL)
              .withColumnsRenamed({"ox": "cx", "oy": "cy"}))
    theirs = theirs.withColumnsRenamed({c: f"o_{c}" for c in ENDS})
    return cell_join(listed, theirs, exact, "left_semi").select(*keys)


def _halved(listed: DataFrame, parents: DataFrame, size: float) -> DataFrame:
    """Segments listed under the cells ``size`` wide of the given cells of twice that width."""
    rest = [c for c in listed.columns if c not in CELL]
    again = cover_segments(key_join(listed, parents, list(CELL), "left_semi").select(*rest).distinct(), size)
    halves = again.selectExpr(*rest, "shiftright(cx, 1) AS px", "shiftright(cy, 1) AS py", *CELL)
    return key_join(halves, parents.withColumnsRenamed({"cx": "px", "cy": "py"}), ["px", "py"], "left_semi").select(*rest, *CELL)


def lines_near_lines(lines: DataFrame, segments: DataFrame, others: DataFrame, distance: float,
                     line: str = "line_id") -> DataFrame:
    """Lines having a segment within ``distance`` of any segment of ``others``."""
    return key_join(lines, segments_within(segments, [line], others, distance), [line], "left_semi")


def _cells(locs: DataFrame, size: float) -> DataFrame:
    """Cells of ``size`` with their rows ``n``, positions ``m`` and the exact bounds of the positions."""
    return (locs.selectExpr("x", "y", "w", f"{cell_of('x', size)} AS fx", f"{cell_of('y', size)} AS fy")
            .groupBy("fx", "fy").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), *[
                F.expr(f"{f}({v})").alias(f"{v}{end}") for v in "xy" for f, end in (("min", "lo"), ("max", "hi"))]))


def _judged_pairs(pairs: DataFrame, distance: float) -> DataFrame:
    """Pairs of cells in reach of each other; ``sure`` ones have all their positions within ``distance``."""
    d2 = num(distance ** 2)
    gap = "power(greatest(b_xlo - xhi, xlo - b_xhi, 0D), 2) + power(greatest(b_ylo - yhi, ylo - b_yhi, 0D), 2)"
    far = "power(greatest(b_xhi - xlo, xhi - b_xlo), 2) + power(greatest(b_yhi - ylo, yhi - b_ylo), 2)"
    return pairs.where(f"{gap} <= {d2}").selectExpr("fx", "fy", "m", "b_fx", "b_fy", "b_n", "b_m", f"{far} <= {d2} AS sure")


def settled_cells(locs: DataFrame, distance: float, split: int = 8, crowd: int = CROWD) -> list[tuple[float, DataFrame]]:
    """The cell size and the judged pairs of every level, for positions ``x, y`` with a weight ``w``.

    The first level pairs cells ``distance / split`` wide. Where a pair is cut by the circle and
    its cells hold more than ``crowd`` positions each on average, both are halved in the next
    level; it stands no more in its own. So of n positions of a crowd about n^1.5 pairs are left
    to compare (the cells along a circle, not those inside it). A level is planned only if the
    one before has such a pair, and halving ends after ``DEEPEST`` levels.
    """
    size = distance / split
    cells = stored(_cells(locs, size), "cells")
    top = cells.agg(F.max("m")).first()[0] or 0
    others = [f"{c} AS b_{c}" for c in cells.columns]
    cx, cy = f"floor(fx / {split})", f"floor(fy / {split})"
    a = (cells.selectExpr("*", _AROUND).selectExpr(*cells.columns, f"{cx} + _o.i AS cx", f"{cy} + _o.j AS cy"))
    pairs = _judged_pairs(a.join(cells.selectExpr(f"{cx} AS cx", f"{cy} AS cy", *others), list(CELL)), distance)
    levels: list[tuple[float, DataFrame]] = []
    crowded = f"NOT sure AND CAST(m AS DOUBLE) * b_m > {num(crowd ** 2)}"
    while top > crowd and len(levels) < DEEPEST:
        pairs = stored(pairs, "cell-pairs")
        wide = pairs.where(crowded)
        if wide.isEmpty():
            break
        levels.append((size, pairs.where(f"NOT ({crowded})")))
        size /= 2
        cells = _cells(locs, size)
        halves = cells.selectExpr("shiftright(fx, 1) AS px", "shiftright(fy, 1) AS py", *cells.columns)
        b_halves = cells.selectExpr("shiftright(fx, 1) AS qx", "shiftright(fy, 1) AS qy", *others)
        pairs = _judged_pairs(wide.selectExpr("fx AS px", "fy AS py", "b_fx AS qx", "b_fy AS qy")
                              .join(halves, ["px", "py"]).join(b_halves, ["qx", "qy"]), distance)
    return [*levels, (size, pairs)]


def neighbours_by_position(points: DataFrame, distance: float, out: str = "n_near", x: str = "x", y: str = "y",
                           split: int = 8, crowd: int = CROWD) -> DataFrame:
    """``(x, y, out)``: number of point rows within ``distance`` of each position, its own included.

    Rows are first counted per position and per fine cell (``distance / split`` wide,
    with the exact bounds of its points). Pairs of non-empty cells are then settled as
    a whole where they can be: all of it within reach adds the cell's count, none of
    it adds nothing. Cells cut by the circle are halved while they are crowded
    (``settled_cells``); only what is left compares positions.
    """
    known = points.where(f"{x} IS NOT NULL AND {y} IS NOT NULL")
    locs = stored(known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w")), "positions")
    shares = []
    for size, pairs in settled_cells(locs, distance, split, crowd):
        here = locs.selectExpr("*", f"{cell_of('x', size)} AS fx", f"{cell_of('y', size)} AS fy")
        whole = pairs.where("sure").groupBy("fx", "fy").agg(F.sum("b_n").alias("w"))
        shares.append(cell_join(here.select("x", "y", "fx", "fy"), whole, "true", "inner", ("fx", "fy")).select("x", "y", "w"))
        ours = (cell_join(here.select("x", "y", "fx", "fy"), pairs.where("NOT sure").select("fx", "fy", "b_fx", "b_fy"),
                          "true", "inner", ("fx", "fy")).selectExpr("x", "y", "b_fx AS fx", "b_fy AS fy"))
        theirs = here.selectExpr("x AS bx", "y AS by", "w", "fx", "fy")
        near = f"power(x - bx, 2) + power(y - by, 2) <= {num(distance ** 2)}"
        shares.append(cell_join(ours, theirs, near, "inner", ("fx", "fy")).select("x", "y", "w"))
    return reduce(DataFrame.unionAll, shares).groupBy("x", "y").agg(F.sum("w").alias(out))


def neighbour_counts(points: DataFrame, distance: float, out: str = "n_near", x: str = "x", y: str = "y",
                     split: int = 8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number of point rows within ``distance`` of each point, itself included."""
    return attach(points, neighbours_by_position(points, distance, out, x, y, split), x, y, "inner", hot_rows)
