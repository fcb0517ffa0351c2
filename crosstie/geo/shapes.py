"""Shapes as tables: segments of lines, edges of polygons, and their grid cells.

Lines and polygons at rest are arrays of points; to compute, each becomes one row
per segment (``x1,y1,x2,y2``). A grid of square cells turns every spatial predicate
into an equi-join on the cell with a residual exact test, so no plan needs a nested
loop. A shape is listed under every cell its bounding box, grown by the search
distance, touches; a point has exactly one cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.geo.measure import ENDS, length, num

CELL = ("cx", "cy")
MIN_CELL = 500.0


def cell_size(distance: float) -> float:
    return max(float(distance), MIN_CELL)


def cell_of(v: str, size: float) -> str:
    """SQL for the grid number of a coordinate."""
    return f"floor(({v}) / {num(size)})"


def with_cell(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.selectExpr("*", f"{cell_of(x, size)} AS cx", f"{cell_of(y, size)} AS cy")


def segments_from_vertices(vertices: DataFrame, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """Consecutive vertices to segments, by an equi-join on (line, next number).

    The join key is unique per vertex, so one line holding most vertices does not
    gather in one task as it would under a window. Numbers must be consecutive.
    """
    ends = vertices.select(F.col(line), (F.col(seq) - 1).alias(seq), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return (vertices.withColumnsRenamed({"x": "x1", "y": "y1"}).join(ends, [line, seq])
            .select(line, seq, *ENDS))


def segments_from_points(lines: DataFrame, geometry: str = "points") -> DataFrame:
    """Array-of-points lines to segments; attributes are kept, no shuffle."""
    pts = F.col(geometry)
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1))),
        lambda i: F.struct(
            (i - 1).alias("seq"),
            F.get(pts, i - 1)["x"].alias("x1"), F.get(pts, i - 1)["y"].alias("y1"),
            F.get(pts, i)["x"].alias("x2"), F.get(pts, i)["y"].alias("y2")))
    rest = [c for c in lines.columns if c != geometry]
    return lines.where(F.size(pts) > 1).select(*rest, F.explode(pairs).alias("_s")).select(*rest, "_s.*")


def edges_from_rings(polygons: DataFrame, geometry: str = "rings") -> DataFrame:
    """Array-of-rings polygons to edges with the ring number; ring 0 is the outer one."""
    rest = [c for c in polygons.columns if c != geometry]
    rings = polygons.select(*rest, F.posexplode(geometry).alias("ring", "_points"))
    return segments_from_points(rings, "_points")


def cut_to_length(segments: DataFrame, longest: float) -> DataFrame:
    """Split segments into equal pieces no longer than ``longest`` (adds ``piece``)."""
    rest = [c for c in segments.columns if c not in ENDS]

    def at(a: str, b: str, i: str) -> str:
        return f"{a} + ({b} - {a}) * ({i} / _n)"

    def end(a: str, b: str) -> str:
        return f"CASE WHEN piece + 1 = _n THEN {b} ELSE {at(a, b, '(piece + 1)')} END"

    return (segments.selectExpr("*", f"greatest(CAST(ceil({length()} / {num(longest)}) AS INT), 1) AS _n")
            .selectExpr("*", "explode(sequence(0, _n - 1)) AS piece")
            .selectExpr(*rest, "piece", f"{at('x1', 'x2', 'piece')} AS x1", f"{at('y1', 'y2', 'piece')} AS y1",
                        f"{end('x1', 'x2')} AS x2", f"{end('y1', 'y2')} AS y2"))


def cover_box(df: DataFrame, xlo: str, ylo: str, xhi: str, yhi: str, size: float, grow: float = 0.0) -> DataFrame:
    """One row per cell touched by the box grown by ``grow``."""
    g = num(grow)
    return (df.selectExpr("*", f"explode(sequence({cell_of(f'{xlo} - {g}', size)}, {cell_of(f'{xhi} + {g}', size)})) AS cx")
            .selectExpr("*", f"explode(sequence({cell_of(f'{ylo} - {g}', size)}, {cell_of(f'{yhi} + {g}', size)})) AS cy"))


def cover_segments(segments: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """One row per (segment, cell near it).

    Long segments are followed step by step, so the number of cells grows with their
    length and not with the area of their bounding box. The box of a step moves along a
    straight line, so the steps that touch a cell follow one another: a cell is listed by
    the first of them, when the step before does not touch it.
    """
    g = num(grow)

    def span(a: str, b: str, step: str) -> tuple[str, str]:
        start, end = f"{a} + ({b} - {a}) * (({step}) / _n)", f"{a} + ({b} - {a}) * (({step} + 1) / _n)"
        return cell_of(f"least({start}, {end}) - {g}", size), cell_of(f"greatest({start}, {end}) + {g}", size)

    (xlo, xhi), (ylo, yhi) = span("x1", "x2", "_i"), span("y1", "y2", "_i")
    (pxlo, pxhi), (pylo, pyhi) = span("x1", "x2", "_i - 1"), span("y1", "y2", "_i - 1")
    return (segments.selectExpr("*", f"greatest(CAST(ceil({length()} / {num(size)}) AS INT), 1) AS _n")
            .selectExpr("*", "explode(sequence(0, _n - 1)) AS _i")
            .selectExpr("*", f"{pxlo} AS _pxlo", f"{pxhi} AS _pxhi", f"{pylo} AS _pylo", f"{pyhi} AS _pyhi",
                        f"{ylo} AS _ylo", f"{yhi} AS _yhi", f"explode(sequence({xlo}, {xhi})) AS cx")
            .selectExpr("*", "explode(sequence(_ylo, _yhi)) AS cy")
            .where("_i = 0 OR NOT (cx BETWEEN _pxlo AND _pxhi AND cy BETWEEN _pylo AND _pyhi)")
            .select(*segments.columns, *CELL))


def locations(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Distinct positions: copies of a point are worked out once."""
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("x"), F.col(y).alias("y")).distinct()


def boxes(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box per shape."""
    return edges.groupBy(*keys).agg(
        F.expr("min(least(x1, x2)) AS xlo"), F.expr("min(least(y1, y2)) AS ylo"),
        F.expr("max(greatest(x1, x2)) AS xhi"), F.expr("max(greatest(y1, y2)) AS yhi"))


def dissolve(segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge features into one: the set of distinct segments, direction ignored."""
    swap = "(x2 < x1 OR (x2 = x1 AND y2 < y1))"
    return segments.selectExpr(
        *keys, f"IF({swap}, x2, x1) AS x1", f"IF({swap}, y2, y1) AS y1",
        f"IF({swap}, x1, x2) AS x2", f"IF({swap}, y1, y2) AS y2").distinct()
