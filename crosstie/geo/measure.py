"""Planar distances and areas as SQL expressions on plain double columns.

Arguments are column names (or other SQL fragments) and the result is a fragment for
``expr``/``selectExpr``; a segment or edge is given as its four end columns.
"""

from __future__ import annotations

ENDS = ("x1", "y1", "x2", "y2")


def num(v: float) -> str:
    """A double literal."""
    return f"{float(v)!r}D"


def clamp01(t: str) -> str:
    return f"least(greatest({t}, 0D), 1D)"


def length(seg=ENDS) -> str:
    x1, y1, x2, y2 = seg
    return f"sqrt(power({x2} - {x1}, 2) + power({y2} - {y1}, 2))"


def point_segment_sq(x: str, y: str, seg=ENDS) -> str:
    """Squared distance of a point to a segment; a zero-length segment is a point."""
    x1, y1, x2, y2 = seg
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    along = f"({x} - {x1}) * {dx} + ({y} - {y1}) * {dy}"
    t = clamp01(f"coalesce(try_divide({along}, power({dx}, 2) + power({dy}, 2)), 0D)")
    return f"(power({x1} + {t} * {dx} - {x}, 2) + power({y1} + {t} * {dy} - {y}, 2))"


def side(seg, x: str, y: str) -> str:
    """Positive when (x, y) lies left of the segment's direction."""
    x1, y1, x2, y2 = seg
    return f"(({x2} - {x1}) * ({y} - {y1}) - ({y2} - {y1}) * ({x} - {x1}))"


def segments_cross(a, b) -> str:
    """Proper crossing of two segments; touching ends are covered by a zero distance."""
    def split(s, t):
        return f"(({side(s, t[0], t[1])} > 0) != ({side(s, t[2], t[3])} > 0))"
    return f"({split(b, a)} AND {split(a, b)})"


def segment_segment_sq(a, b) -> str:
    """Squared distance of two segments."""
    ends = ", ".join([point_segment_sq(a[0], a[1], b), point_segment_sq(a[2], a[3], b),
                      point_segment_sq(b[0], b[1], a), point_segment_sq(b[2], b[3], a)])
    return f"CASE WHEN {segments_cross(a, b)} THEN 0D ELSE least({ends}) END"


def ring_term(seg=ENDS) -> str:
    """One edge's share of twice the signed ring area."""
    x1, y1, x2, y2 = seg
    return f"({x1} * {y2} - {x2} * {y1})"


# Direction from which angles on a circle are counted. Any value works; an odd one keeps
# the reference point off edges that run along coordinate axes.
REFERENCE_ANGLE = 1.2345


def circle_edge_steps(x: str, y: str, radius: float, seg=ENDS) -> tuple[list[dict[str, str]], str]:
    """One edge's share of the area a ring has in common with a circle, in steps.

    The common area is bounded by the parts of edges inside the circle and by the arcs
    inside the ring. An edge gives the triangle under its inner part, and half r squared
    times the angle where it enters the circle (an arc ends there) minus the angle where
    it leaves (an arc starts there). The arcs close up if a full circle is added whenever
    the circle's point at the reference angle lies in the ring. Edges that stay outside
    the circle give nothing. Returned are helper columns to add step by step and the
    final expression over them.
    """
    x1, y1, x2, y2 = seg
    r2 = num(radius * radius)
    steps = [
        {"_ax": f"{x1} - {x}", "_ay": f"{y1} - {y}", "_bx": f"{x2} - {x}", "_by": f"{y2} - {y}"},
        {"_qa": "power(_bx - _ax, 2) + power(_by - _ay, 2)", "_qb": "_ax * (_bx - _ax) + _ay * (_by - _ay)",
         "_qc": f"power(_ax, 2) + power(_ay, 2) - {r2}", "_in2": f"power(_bx, 2) + power(_by, 2) < {r2}"},
        {"_disc": "_qb * _qb - _qa * _qc"},
        {"_t1": "coalesce(try_divide(-_qb - sqrt(greatest(_disc, 0D)), _qa), 0D)",
         "_t2": "coalesce(try_divide(-_qb + sqrt(greatest(_disc, 0D)), _qa), 0D)"},
        {"_px": f"_ax + {clamp01('_t1')} * (_bx - _ax)", "_py": f"_ay + {clamp01('_t1')} * (_by - _ay)",
         "_qx": f"_ax + {clamp01('_t2')} * (_bx - _ax)", "_qy": f"_ay + {clamp01('_t2')} * (_by - _ay)",
         "_chord": "_qc >= 0 AND NOT _in2 AND _disc > 0 AND _t1 > 0 AND _t2 < 1"},
    ]

    def angle(ux: str, uy: str) -> str:
        return f"pmod(atan2({uy}, {ux}) - {num(REFERENCE_ANGLE)}, 2 * pi())"

    enters = f"IF(_chord OR (_qc >= 0 AND _in2), {angle('_px', '_py')}, 0D)"
    leaves = f"IF(_chord OR (_qc < 0 AND NOT _in2), {angle('_qx', '_qy')}, 0D)"
    return steps, f"((_px * _qy - _py * _qx) / 2 + {r2} / 2 * ({enters} - {leaves}))"
