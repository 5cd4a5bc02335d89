"""Closed-form planar distances between points, segments, boxes and discs.

All distances are squared and in degrees. A box is a tuple of four columns
(xmin, ymin, xmax, ymax), a segment a tuple (x1, y1, x2, y2); a segment of
length zero is a point.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakecross.functions.units import DEGREE_METRES


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def points_d2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Between two points."""
    return (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)


def foot(px: Column, py: Column, segment) -> Column:
    """Share of the way along a segment, 0 to 1, that is nearest to a point."""
    x1, y1, x2, y2 = segment
    dx, dy = x2 - x1, y2 - y1
    length_d2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    at = F.coalesce(((px - x1) * dx + (py - y1) * dy) / length_d2, F.lit(0.0))
    return clamp(at, F.lit(0.0), F.lit(1.0))


def foot_d2(px: Column, py: Column, segment, at: Column) -> Column:
    """From a point to the point at a share of the way along a segment."""
    x1, y1, x2, y2 = segment
    return points_d2(x1 + at * (x2 - x1), y1 + at * (y2 - y1), px, py)


def _side_of(px: Column, py: Column, segment) -> Column:
    x1, y1, x2, y2 = segment
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def segments_cross(p, q) -> Column:
    """Whether two segments cross at an inner point of both."""
    return (_side_of(p[0], p[1], q) * _side_of(p[2], p[3], q) < 0) & (
        _side_of(q[0], q[1], p) * _side_of(q[2], q[3], p) < 0
    )


def point_box_d2(px: Column, py: Column, box) -> Column:
    """From a point to a box, zero inside."""
    return points_d2(px, py, clamp(px, box[0], box[2]), clamp(py, box[1], box[3]))


def point_box_far_d2(px: Column, py: Column, box) -> Column:
    """From a point to the farthest corner of a box."""
    dx = F.greatest(F.abs(box[0] - px), F.abs(box[2] - px))
    dy = F.greatest(F.abs(box[1] - py), F.abs(box[3] - py))
    return dx * dx + dy * dy


def line_crossing(p, q) -> Column:
    """Share of the way along p at which it crosses the line through q; NULL where they are parallel."""
    turn = (p[2] - p[0]) * (q[3] - q[1]) - (p[3] - p[1]) * (q[2] - q[0])
    return ((q[0] - p[0]) * (q[3] - q[1]) - (q[1] - p[1]) * (q[2] - q[0])) / F.nullif(turn, F.lit(0.0))


def side_offset(segment, r: Column) -> tuple[Column, Column]:
    """From a segment to the straight side of its buffer, at right angles; zero for a point."""
    x1, y1, x2, y2 = segment
    length = F.nullif(F.sqrt(points_d2(x1, y1, x2, y2)), F.lit(0.0))
    return F.coalesce(r * (y1 - y2) / length, F.lit(0.0)), F.coalesce(r * (x2 - x1) / length, F.lit(0.0))


def chord_parts(at: Column, a1: Column, b1: Column, a2: Column, b2: Column, r: Column, na: Column, nb: Column) -> list[Column]:
    """Of a buffered segment where axis b has the value ``at``: half the stretch of each end's circle along axis a, and
    the places of both sides; NULL where there is none. The segment runs from (a1, b1) to (a2, b2), and (na, nb) leads to its side."""
    gaps = [r * r - (at - b) * (at - b) for b in (b1, b2)]
    shares = [(at - b1 - nb) / F.nullif(b2 - b1, F.lit(0.0)), (at - b1 + nb) / F.nullif(b2 - b1, F.lit(0.0))]
    sides = [a1 + na + shares[0] * (a2 - a1), a1 - na + shares[1] * (a2 - a1)]
    return [F.when(g >= 0, F.sqrt(g)) for g in gaps] + [F.when(t.between(0.0, 1.0), s) for t, s in zip(shares, sides)]


def chord(parts: list[Column], a1: Column, a2: Column) -> tuple[Column, Column]:
    """The ends of the stretch along axis a, from its parts.

    The buffer is bounded by two circles and two sides, and is convex: the stretch reaches as far as any of the four.
    """
    return F.least(a1 - parts[0], a2 - parts[1], *parts[2:]), F.greatest(a1 + parts[0], a2 + parts[1], *parts[2:])


def square_metres(lat: Column) -> Column:
    """Square metres in one squared degree at a latitude."""
    return F.lit(DEGREE_METRES * DEGREE_METRES) * F.cos(F.radians(lat))


def all_of(conditions) -> Column:
    """Conjunction of several conditions, in the order given."""
    return reduce(lambda left, right: left & right, conditions)
