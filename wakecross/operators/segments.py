"""Distances of segments to each other and to boxes, for whole frames."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakecross.functions import geometry as G
from wakecross.operators.steps import let


def _ends(segment):
    return [(segment[0], segment[1]), (segment[2], segment[3])]


def meeting(pairs: DataFrame, p, q, r_p: Column, r_q: Column) -> DataFrame:
    """Rows whose segments p and q, buffered by r_p and r_q, meet, with a point (meet_x, meet_y) of both buffers.

    Segments that do not cross are nearest at an end of one of them. The point
    parts the way between the nearest points in the ratio of the radii.
    """
    columns = pairs.columns
    tries = [(x, y, q) for x, y in _ends(p)] + [(x, y, p) for x, y in _ends(q)]
    feet = {f"at{k}_": G.foot(x, y, segment) for k, (x, y, segment) in enumerate(tries)}
    stepped = let(pairs, **feet)
    distances = {f"d{k}_": G.foot_d2(x, y, s, F.col(f"at{k}_")) for k, (x, y, s) in enumerate(tries)}
    stepped = let(stepped, crossing_=G.segments_cross(p, q), **distances)
    nearest, reach = F.least(*distances), r_p + r_q
    met = stepped.where((nearest <= reach * reach) | F.col("crossing_"))
    # Toward the segment that has the foot, by the share of the other one's radius.
    meet = []
    for axis in (0, 1):
        crossed = p[axis] + G.line_crossing(p, q) * (p[axis + 2] - p[axis])
        value = None
        for k, (x, y, segment) in reversed(list(enumerate(tries))):
            end, own = (x, y)[axis], r_p if k < 2 else r_q
            foot = segment[axis] + F.col(f"at{k}_") * (segment[axis + 2] - segment[axis])
            between = end + (foot - end) * F.coalesce(own / F.nullif(reach, F.lit(0.0)), F.lit(0.5))
            value = between if value is None else F.when(F.col(f"d{k}_") == nearest, between).otherwise(value)
        meet.append(F.when(F.col("crossing_"), F.coalesce(crossed, value)).otherwise(value))
    return let(met, meet_x=meet[0], meet_y=meet[1]).select(*columns, "meet_x", "meet_y")


def with_offsets(pairs: DataFrame, p, q, r_p: Column, r_q: Column) -> DataFrame:
    """Adds what ``with_stretches`` needs of each buffer, once per pair."""
    offsets = {"p": G.side_offset(p, r_p), "q": G.side_offset(q, r_q)}
    return let(pairs, **{f"n{axis}_{n}": offset[k] for n, offset in offsets.items() for k, axis in enumerate("xy")})


def with_stretches(rows: DataFrame, p, q, r_p: Column, r_q: Column, axis: str, **edges: Column) -> DataFrame:
    """Adds each edge, a line along the axis, and the stretch <edge>from to <edge>to of it in both buffers; NULL if one has none.

    ``rows`` come from ``with_offsets``. Edges of a row of cells are best cut before its cells are listed.
    """
    a, b = (0, 1) if axis == "x" else (1, 0)
    sides = {"p": (p, r_p), "q": (q, r_q)}
    stepped = let(rows, **edges)
    # One edge a step: a generated method with all of them would be too long to be compiled to machine code.
    for edge in edges:
        parts = {}
        for n, (s, r) in sides.items():
            normal = [F.col(f"n{'xy'[k]}_{n}") for k in (a, b)]
            parts |= {f"{edge}{n}{k}": v for k, v in enumerate(G.chord_parts(F.col(edge), s[a], s[b], s[a + 2], s[b + 2], r, *normal))}
        stepped = let(stepped, **parts)
        ends = {}
        for n, (s, _) in sides.items():
            ends |= dict(zip((f"{edge}low_{n}", f"{edge}high_{n}"), G.chord([F.col(f"{edge}{n}{k}") for k in range(4)], s[a], s[a + 2])))
        stepped = let(stepped, **ends).drop(*parts)
        touched = F.col(f"{edge}low_p").isNotNull() & F.col(f"{edge}low_q").isNotNull()
        both = {"from": F.greatest(f"{edge}low_p", f"{edge}low_q"), "to": F.least(f"{edge}high_p", f"{edge}high_q")}
        stepped = let(stepped, **{f"{edge}{end}": F.when(touched, value) for end, value in both.items()}).drop(*ends)
    return stepped


def meeting_in_box(cells: DataFrame) -> DataFrame:
    """Rows of ``meeting`` in which the buffers of p and q and a box have a point in common.

    Both buffers are convex, and so is what they share. If it reaches into the box, it lies there whole, and
    then so does the known point, or it passes an edge of the box: on that edge the stretches of both buffers overlap.
    ``cells`` has the box's edges west_, south_, east_, north_ from ``with_stretches``.
    """
    x, y = F.col("meet_x"), F.col("meet_y")
    inside = (x >= F.col("west_")) & (x <= F.col("east_")) & (y >= F.col("south_")) & (y <= F.col("north_"))
    tests = [inside]
    along = {"south_": ("west_", "east_"), "north_": ("west_", "east_"), "west_": ("south_", "north_"), "east_": ("south_", "north_")}
    for edge, (low, high) in along.items():
        starts, ends = F.greatest(f"{edge}from", low), F.least(f"{edge}to", high)
        tests.append(F.col(f"{edge}from").isNotNull() & (starts <= ends))
    return cells.where(reduce(lambda left, right: left | right, tests))


def meet_in_box(met: DataFrame, p, q, r_p: Column, r_q: Column, box) -> DataFrame:
    """``meeting_in_box`` for rows that each have a box of their own."""
    buffers = (p, q, r_p, r_q)
    rows = with_stretches(with_offsets(met, *buffers), *buffers, "x", south_=box[1], north_=box[3])
    return meeting_in_box(with_stretches(rows, *buffers, "y", west_=box[0], east_=box[2])).select(*met.columns)


def with_box_distances(rows: DataFrame, segment, box) -> DataFrame:
    """Adds near_d2 and far_d2, from a segment to a box and to its farthest corner.

    A segment that runs through a box without ending in it crosses one of the
    box's diagonals, because it parts the corners into two sets.
    """
    columns = rows.columns
    stepped = let(rows, west_=box[0], south_=box[1], east_=box[2], north_=box[3])
    west, south, east, north = (F.col(c) for c in ("west_", "south_", "east_", "north_"))
    corners = [(x, y) for x in (west, east) for y in (south, north)]
    stepped = let(stepped, **{f"at{k}_": G.foot(x, y, segment) for k, (x, y) in enumerate(corners)})
    stepped = let(
        stepped,
        **{f"d{k}_": G.foot_d2(x, y, segment, F.col(f"at{k}_")) for k, (x, y) in enumerate(corners)},
    )
    through = G.segments_cross(segment, (west, south, east, north)) | G.segments_cross(
        segment, (west, north, east, south)
    )
    ends = [G.point_box_d2(x, y, (west, south, east, north)) for x, y in _ends(segment)]
    near = F.when(through, F.lit(0.0)).otherwise(F.least(*ends, "d0_", "d1_", "d2_", "d3_"))
    return let(stepped, near_d2=near, far_d2=F.greatest("d0_", "d1_", "d2_", "d3_")).select(
        *columns, "near_d2", "far_d2"
    )
