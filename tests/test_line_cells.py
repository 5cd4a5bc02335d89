"""Cells in which buffered lines really meet, and removal of covered cells before pairing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import pings_of
from wakecross.functions.grid import cell_of, cell_parent
from wakecross.operators import trajectories as T
from wakecross.operators.cover import compacted, disc_cover, outside_compacted
from wakecross.operators.harbours import encounters_outside, first_encounters, harbour_cells, outside_cells
from wakecross.operators.line_encounters import _shared_cells, line_encounters
from wakecross.operators.segments import meet_in_box, meeting
from wakecross.operators.summaries import line_heatmap

PAIR = [f"{c}_{n}" for n in "12" for c in ("x1", "y1", "x2", "y2", "r")]


def _distance(x, y, s):
    dx, dy = s[2] - s[0], s[3] - s[1]
    length = dx * dx + dy * dy
    at = np.clip(np.divide((x - s[0]) * dx + (y - s[1]) * dy, length, out=np.zeros_like(x + dx), where=length > 0), 0, 1)
    return np.hypot(s[0] + at * dx - x, s[1] + at * dy - y)


def _least(f, low, high, rounds=60):
    """Minimum of a convex function of one variable, by thirds."""
    for _ in range(rounds):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = f(a) < f(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return f((low + high) / 2)


def _excess(p, q, box):
    """How far the nearest point of the box lies outside one of both buffers; negative if inside both."""

    def worst(x, y):
        return np.maximum(_distance(x, y, p[:4]) - p[4], _distance(x, y, q[:4]) - q[4])

    return _least(lambda x: _least(lambda y: worst(x, y), box[1], box[3]), box[0], box[2])


def _cases(n=4_000):
    rng = np.random.default_rng(8)
    p, q = (np.concatenate([rng.uniform(0, 1, (4, n)), rng.uniform(0.02, 0.3, (1, n))]) for _ in range(2))
    kind = rng.integers(0, 8, n)
    p[2:4, kind == 0] = p[0:2, kind == 0]  # points
    q[2:4, kind <= 1] = q[0:2, kind <= 1]
    p[3, kind == 2] = p[1, kind == 2]  # level
    q[2, kind == 3] = q[0, kind == 3]  # upright
    q[0:4, kind == 4] = p[0:4, kind == 4] + 0.1  # parallel
    q[0:2, kind == 5] = p[2:4, kind == 5]  # end to end
    corner = rng.uniform(-0.2, 1, (2, n))
    return p, q, np.concatenate([corner, corner + rng.uniform(0.05, 0.4, (1, n))])


def test_buffers_and_cell_against_numeric_search(spark):
    p, q, box = _cases()
    excess = _excess(p, q, box)
    everywhere = _excess(p, q, np.array([[-2.0], [-2.0], [3.0], [3.0]]) + np.zeros_like(p[0]))
    rows = np.concatenate([np.arange(p.shape[1])[None], p, q, box]).T
    frame = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows], f"id int, {', '.join(f'{c} double' for c in (*PAIR, 'w', 's', 'e', 'n'))}")
    a, b = (tuple(F.col(f"{c}_{k}") for c in ("x1", "y1", "x2", "y2")) for k in "12")
    met = meeting(frame, a, b, F.col("r_1"), F.col("r_2"))
    points = {r.id: (r.meet_x, r.meet_y) for r in met.collect()}
    assert {i for i in range(len(excess)) if everywhere[i] < -1e-9} <= set(points) <= {i for i in range(len(excess)) if everywhere[i] < 1e-9}
    for i, (x, y) in points.items():
        assert _distance(np.array(x), np.array(y), p[:4, i]) <= p[4, i] + 1e-12 and _distance(np.array(x), np.array(y), q[:4, i]) <= q[4, i] + 1e-12
    found = {r.id for r in meet_in_box(met, a, b, F.col("r_1"), F.col("r_2"), [F.col(c) for c in "wsen"]).select("id").collect()}
    sure = {i for i in range(len(excess)) if excess[i] < -1e-9}
    assert sure <= found <= {i for i in range(len(excess)) if excess[i] < 1e-9} and 500 < len(found) < 3_500


PARTING = [(1, 0, 0.0, 0.001), (1, 60, 0.06, 0.0055), (2, 0, 0.0, -0.001), (2, 60, 0.06, -0.0055)]


def test_parting_tracks_meet_only_where_they_are_near(spark):
    """Both tracks run along one row of cells, but are within reach at its start alone."""
    buffered = T.buffered_segments(pings_of(spark, *PARTING), base=0.002, area_cap=None)
    cells = line_encounters(buffered, emit_level=14).count()
    tall = spark.createDataFrame([(0.0, 0.0, 0.03, "P")], "lon double, lat double, r double, name string")
    harbour = disc_cover(tall, 17).select("cell")
    assert cells <= 4
    assert line_encounters(buffered).count() > 4
    assert line_encounters(buffered, outside=harbour).count() == 0
    assert encounters_outside(line_encounters(buffered), harbour).count() == 0


@pytest.mark.parametrize("level, emit_level", [(15, 17), (17, 14), (12, 15)])
def test_cells_do_not_depend_on_the_level_of_the_join(spark, pings, level, emit_level):
    buffered = T.buffered_segments(pings)
    names = ("vessel_1", "vessel_2", "window_start", "index")
    want = {tuple(r) for r in line_encounters(buffered, emit_level=emit_level).select(*names).collect()}
    got = [tuple(r) for r in line_encounters(buffered, level=level, emit_level=emit_level, key_rows=50).select(*names).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leaving_cells_out_before_pairing(spark, pings):
    buffered = T.buffered_segments(pings)
    every = line_encounters(buffered)
    ports = spark.createDataFrame([("P", -119.99, 33.0, 0.03), ("Q", -119.95, 33.0012, 0.002)], "name string, lon double, lat double, r double")
    cells = harbour_cells(ports, None)
    names = ("vessel_1", "vessel_2", "window_start", "index")
    after = sorted(map(tuple, outside_cells(every, cells, "index").select(*names).collect()))
    before = sorted(map(tuple, line_encounters(buffered, outside=cells).select(*names).collect()))
    assert before == after and 0 < len(after) < every.count()
    with pytest.raises(ValueError):
        line_encounters(buffered, emit="point", outside=cells)


def _plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_covered_cells_go_below_the_join(spark, pings):
    cells = harbour_cells(spark.createDataFrame([("P", -119.99, 33.0, 0.05)], "name string, lon double, lat double, r double"), None)
    plan = _plan(line_encounters(T.buffered_segments(pings), outside=cells))
    lines = plan.split("\n")
    join = min(k for k, line in enumerate(lines) if "SortMergeJoin" in line and "window_start" in line)
    assert any("LeftAnti" in line for line in lines[join + 1 :]) and any("LeftAnti" in line for line in lines[:join])


def test_compacted_cover_holds_the_same_area(spark):
    discs = spark.createDataFrame([(10.0, 10.0, 0.09), (10.05, 10.02, 0.05), (-50.0, 3.0, 0.001)], "lon double, lat double, r double")
    cells = disc_cover(discs, 17).select("cell")
    compact = compacted(cells, 17, 14)
    assert compact.count() * 4 < cells.distinct().count()
    rng = random.Random(3)
    points = spark.createDataFrame([(10 + rng.uniform(-0.15, 0.15), 10 + rng.uniform(-0.15, 0.15)) for _ in range(2_000)], "lon double, lat double")
    rows = points.select("lon", "lat", cell_of(F.col("lon"), F.col("lat"), 17).alias("ix"))
    want = sorted(map(tuple, rows.join(cells.distinct(), F.col("ix") == F.col("cell"), "left_anti").collect()))
    assert sorted(map(tuple, outside_compacted(rows, compact, "ix", 17, 14).collect())) == want and 100 < len(want) < 1_900
    again = compact.select(F.explode(F.expr("CASE WHEN shiftrightunsigned(cell, 56) = 17 THEN array(cell) ELSE array() END")).alias("cell"))
    siblings = again.groupBy(cell_parent(F.col("cell"))).count()
    assert siblings.agg(F.max("count")).first()[0] < 4
    assert compacted(cells.limit(0), 17, 14).count() == 0 and compacted(cells, 17, 17).count() == cells.distinct().count()


def test_first_rows_of_pairs_and_cells(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.randrange(6, 12), rng.randrange(5), rng.randrange(8)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "vessel_1 int, vessel_2 int, window_start int, index long")
    pairs = {tuple(r)[:2]: tuple(r)[2:] for r in first_encounters(frame).collect()}
    for a, b, w, i in rows:
        assert pairs[a, b] <= (w, i) and (a, b, *pairs[a, b]) in rows
    cells = {r.ix: (r["count"], (r.window_start, r.vessel_1, r.vessel_2)) for r in line_heatmap(frame).collect()}
    for index, (count, first) in cells.items():
        own = [(w, a, b) for a, b, w, i in rows if i == index]
        assert (len(own), min(own)) == (count, first)
    for result in (first_encounters(frame), line_heatmap(frame, 100.0)):
        assert "SortAggregate" not in _plan(result) and "HashAggregate" in _plan(result)


def test_edges_along_a_row_of_cells_are_cut_once_a_row(spark):
    names = [f"{c}_{k}" for c in ("x1", "y1", "x2", "y2", "r", "west", "south", "east", "north") for k in "12"] + ["meet_x", "meet_y"]
    met = spark.createDataFrame([], ", ".join(f"{c} double" for c in names))
    steps = [x for x in _shared_cells(met, 17, None)._jdf.queryExecution().analyzed().toString().splitlines() if "Generate " in x]
    cells = next(k for k, x in enumerate(steps) if "Generate explode" in x)
    # The plan is written from its end: what comes before the listing of cells is below it.
    assert min(k for k, x in enumerate(steps) if "south_" in x) > cells
