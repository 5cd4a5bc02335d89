"""Areas of buffers that overlap themselves, and the cap on them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import pings_of
from wakecross.functions.geometry import square_metres
from wakecross.operators import trajectories as T
from wakecross.operators.areas import area_bounds, swept_areas

SCHEMA = "line int, x1 double, y1 double, x2 double, y2 double, r double, xmin double"


def _raster(segments, r, cells=900):
    """Share of a raster's points within r of any segment, times the raster's size."""
    xs = [v for s in segments for v in (s[0], s[2])]
    ys = [v for s in segments for v in (s[1], s[3])]
    x, y = (np.linspace(min(v) - r, max(v) + r, 2 * cells + 1)[1::2] for v in (xs, ys))
    gx, gy = np.meshgrid(x, y)
    near = np.zeros(gx.shape, bool)
    for x1, y1, x2, y2 in segments:
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        at = np.clip(((gx - x1) * dx + (gy - y1) * dy) / length, 0, 1) if length else 0.0
        near |= (x1 + at * dx - gx) ** 2 + (y1 + at * dy - gy) ** 2 <= r * r
    return near.mean() * (max(xs) - min(xs) + 2 * r) * (max(ys) - min(ys) + 2 * r)


def _chain(points):
    return [(*a, *b) for a, b in zip(points, points[1:])] or [(*points[0], *points[0])]


def test_areas_against_a_raster(spark):
    rng = random.Random(2)
    lines = [_chain([(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(rng.randrange(1, 12))]) for _ in range(30)]
    lines += [_chain([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]), _chain([(0.5, 0.0), (0.5, 1.0), (0.5, 0.2)]), _chain([(0.1, 0.1)])]
    radii = [rng.uniform(0.02, 0.5) for _ in lines]
    rows = [(k, *s, r, min(min(t[0], t[2]) for t in line)) for k, (line, r) in enumerate(zip(lines, radii)) for s in line]
    got = {r.line: r.area for r in swept_areas(spark.createDataFrame(rows, SCHEMA), ["line"]).collect()}
    for k, (line, r) in enumerate(zip(lines, radii)):
        assert got[k] == pytest.approx(_raster(line, r), rel=4e-3)
    assert got[len(lines) - 1] == pytest.approx(math.pi * radii[-1] ** 2, rel=1e-4)


def test_bounds_hold_the_area(spark):
    rng = random.Random(4)
    rows, sizes = [], []
    for k in range(40):
        points = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(rng.randrange(1, 8))]
        r, chain = rng.uniform(0.01, 0.8), _chain(points)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        length = sum(math.dist(s[:2], s[2:]) for s in chain)
        rows += [(k, *s, r, min(xs)) for s in chain]
        sizes.append((k, r, length, max(xs) - min(xs), max(ys) - min(ys)))
    low, high = area_bounds(*(F.col(c) for c in "rlwh"))
    bounds = spark.createDataFrame(sizes, "line int, r double, l double, w double, h double").select("line", low.alias("low"), high.alias("high"))
    joined = swept_areas(spark.createDataFrame(rows, SCHEMA), ["line"]).join(bounds, "line")
    assert joined.count() == 40
    assert joined.where("area < low * 0.9999 OR area > high * 1.0001").count() == 0


def test_a_line_that_doubles_back_is_kept_by_its_true_area(spark):
    """Eight passes over one stretch: the sum over segments is far above the cap, and so is the box around the bend."""
    stretch = [(0.0, 0.0), (0.05, 0.05)]
    track = pings_of(spark, *[(1, k, *stretch[k % 2]) for k in range(9)], (2, 0, 5.0, 0.0), (3, 0, 7.0, 0.0), (3, 60, 7.2, 0.0))
    segments = T.buffered_segments(track, base=0.002, area_cap=None)
    first = segments.where("mmsi = 1").first()
    length = math.hypot(0.05, 0.05)
    area = 2 * first.r * length + math.pi * first.r**2
    metres = spark.range(1).select(square_metres(F.lit(0.025))).first()[0]

    def kept(cap):
        return {r.mmsi for r in T.buffered_segments(track, base=0.002, area_cap=cap).select("mmsi").distinct().collect()}

    assert 1 in kept(area * metres * 1.001) and 1 not in kept(area * metres * 0.999)
    # The bound by which it was judged before is over twice its area.
    assert min(2 * first.r * 8 * length, (0.05 + 2 * first.r) ** 2) > 2 * area
    assert kept(1e12) == {1, 2, 3}


def test_the_cap_does_not_depend_on_parts(spark, pings):
    hot = pings.withColumn("mmsi", F.when(F.col("ping_id") % 3 == 0, F.lit(7)).otherwise(F.col("mmsi")))
    kept = [sorted(map(tuple, T.buffered_segments(hot, area_cap=4e6, part_rows=n).select("ping_id").collect())) for n in (4, 50_000)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < T.buffered_segments(hot, area_cap=None).count()
