"""Ping and line encounters: edge rows, splitting of hot keys, invariance."""

import random

import pytest
from pyspark.sql import functions as F

from rows import pings_of
from wakecross.functions.units import PING_RADIUS
from wakecross.operators import trajectories as T
from wakecross.operators.cover import capsule_cover, disc_cover
from wakecross.operators.harbours import encounters_outside, harbour_cells, outside_cells
from wakecross.operators.hot_keys import hot_keys
from wakecross.operators.joins import by_size
from wakecross.operators.line_encounters import line_encounters
from wakecross.operators.ping_encounters import ping_encounters
from wakecross.operators.summaries import busiest, encounter_heatmap, line_heatmap, paths, with_lines

R = PING_RADIUS


def pairs_of(frame, *names):
    return sorted(tuple(row) for row in frame.select(*(names or ("ping_1", "ping_2"))).collect())


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 0, 0, 0, 0.0), (2, 0, 0, 0, 0.0)], 0),  # both at rest: window 0
        ([(1, 0, 0, 0, 0.0), (2, 0, 0, 0, 1.0)], 1),
        ([(1, 0, 0, 0), (1, 0, 0, 0)], 0),  # one vessel
        ([(1, 0, 0, 0, None), (2, 0, 0, 0)], 0),  # unknown speed
        ([(1, 0, 0, 0, 20.0, None), (2, 0, 0, 0)], 0),  # unknown heading
        ([(1, 0, 0, 0, 20.0, 511.0), (2, 0, 0, 0, 20.0, 511.0)], 1),  # 511 counts as an angle
        ([(1, 0, 0.0, 0.0), (2, 0, R + R, 0.0)], 1),  # exactly touching
        ([(1, 0, 0.0, 0.0), (2, 0, (R + R) * 1.0000001, 0.0)], 0),
        ([(1, 0, 0.0, 0.0), (2, 12345, 0.0, 0.0)], 1),  # 40 km/h together: 12345.68 s
        ([(1, 0, 0.0, 0.0), (2, 12346, 0.0, 0.0)], 0),
        ([(1, 0, 180.0, 90.0), (2, 0, 180.0, 90.0)], 1),  # corners of the grid
        ([(1, 0, -180.0, -90.0), (2, 0, -180.0, -90.0)], 1),
        ([(1, 0, 0.0, 0.0, 1e9), (2, 40_000_000, 0.0, 0.0)], 1),  # a speed without sense
    ],
)
def test_ping_edges(spark, rows, expected):
    rows = [(m, t, float(x), float(y), *rest) for m, t, x, y, *rest in rows]
    assert ping_encounters(pings_of(spark, *rows)).count() == expected


def test_corrected_mode_keeps_vessels_at_rest(spark):
    near = pings_of(spark, (1, 0, 0.0, 0.0, 0.0, 511.0), (2, 899, 0.0, 0.0, 0.0, None), (3, 900, 0.0, 0.0, 0.0))
    assert pairs_of(ping_encounters(near, mode="corrected")) == [(0, 1), (1, 2)]


def _brute(rows, limit):
    found = []
    for i, (m, t, x, y) in enumerate(rows):
        for j, (n, u, v, w) in enumerate(rows):
            if m < n and (v - x) * (v - x) + (w - y) * (w - y) <= (R + R) * (R + R) and abs(t - u) <= limit:
                found.append((i, j))
    return sorted(found)


@pytest.mark.parametrize("level, key_rows", [(15, 20_000), (17, 20_000), (18, 7), (17, 1)])
def test_ping_pairs_equal_brute_force_at_any_level_and_split(spark, level, key_rows):
    rng = random.Random(5)
    # A third of all pings in one place.
    rows = [(rng.randrange(9), rng.randrange(3000), rng.uniform(0, 0.02), rng.uniform(0, 0.02)) for _ in range(160)]
    rows += [(rng.randrange(9), rng.randrange(3000), 0.01, 0.01) for _ in range(80)]
    frame = pings_of(spark, *rows)
    found = ping_encounters(frame, level=level, max_seconds=500, key_rows=key_rows)
    assert pairs_of(found) == _brute(rows, 500)


def test_shared_mode_names_the_same_pairs_and_splits_alike(spark, pings):
    point = ping_encounters(pings, max_seconds=300)
    shared = ping_encounters(pings, max_seconds=300, emit="shared")
    assert set(pairs_of(point)) == set(pairs_of(shared))
    split = ping_encounters(pings, max_seconds=300, emit="shared", key_rows=10)
    names = ("ping_1", "ping_2", "ix")
    assert pairs_of(shared, *names) == pairs_of(split, *names)


def test_leaving_cells_out_before_pairing_equals_leaving_out_after(spark, pings):
    cells = pings.where("mmsi % 2 = 0").select(F.col("ix").alias("cell")).distinct()
    before = ping_encounters(pings, max_seconds=300, emit="shared", outside=cells)
    after = outside_cells(ping_encounters(pings, max_seconds=300, emit="shared"), cells, "ix")
    names = ("ping_1", "ping_2", "ix")
    assert pairs_of(before, *names) == pairs_of(after, *names) != []
    with pytest.raises(ValueError):
        ping_encounters(pings, outside=cells)


def test_one_shuffle_serves_both_sides_of_the_join(spark, pings):
    result = ping_encounters(pings).groupBy().count()
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_keys_lists_only_large_keys(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 400, 0).otherwise(F.col("id"))).alias("k"))
    assert [tuple(r) for r in hot_keys(rows, ["k"], 100).collect()] == [(0, 400, 4)]


def test_hot_keys_are_listed_whatever_their_share(spark):
    rows = spark.range(3_000_000).select((F.col("id") / 3).cast("long").alias("k"))
    assert hot_keys(rows, ["k"], 2).count() == 1_000_000


# -- covers -------------------------------------------------------------------


def test_discs_hold_their_core_cells_and_small_discs_have_none(spark):
    discs = spark.createDataFrame([(1, 10.0, 10.0, 0.01), (2, 10.0, 10.0, 0.0009)], "id INT, lon DOUBLE, lat DOUBLE, r DOUBLE")
    cover = disc_cover(discs, 17)
    assert cover.where("id = 1 AND core").count() > 20
    assert cover.where("id = 2 AND core").count() == 0


def test_capsule_of_a_point_is_a_disc(spark):
    disc = spark.createDataFrame([(10.0, 10.0, 0.01)], "lon DOUBLE, lat DOUBLE, r DOUBLE")
    capsule = disc.selectExpr("lon AS x1", "lat AS y1", "lon AS x2", "lat AS y2", "r")
    names = ("cell", "core")
    assert pairs_of(disc_cover(disc, 17), *names) == pairs_of(capsule_cover(capsule, 17), *names)


def test_long_diagonal_capsule_cover(spark):
    """All cells of the bounding box, tested one by one, give the same cover."""
    segment = spark.createDataFrame([(0.01, 0.02, 1.7, 1.1, 0.004)], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, r DOUBLE")
    cover = capsule_cover(segment, 13).count()
    from wakecross.operators.cover import cell_box
    from wakecross.operators.segments import with_box_distances

    grid = segment.withColumn("ix", F.explode(F.sequence(F.lit(4090), F.lit(4145)))).withColumn(
        "iy", F.explode(F.sequence(F.lit(2040), F.lit(2080)))
    )
    near = with_box_distances(grid, tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), cell_box(13))
    assert near.where(F.col("near_d2") <= F.col("r") * F.col("r")).count() == cover > 50


# -- trajectories -------------------------------------------------------------


def test_equal_times_are_ordered_by_id_and_windows_are_half_open(spark):
    frame = pings_of(spark, (1, 5, 3.0, 0.0), (1, 5, 2.0, 0.0), (1, 0, 1.0, 0.0), (1, 900, 9.0, 0.0))
    lines = T.trajectories(frame).orderBy("window_start").collect()
    assert [[p.lon for p in line.points] for line in lines] == [[1.0, 3.0, 2.0], [9.0]]
    segments = T.trajectory_segments(frame)
    assert pairs_of(segments, "x1", "x2") == [(1.0, 3.0), (3.0, 2.0), (9.0, 9.0)]


def test_cut_lines_give_the_same_segments(spark, pings):
    hot = pings.withColumn("mmsi", F.when(F.col("ping_id") % 3 == 0, F.lit(7)).otherwise(F.col("mmsi")))
    columns = ("mmsi", "window_start", "ping_id", "x1", "y1", "x2", "y2", "n_points", "r")
    whole = T.buffered_segments(hot, area_cap=None)
    cut = T.buffered_segments(hot, area_cap=None, part_rows=5)
    assert cut.select("part").distinct().count() > 1
    assert pairs_of(whole, *columns) == pairs_of(cut, *columns)
    sizes = ("mmsi", "window_start", "xmin", "ymin", "xmax", "ymax", F.round("length", 9))
    assert pairs_of(whole.distinct(), *sizes) == pairs_of(cut.distinct(), *sizes)
    capped = [pairs_of(T.buffered_segments(hot, area_cap=2e7, part_rows=n), "ping_id") for n in (5, 50_000)]
    assert capped[0] == capped[1] and len(capped[0]) < whole.count()


@pytest.mark.parametrize("part_rows", [1, 5])
def test_lines_do_not_depend_on_the_size_of_parts(spark, pings, part_rows):
    hot = pings.withColumn("mmsi", F.when(F.col("ping_id") % 3 == 0, F.lit(7)).otherwise(F.col("mmsi")))

    def lines(n):
        rows = T.trajectories(hot, part_rows=n).collect()
        return sorted((r.mmsi, r.window_start, r.window_end, r.n_points, r.points) for r in rows)

    assert lines(part_rows) == lines(50_000) and max(x[3] for x in lines(50_000)) > 5
    thin = [pairs_of(T.thinned(hot, 0.0005, part_rows=n), "ping_id") for n in (part_rows, 50_000)]
    assert thin[0] == thin[1] and len(thin[0]) < hot.count()


def test_only_named_lines_are_read(spark, pings):
    some = pings.where("mmsi % 5 = 0").select("mmsi", F.window("ts", "15 minutes").start.alias("window_start")).distinct().limit(3)
    lines = T.trajectories(pings, only=some)
    assert lines.count() == 3 and pairs_of(lines, "mmsi", "window_start") == pairs_of(some, "mmsi", "window_start")


def test_thinning_drops_points_on_the_chord(spark):
    frame = pings_of(spark, (1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0001), (1, 2, 2.0, 0.0), (1, 3, 3.0, 1.0))
    assert pairs_of(T.thinned(frame, 0.001), "ping_id") == [(0,), (2,), (3,)]


# -- line encounters ------------------------------------------------------------


def _buffered(spark, *rows, r=0.002):
    return T.buffered_segments(pings_of(spark, *rows), area_cap=None, base=r)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 0, 0.0, 0.0), (1, 60, 0.1, 0.1), (2, 0, 0.0, 0.1), (2, 60, 0.1, 0.0)], 1),  # crossing
        ([(1, 0, 0.0, 0.0), (1, 60, 0.1, 0.0), (2, 0, 0.05, 0.0), (2, 60, 0.2, 0.0)], 1),  # collinear
        ([(1, 0, 0.0, 0.0), (1, 60, 0.1, 0.0), (2, 0, 0.0, 0.004), (2, 60, 0.1, 0.004)], 1),  # touching
        ([(1, 0, 0.0, 0.0), (1, 60, 0.1, 0.0), (2, 0, 0.0, 0.0041), (2, 60, 0.1, 0.0041)], 0),
        ([(1, 0, 0.0, 0.0), (1, 60, 0.1, 0.0), (2, 0, 0.05, 0.002)], 1),  # a single point, wider
        ([(1, 0, 0.0, 0.0), (2, 900, 0.0, 0.0)], 0),  # other window
        ([(1, 0, 0.0, 0.0), (1, 60, 9.0, 7.0), (2, 0, 0.0, 7.0), (2, 60, 9.0, 0.0)], 1),  # long
    ],
)
def test_line_edges(spark, rows, expected):
    buffered = _buffered(spark, *rows)
    assert line_encounters(buffered, emit="point").count() == expected
    cells = line_encounters(buffered)
    assert cells.select("vessel_1").distinct().count() == expected


@pytest.mark.parametrize("level, key_rows", [(12, 20_000), (15, 20_000), (14, 3)])
def test_line_pairs_do_not_depend_on_level_or_split(spark, pings, level, key_rows):
    buffered = T.buffered_segments(pings)
    names = ("vessel_1", "vessel_2", "window_start")
    expected = pairs_of(line_encounters(buffered, emit="point"), *names)
    found = line_encounters(buffered, level=level, emit="point", key_rows=key_rows)
    assert pairs_of(found, *names) == expected and len(expected) == 162
    cells = pairs_of(line_encounters(buffered), *names, "index")
    assert pairs_of(line_encounters(buffered, level=level, key_rows=key_rows), *names, "index") == cells


def test_a_given_largest_line_sets_the_radius(spark, pings):
    wide = T.buffered_segments(pings, most=18, area_cap=None).agg(F.max("r")).first()[0]
    assert wide == pytest.approx(2 * T.buffered_segments(pings, area_cap=None).agg(F.max("r")).first()[0])


def test_area_cap_drops_wide_lines(spark):
    rows = [(1, k, 0.0, 0.0) for k in range(200)] + [(2, 0, 5.0, 0.0)]
    kept = T.buffered_segments(pings_of(spark, *rows))
    assert pairs_of(kept.select("mmsi").distinct(), "mmsi") == [(1,)]


# -- harbours and summaries -----------------------------------------------------


def test_harbour_rows_are_judged_one_by_one(spark):
    candidates = spark.createDataFrame(
        [(1, 2, 0, 10), (1, 2, 0, 11), (3, 4, 0, 10)], "vessel_1 INT, vessel_2 INT, window_start INT, index LONG"
    )
    cells = spark.createDataFrame([("P", 10), ("Q", 10)], "name STRING, cell LONG")
    assert pairs_of(encounters_outside(candidates, cells), "vessel_1", "vessel_2", "index") == [(1, 2, 11)]


def test_harbours_near_each_other_both_list_a_cell(spark):
    ports = spark.createDataFrame([("P", 10.0, 10.0), ("Q", 10.001, 10.0)], "name STRING, lon DOUBLE, lat DOUBLE")
    cells = harbour_cells(ports)
    assert cells.count() > cells.select("cell").distinct().count()


def test_heatmaps(spark):
    rows = spark.createDataFrame([(1, "a", "b")] * 3 + [(1, "a", "c"), (2, "a", "b")], "ix LONG, vessel_1 STRING, vessel_2 STRING")
    top = busiest(encounter_heatmap(rows), 2)
    assert [tuple(r) for r in top.collect()] == [(1, "a", "b", 3), (1, "a", "c", 1)]
    lines = spark.createDataFrame([(2, 3, 1, 7), (1, 2, 2, 7), (1, 2, 2, 8)], "vessel_1 INT, vessel_2 INT, window_start INT, index LONG")
    assert [tuple(r) for r in line_heatmap(lines).collect()] == [(7, 2, 2, 3, 1), (8, 1, 1, 2, 2)]
    assert line_heatmap(lines, below=2).count() == 1


def test_lines_of_pairs(spark):
    frame = pings_of(spark, (1, 0, 0.5, 0.0), (1, 600, 0.25, 0.0), (2, 0, 1.0, 0.0), (3, 0, 1.0, 0.0))
    pairs = line_encounters(T.buffered_segments(frame, base=1.0, area_cap=None), emit="point").where("vessel_2 = 2")
    lines = T.trajectories(frame)
    row = with_lines(pairs, lines).first()
    assert (row.line_1, row.line_2) == ("LINESTRING(0.5 0.0,0.25 0.0)", "LINESTRING(1.0 0.0)")
    assert paths(pairs, lines).count() == 2
    cut = with_lines(pairs, T.trajectories(frame, part_rows=1)).first()
    assert (cut.line_1, cut.line_2) == (row.line_1, row.line_2)


def test_sides_are_broadcast_by_their_counted_size(spark):
    cells = spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(100))).alias("ix"))
    rows = spark.range(5).select(F.col("id").alias("ix"))

    def plan(limit):
        joined = rows.join(by_size(cells, limit), "ix", "left_anti")
        return joined._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(1000)
    assert "SortMergeJoin" in plan(999)
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1_000).alias("text"))
    for size, kind in ((10_000, "BroadcastHashJoin"), (9_999, "SortMergeJoin")):
        joined = spark.range(20).join(by_size(wide, size=size), "id")
        assert kind in joined._jdf.queryExecution().executedPlan().toString()
