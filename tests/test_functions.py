"""Grid, geometry, motion and scale."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakecross.functions import grid
from wakecross.functions.motion import half_window, time_window
from wakecross.functions.scale import ZOOM_METRES, geodesic_metres, meridian_metres, zoom_level
from wakecross.functions.text import binary_extent, binary_srid, double_bytes, geojson_extent, line_wkb, point_wkb, wkt_extent
from wakecross.operators.discs import discs_meet_in_box
from wakecross.operators.extent import point_extent, zoom_info
from wakecross.operators.layers import Form, geometry_layer
from wakecross.operators.segments import meeting, with_box_distances

SEGMENT = ("x1", "y1", "x2", "y2")


def columns(names):
    return tuple(F.col(n) for n in names)


@pytest.mark.parametrize("level", [1, 14, 17, 27])
def test_cell_of_point_round_trip(spark, level):
    rng = random.Random(level)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)]
    points += [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (-0.0, 89.999999)]
    frame = spark.createDataFrame(points, "lon DOUBLE, lat DOUBLE")
    cell = grid.cell_of(F.col("lon"), F.col("lat"), level)
    box = grid.cell_bounds(F.col("cell"))
    rows = frame.withColumn("cell", cell).withColumns(
        {"box": box, "level": grid.cell_level(F.col("cell")), "up": grid.cell_parent(F.col("cell")),
         "outer": grid.cell_of(F.col("lon"), F.col("lat"), level - 1)}
    ).collect()
    for row in rows:
        assert row.level == level
        assert row.box.xmin <= row.lon <= row.box.xmax
        assert row.box.ymin <= row.lat <= row.box.ymax
        assert row.up == row.outer


def test_cell_ids_sort_in_z_order(spark):
    ids = spark.range(4).select(
        grid.cell_id(F.col("id").bitwiseAND(1), F.shiftright("id", 1), 5).alias("c")
    ).collect()
    assert [r.c - ids[0].c for r in ids] == [0, 1, 2, 3]


def _segments(rng, n):
    pick = lambda: rng.choice([rng.uniform(-1, 1), rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])])
    return [tuple(pick() for _ in range(n)) for _ in range(400)]


def _along(x1, y1, x2, y2, steps=801):
    t = np.linspace(0, 1, steps)
    return np.stack([x1 + t * (x2 - x1), y1 + t * (y2 - y1)], axis=1)


def test_meeting_segments_against_dense_points(spark):
    rows = _segments(random.Random(1), 8)
    names = [f"{c}{k}" for k in "pq" for c in SEGMENT]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id INT, " + ", ".join(f"{n} DOUBLE" for n in names))
    for reach in (0.05, 0.3):
        met = {r.id for r in meeting(frame, columns(names[:4]), columns(names[4:]), F.lit(reach) / 2, F.lit(reach) / 2).collect()}
        for k, r in enumerate(rows):
            p, q = _along(*r[:4], 201), _along(*r[4:], 201)
            nearest = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min()
            if nearest <= reach:
                assert k in met
            elif nearest > reach + 0.02:
                assert k not in met


@pytest.mark.parametrize(
    "p, q, distance",
    [
        ((0, 0, 1, 1), (0, 1, 1, 0), 0),  # crossing
        ((0, 0, 2, 0), (1, 0, 3, 0), 0),  # collinear, overlapping
        ((0, 0, 1, 0), (0, 2, 1, 2), 2),  # parallel apart
        ((0, 0, 0, 0), (3, 4, 3, 4), 5),  # two points
        ((0, 0, 0, 0), (-1, 1, 1, 1), 1),  # point and segment
        ((0, 0, 1, 0), (2, 0, 3, 0), 1),  # collinear, apart
    ],
)
def test_meeting_edge_cases(spark, p, q, distance):
    names = [f"{c}{k}" for k in "pq" for c in SEGMENT]
    frame = spark.createDataFrame([tuple(map(float, p + q))], ", ".join(f"{n} DOUBLE" for n in names))
    for reach, expected in ((float(distance), 1), (distance - 1e-9, 0)):
        if reach < 0:
            continue
        assert meeting(frame, columns(names[:4]), columns(names[4:]), F.lit(reach) / 2, F.lit(reach) / 2).count() == expected


def test_box_distances_against_dense_points(spark):
    rows = _segments(random.Random(2), 4)
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    box = (-0.3, -0.2, 0.4, 0.1)
    for row in with_box_distances(frame, columns(SEGMENT), tuple(map(F.lit, box))).collect():
        points = _along(row.x1, row.y1, row.x2, row.y2)
        inside = np.clip(points, box[:2], box[2:])
        near = np.sqrt(((points - inside) ** 2).sum(1)).min()
        corners = np.array([(x, y) for x in box[::2] for y in box[1::2]])
        far = np.sqrt(((points[:, None] - corners[None]) ** 2).sum(-1)).min(0).max()
        assert math.sqrt(row.near_d2) == pytest.approx(near, abs=4e-3)
        assert math.sqrt(row.far_d2) == pytest.approx(far, abs=4e-3)


def test_discs_in_box_against_dense_points(spark):
    rng = random.Random(3)
    rows = [(k, *(rng.uniform(-1, 1) for _ in range(4)), rng.uniform(0.1, 1), rng.uniform(0.1, 1)) for k in range(400)]
    rows += [(400, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5), (401, 0.9, 0.0, 0.9, 0.0, 0.1, 0.1)]
    frame = spark.createDataFrame(rows, "id INT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE, ra DOUBLE, rb DOUBLE")
    box = (-0.3, -0.2, 0.4, 0.3)
    met = {
        r.id
        for r in discs_meet_in_box(
            frame, columns(("ax", "ay", "ra")), columns(("bx", "by", "rb")), tuple(map(F.lit, box))
        ).collect()
    }
    xs, ys = np.meshgrid(np.linspace(box[0], box[2], 401), np.linspace(box[1], box[3], 401))
    for k, ax, ay, bx, by, ra, rb in rows:
        depth = np.maximum(np.hypot(xs - ax, ys - ay) - ra, np.hypot(xs - bx, ys - by) - rb).min()
        if depth <= 0:
            assert k in met
        elif depth > 2e-3:
            assert k not in met
    assert 400 in met and 401 not in met


def _window(spark, s1, s2, h1, h2, mode):
    frame = spark.createDataFrame([(s1, s2, h1, h2)], "s1 DOUBLE, s2 DOUBLE, h1 DOUBLE, h2 DOUBLE")
    return frame.select(time_window(*columns(("s1", "s2", "h1", "h2")), 0.0009, mode).alias("w")).first().w


def test_reference_window_takes_headings_as_radians_and_adds_velocities(spark):
    assert _window(spark, 20.0, 0.0, 0.0, 0.0, "reference") == pytest.approx(6172.8, abs=0.1)
    same, opposite = _window(spark, 10.0, 10.0, 1.0, 1.0, "reference"), _window(spark, 10.0, 10.0, 1.0, 1.0 + math.pi, "reference")
    assert same > 6000 and opposite < 1e-6
    assert _window(spark, 10.0, 10.0, 0.0, 180.0, "reference") > 1  # degrees are not understood


def test_reference_window_at_rest_and_unknown(spark):
    assert _window(spark, 0.0, 0.0, 10.0, 10.0, "reference") == 0
    assert _window(spark, None, 1.0, 0.0, 0.0, "reference") is None
    assert _window(spark, 1.0, 1.0, None, 0.0, "reference") is None


def test_corrected_window(spark):
    assert _window(spark, 0.0, 0.0, 10.0, 10.0, "corrected") == 900
    assert _window(spark, 7.2, 0.0, 90.0, 0.0, "corrected") == pytest.approx(100)
    assert _window(spark, 300.0, 300.0, 0.0, 180.0, "corrected") == 60
    assert _window(spark, 7.2, 14.4, 511.0, 90.0, "corrected") == pytest.approx(100)
    assert _window(spark, 7.2, 14.4, None, 90.0, "corrected") == pytest.approx(100)


@pytest.mark.parametrize("mode", ["reference", "corrected"])
def test_half_windows_bound_the_window(spark, mode):
    rng = random.Random(4)
    rows = [tuple(rng.uniform(0, 60) for _ in range(2)) + tuple(rng.uniform(0, 511) for _ in range(2)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "s1 DOUBLE, s2 DOUBLE, h1 DOUBLE, h2 DOUBLE")
    window = time_window(*columns(("s1", "s2", "h1", "h2")), 0.0009, mode)
    halves = half_window(F.col("s1"), 0.0009, mode) + half_window(F.col("s2"), 0.0009, mode)
    assert frame.where(window + 1 > halves).count() == 0


def test_golden_extent_sizes(spark):
    row = spark.range(1).select(
        geodesic_metres(F.lit(-100.5), F.lit(50.05), F.lit(-100.25), F.lit(50.05)).alias("w"),
        meridian_metres(F.lit(50.05), F.lit(50.5)).alias("h"),
    ).first()
    assert row.h == pytest.approx(50055.461463, abs=1e-5)
    assert row.w == pytest.approx(17905.334, abs=1e-3)


@pytest.mark.parametrize(
    "ends, metres, within",
    [
        ((0.0, 0.0, 90.0, 0.0), 10_018_754.171, 1e-3),  # a quarter of the equator
        ((7.0, 0.0, 7.0, 90.0), 10_001_965.729, 1e-3),  # a quarter of a meridian
        ((-73.8, 40.6, -0.5, 51.6), 5_551_759.400, 1e-3),  # a published example
        ((10.0, -20.0, 10.0, -20.0), 0.0, 0.0),
        ((-180.0, 10.0, 180.0, 10.0), 0.0, 1e-6),  # one point, written in two ways
        ((170.0, 5.0, -170.0, 5.0), 2_217_671.0, 3_000.0),  # over the antimeridian
        ((0.0, 0.0, 180.0, 0.0), 20_003_931.459, 1e-3),  # opposite points: over a pole
        ((0.0, 0.5, 179.7, 0.0), 19_944_127.0, 40_000.0),  # nearly opposite: the bound over a pole
    ],
)
def test_geodesics(spark, ends, metres, within):
    there, back = spark.range(1).select(
        geodesic_metres(*map(F.lit, ends)), geodesic_metres(*map(F.lit, ends[2:] + ends[:2]))
    ).first()
    assert there == pytest.approx(metres, abs=within + 1e-9) and back == pytest.approx(there, abs=1e-6)


def test_wide_extents_get_the_zoom_of_the_geodesic(spark):
    rows = spark.createDataFrame([(-170.0, 18.0), (-65.0, 18.5)], "lon DOUBLE, lat DOUBLE")
    assert zoom_info(rows, point_extent()).first().map_zoom == 2
    none = spark.range(1).select(geodesic_metres(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert none[0] is None


def test_zoom_limits_are_exclusive(spark):
    sizes = [(float(m), z) for z, m in ZOOM_METRES]
    at = [(m, z - 1) for m, z in sizes]
    below = [(math.nextafter(m, 0), z) for m, z in sizes]
    frame = spark.createDataFrame(at + below + [(50055.461, 9), (0.0, 18), (1e9, 0)], "m DOUBLE, z INT")
    assert frame.where(zoom_level(F.col("m")) != F.col("z")).count() == 0


def test_text_extents(spark):
    frame = spark.createDataFrame(
        [("POLYGON ((-1.5 2, 3 4e1, .5 -6.25, -1.5 2))",
          '{"type":"Polygon","coordinates":[[[-1.5,2],[3, 4e1,9],[0.5,-6.25],[-1.5,2]]]}')], "w STRING, g STRING",
    )
    row = frame.select(wkt_extent(F.col("w")).alias("w"), geojson_extent(F.col("g")).alias("g")).first()
    assert tuple(row.w) == tuple(row.g) == (-1.5, -6.25, 3.0, 40.0)


def test_binary_srid(spark):
    big = bytes.fromhex("0020000001") + (3857).to_bytes(4, "big") + bytes(16)
    little = bytes.fromhex("0101000020") + (4326).to_bytes(4, "little") + bytes(16)
    plain = bytes.fromhex("0101000000") + bytes(16)
    frame = spark.createDataFrame([(big,), (little,), (plain,)], "g BINARY")
    assert [r[0] for r in frame.select(binary_srid(F.col("g"))).collect()] == [3857, 4326, 0]


def test_point_wkb_is_read_by_spark(spark):
    spark.conf.set("spark.sql.geospatial.enabled", "true")
    frame = spark.createDataFrame([(1.5, -2.25)], "lon DOUBLE, lat DOUBLE")
    frame = frame.select(point_wkb(F.col("lon"), F.col("lat")).alias("g"))
    row = frame.select(
        F.expr("st_srid(st_geomfromwkb(g))").alias("s"), F.hex(F.expr("st_asbinary(st_geomfromwkb(g))")).alias("h"),
        F.hex("g").alias("g"),
    ).first()
    assert row.s == 0 and row.h == row.g


def test_bytes_of_doubles(spark):
    rng = random.Random(5)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2_000)]
    values += [0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, 2.0**1023, 7.999999999999999]
    values = [v for v in values if math.isfinite(v)]
    rows = spark.createDataFrame([(v, struct.pack("<d", v), struct.pack(">d", v)) for v in values] + [(None, None, None)], "v DOUBLE, a BINARY, b BINARY")
    assert rows.where("v IS NOT NULL").where(double_bytes(F.col("v")) != F.col("a")).count() == 0
    assert rows.where("v IS NULL").where(double_bytes(F.col("v")).isNull()).count() == 1
    points = rows.select("v", F.concat(F.unhex(F.lit("0101000000")), "a", "a").alias("a"), F.concat(F.unhex(F.lit("0000000001")), "b", "b").alias("b"))
    both = points.where("v IS NOT NULL").select("v", binary_extent(F.col("a")).xmin.alias("a"), binary_extent(F.col("b")).ymax.alias("b"))
    assert both.where("a IS DISTINCT FROM v OR b IS DISTINCT FROM v").count() == 0


def _shape(rng, points, depth=0):
    """A random geometry in WKB, ISO or EWKB, in any byte order; its points are added to the list."""
    order = rng.choice("<>")
    z, m = rng.random() < 0.3, rng.random() < 0.2
    iso, srid = rng.random() < 0.5, rng.random() < 0.3
    kind = rng.choice([1, 2, 3] if depth > 2 else [1, 2, 3, 4, 5, 6, 7])
    inner = {4: 1, 5: 2, 6: 3}

    def number(n):
        return struct.pack(order + "I", n)

    def run(n):
        out = b""
        for _ in range(n):
            p = (rng.uniform(-200, 200), rng.uniform(-90, 90))
            points.append(p)
            out += struct.pack(order + "dd", *p) + b"".join(struct.pack(order + "d", 999.0) for f in (z, m) if f)
        return out

    def body(kind):
        if kind == 1:
            return run(1)
        if kind == 2:
            n = rng.randrange(4)
            return number(n) + run(n)
        if kind == 3:
            sizes = [rng.randrange(1, 5) for _ in range(rng.randrange(3))]
            return number(len(sizes)) + b"".join(number(n) + run(n) for n in sizes)
        parts = [header(inner[kind]) + body(inner[kind]) if kind in inner else _shape(rng, points, depth + 1) for _ in range(rng.randrange(4))]
        return number(len(parts)) + b"".join(parts)

    def header(kind, tag=False):
        code = kind + (1000 * z + 2000 * m if iso else (0x80000000 if z else 0) | (0x40000000 if m else 0))
        code |= 0x20000000 if tag else 0
        return (b"\x01" if order == "<" else b"\x00") + number(code) + (number(4326) if tag else b"")

    return header(kind, srid) + body(kind)


def test_binary_extents_of_any_shape(spark):
    rng = random.Random(11)
    rows = []
    for k in range(300):
        points = []
        shape = _shape(rng, points)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        rows.append((k, shape, *((min(xs), min(ys), max(xs), max(ys)) if points else (None,) * 4)))
    rows.append((300, struct.pack("<BIdd", 1, 1, math.nan, math.nan), None, None, None, None))
    rows.append((301, struct.pack("<BIIdd", 1, 2, 4_000_000_000, 1.0, 2.0), 1.0, 2.0, 1.0, 2.0))
    rows.append((302, None, None, None, None, None))
    rows.append((303, b"", None, None, None, None))
    frame = spark.createDataFrame(rows, "id INT, g BINARY, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE")
    read = frame.select("id", binary_extent(F.col("g")).alias("e"), F.struct("xmin", "ymin", "xmax", "ymax").alias("want")).collect()
    for r in read:
        assert (tuple(r.e) if r.e is not None else (None,) * 4) == tuple(r.want), r.id


def test_lines_and_binary_layers(spark):
    points = [(-1.5, 2.0), (3.25, -4.0), (0.0, 0.1)]
    line = struct.pack("<BII", 1, 2, 3) + b"".join(struct.pack("<dd", *p) for p in points)
    frame = spark.createDataFrame([(points,)], "p array<struct<lon double, lat double>>").select(line_wkb(F.col("p")).alias("g"))
    assert bytes(frame.first().g) == line
    view = geometry_layer(frame, "g", Form.BINARY)
    assert tuple(view.centre.first())[:2] == (0.875, -1.0)
    assert view.layers["layer_0"].first().g == line.hex().upper()


def test_cell_outlines_can_be_filtered_on(spark):
    """The whole outline compiles inside a filter, which may not fall back to interpretation."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        cells = spark.range(1_000).select(grid.cell_of(F.col("id") / 7.0 - 70.0, F.col("id") / 20.0 - 20.0, 17).alias("c"))
        box = grid.cell_bounds(F.col("c"))
        found = cells.where((box.xmin > -10.0) & (box.ymax < 5.0) & (box.xmax < 60.0) & (box.ymin > -19.0)).count()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert 0 < found < 1_000
