"""Readers, tables, extent and layers."""

import json
import subprocess
import sys
import zipfile
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rows import pings_of
from wakecross.operators import extent as X
from wakecross.operators import layers as L
from wakecross.operators.sampling import bounded_sample, distinct_rows
from wakecross.sources import archives, ports, positions, tables

ROOT = Path(__file__).resolve().parent.parent
HEADER = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass"
GOOD = "366000001,2024-02-21T00:00:00,33.5,-118.2,10.0,1.0,90.0,ONE,IMO1,C1,70,0,100,20,5.5,70,A"
BAD_FIELD = "366000002,2024-02-21T23:59:00,33.5,-118.2,fast,1.0,90.0,TWO,IMO2,C2,70,0,100,20,5.5,70,A"
LATE = "366000003,2024-02-21T23:59:01,33.5,-118.2,1.0,1.0,90.0,TRI,IMO2,C2,70,,100,20,5.5,70,A"
TANKER = "366000004,2024-02-21T00:00:00,91,181,1.0,1.0,511.0,FOUR,IMO2,C2,80,0,100,20,5.5,80,A"
DOCUMENT = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"PORT_NAME": "P", "X": 1}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        {"type": "Feature", "properties": {"PORT_NAME": "Q"}, "geometry": {"type": "Point", "coordinates": [3.0, 4.0]}},
    ],
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "day.csv").write_text("\n".join([HEADER, GOOD, BAD_FIELD, LATE, TANKER]) + "\n")
    (tmp_path / "harbours.geojson").write_text(json.dumps(DOCUMENT, indent=1))
    return str(tmp_path)


def test_csv_folder(spark, folder):
    rows = positions.snake_case(positions.read_positions(spark, folder))
    assert rows.count() == 4  # the ports file is not read
    assert rows.where("mmsi = 366000002").first().sog is None
    assert [r.mmsi for r in positions.cargo_pings(rows).orderBy("mmsi").collect()] == [366000001, 366000002]
    assert positions.on_earth(rows).count() == 3
    ranged = positions.in_time_range(rows, "2024-02-21T00:00:00.000+00:00", "2024-02-21T23:59:00.000+00:00")
    assert ranged.count() == 3  # both ends, nothing later
    indexed = positions.index_pings(rows)
    assert indexed.count() == 3 and "ping_id" in indexed.columns
    assert indexed.where("mmsi = 366000001").first().sog_kmph == 18.52


def test_filters_reach_the_scan(spark, tmp_path):
    tables.overwrite_files(pings_of(spark, (1, 0, 0.0, 0.0)), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    ranged = positions.in_time_range(stored, "2024-01-01T00:00:00+00:00", "2024-01-02T00:00:00+00:00").select("mmsi")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<mmsi:bigint,ts:timestamp>" in plan


def test_ports(spark, folder):
    found = ports.read_ports(spark, f"{folder}/harbours.geojson").orderBy("name").collect()
    assert [(r.name, r.lon, r.lat) for r in found] == [("P", 1.5, 2.5), ("Q", 3.0, 4.0)]
    assert json.loads(found[0].json_geometry) == {"type": "Point", "coordinates": [1.5, 2.5]}


def test_archives(spark, folder, tmp_path):
    for day, lines in (("01", [GOOD, LATE]), ("03", [BAD_FIELD])):
        with zipfile.ZipFile(tmp_path / f"AIS_2024_02_{day}.zip", "w") as archive:
            archive.writestr("day.csv", "\r\n".join([HEADER, *lines]) + "\r\n")
            archive.writestr("readme.txt", "no data")
    rows = archives.read_archives(spark, folder).orderBy("MMSI").collect()
    assert [(r.MMSI, r.SOG) for r in rows] == [(366000001, 10.0), (366000002, None), (366000003, 1.0)]
    bounds = spark.createDataFrame([(date(2024, 2, 1), date(2024, 2, 28))], "first_day DATE, last_day DATE")
    manifest = archives.daily_manifest(bounds)
    assert manifest.count() == 28
    missing = archives.missing_archives(manifest, archives.present_archives(spark, folder))
    assert missing.count() == 26 and missing.where("file_name = 'AIS_2024_02_02.zip'").count() == 1


def test_archives_are_read_by_ranges_and_records(spark, tmp_path):
    quoted = GOOD.replace("ONE", '"ON\nE, x"').replace("366000001", "366000005")
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("one.csv", "\n".join([HEADER, GOOD, quoted, LATE]))
        archive.writestr("sub/two.CSV", (HEADER + "\n" + BAD_FIELD.replace("TWO", "T#O")).encode().replace(b"#", b"\xff"))
        archive.writestr("empty.csv", "")
        archive.writestr("notes.txt", "x" * 1_000_000)
    with zipfile.ZipFile(tmp_path / "b c.zip", "w") as archive:
        archive.writestr("three.csv", HEADER + "\n")
    members = archives.archive_members(spark, str(tmp_path))
    assert sorted(r.member for r in members.collect()) == ["empty.csv", "one.csv", "sub/two.CSV", "three.csv"]
    names = {r.MMSI: r.VesselName for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert names == {366000001: "ONE", 366000005: "ON\nE, x", 366000003: "TRI", 366000002: "T\ufffdO"}


def test_one_archive_serves_many_tasks(spark, tmp_path):
    lines = spark.range(5_000, numPartitions=1).select(F.concat(F.col("id") + 366000000, F.lit(GOOD[9:])).alias("line"))
    archives.write_archives(lines, str(tmp_path / "z"), HEADER, rows_per_member=700)
    assert len(list((tmp_path / "z").iterdir())) == 1
    read = archives.read_archives(spark, str(tmp_path / "z"))
    assert read.count() == read.select("MMSI").distinct().count() == 5_000
    assert read.select(F.spark_partition_id()).distinct().count() >= 8
    (tmp_path / "none").mkdir()
    assert archives.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_empty_archives_of_tasks_without_rows_are_read(spark, tmp_path):
    lines = spark.range(0, 40, 1, 4).where("id < 10").select(F.concat(F.col("id") + 366000000, F.lit(GOOD[9:])).alias("line"))
    archives.write_archives(lines, str(tmp_path / "z"), HEADER, rows_per_member=3)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "z").iterdir() if f.suffix == ".zip")
    assert len(sizes) == 4 and sizes[0] == 22
    assert {r.MMSI for r in archives.read_archives(spark, str(tmp_path / "z")).collect()} == set(range(366000000, 366000010))
    archives.write_archives(lines.where("false"), str(tmp_path / "none"), HEADER)
    (tmp_path / "none").mkdir(exist_ok=True)
    assert archives.read_archives(spark, str(tmp_path / "none")).count() == 0


def _scan_metrics(frame):
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return {name: leaf.metrics().apply(name).value() for name in ("numFiles", "numOutputRows")}


def test_a_range_filter_reads_few_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("ix"), (F.col("id") % 4).cast("int").alias("day"), F.lit("x" * 20).alias("v"))
    spark.conf.set("parquet.block.size", str(64 * 1024))
    try:
        tables.overwrite_parts(rows, path, "day", "ix")
    finally:
        spark.conf.unset("parquet.block.size")
    files = sorted((tmp_path / "c").rglob("*.parquet"))
    groups = [pq.read_metadata(f) for f in files]
    assert sum(g.num_row_groups for g in groups) > 12
    chosen = spark.read.parquet(path).where("day = 2 AND ix BETWEEN 100000 AND 101000")
    metrics = _scan_metrics(chosen.select("ix"))
    of_day = [f for f in files if "day=2" in str(f)]
    touched = 0
    for f in of_day:
        g = pq.read_metadata(f)
        for k in range(g.num_row_groups):
            column = next(g.row_group(k).column(c) for c in range(g.num_columns) if g.row_group(k).column(c).path_in_schema == "ix")
            if column.statistics.max >= 100_000 and column.statistics.min <= 101_000:
                touched += g.row_group(k).num_rows
    # Spark opens the files of that day alone, and reads no row group beyond those whose range is asked for.
    assert metrics["numFiles"] == len(of_day) < len(files)
    assert chosen.count() <= metrics["numOutputRows"] <= touched < 20_000


def test_one_part_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(1_000).select("id", (F.col("id") % 3).cast("int").alias("day"))
    tables.overwrite_parts(rows, path, "day", "id")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "c").rglob("*.parquet")}
    tables.overwrite_parts(rows.where("day = 1 AND id < 100"), path, "day", "id")
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "c").rglob("*.parquet")}
    assert {f for f in before if "day=1" not in str(f)} == {f for f in after if "day=1" not in str(f)}
    assert all(before[f] == after[f] for f in before if f in after) and not any("day=1" in str(f) for f in set(before) & set(after))
    counts = {r.day: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()}
    assert counts == {0: 334, 1: 33, 2: 333}


def test_a_workspace_leaves_nothing_behind(spark, sf_dir, tmp_path, monkeypatch):
    from wakecross.plans.queries import QUERIES

    monkeypatch.setattr(tables, "shared_root", lambda _: str(tmp_path))
    with tables.workspace(spark):
        assert QUERIES["pairs_outside_harbours"](spark, sf_dir).count() > 0
        with tables.workspace(spark):
            inner = tables.stored(spark.range(3))
            assert inner.count() == 3
        assert list(tmp_path.rglob("*.parquet"))
    assert list(tmp_path.iterdir()) == []


def test_written_tables_go_when_the_driver_ends(tmp_path):
    code = f"""
from wakecross.session import local_session
from wakecross.sources import tables
tables.shared_root = lambda _: {str(tmp_path)!r}
spark = local_session(1, "1g")
print(tables.stored(spark.range(4)).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=200)
    assert done.stdout.split()[-1] == "4" and list(tmp_path.iterdir()) == []


def test_tables(spark, pings):
    tables.ensure_schema(spark, "wake_test")
    tables.overwrite_table(pings.select("mmsi"), "visits")
    tables.overwrite_table(pings.select("ix", "ts"), "visits")
    assert spark.table("visits").columns == ["ix", "ts"]
    assert spark.table("visits").count() == pings.count()
    spark.sql("DROP TABLE visits")
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE wake_test")


def test_only_the_frame_of_the_block_is_released(spark):
    other = spark.range(3).persist()
    with tables.cached(spark.range(7)) as kept:
        assert kept.count() == 7 and kept.is_cached
    assert not kept.is_cached and other.is_cached
    other.unpersist()
    assert tables.preview(other, 2).count() == 2


def test_clustered_files_are_disjoint_ranges(spark, pings, tmp_path):
    path = str(tmp_path / "c")
    tables.overwrite_files(tables.clustered(pings, "ix", "ts", partitions=4), path)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.struct("ix", "ts")).alias("low"), F.max(F.struct("ix", "ts")).alias("high")
    ).orderBy("low").collect()
    assert len(files) == 4
    assert all(a.high <= b.low for a, b in zip(files, files[1:]))


def test_spread_leaves_wide_input_alone(spark):
    assert tables.spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50
    assert tables.spread(spark.range(0, 100, 1, 1), "id", factor=2).rdd.getNumPartitions() == 16


def test_stored_rows_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    kept = tables.stored(spark.range(5))
    assert kept.count() == 5
    if root:
        assert all(f"{root}/" in name for name in kept.inputFiles())


# -- extent, samples, layers ----------------------------------------------------

CORNERS = "lon DOUBLE, lat DOUBLE"


def test_golden_zoom(spark):
    frame = spark.createDataFrame([(-100.5, 50.05), (-100.25, 50.5)], CORNERS)
    measured = X.measured_extent(X.extent(frame, X.point_extent())).first()
    assert (measured.centroid_x, measured.centroid_y, measured.zoom) == (-100.375, 50.275, 9)
    assert (measured.pnt_sw, measured.pnt_ne) == ("POINT(-100.5 50.05)", "POINT(-100.25 50.5)")
    assert measured.max_meters == measured.height_meters
    assert tuple(X.zoom_info(frame, X.point_extent()).first()) == (-100.375, 50.275, 9)


def test_empty_extent_has_the_default_centre(spark):
    empty = spark.createDataFrame([], CORNERS)
    assert tuple(X.zoom_info(empty, X.point_extent()).first()) == (0.0, 0.0, 3)


def test_sample_drops_nulls_before_counting(spark):
    frame = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    assert bounded_sample(frame, "v", 40).where("v IS NOT NULL").count() == 40
    assert bounded_sample(frame, "v", 60).count() == 50
    assert distinct_rows(frame.selectExpr("v % 5 AS v").dropna(), ["v"], 3).collect()[-1].v == 2


def test_views(spark, pings):
    cells = pings.select("mmsi", "ix").distinct()
    view = L.cell_layer(cells, "ix")
    assert view.layers["layer_0"].columns == ["ix", "mmsi"]
    assert view.layers["layer_0"].first().ix.startswith("11")
    text = view.layers["layer_0"].select("ix")
    same = L.map_view(L.Layer(text, "ix", L.Form.CELL_TEXT, name="cells"))
    assert "cells" in same.layers and same.centre.first() == view.centre.first()
    given = L.map_view(L.Layer(cells, "ix", L.Form.CELL), centre=(1.0, 2.0, 7.0))
    assert tuple(given.centre.first()) == (1.0, 2.0, 7.0)
    sampled = L.map_view(L.Layer(cells, "ix", L.Form.CELL, sample_rows=1)).centre.first()
    assert sampled.map_zoom >= view.centre.first().map_zoom


def test_geometry_layers(spark, tmp_path):
    frame = spark.createDataFrame([("POINT(1 2)", 1), ("POINT(3 4)", 2)], "geom STRING, n INT")
    view = L.geometry_layer(frame, "geom", hidden=("n",))
    assert view.layers["layer_0"].columns == ["geom"]
    assert tuple(view.centre.first())[:2] == (2.0, 3.0)
    binary = L.Layer(frame.select(F.encode("geom", "utf-8").alias("geom")), "geom", L.Form.BINARY)
    L.write_layer(binary, str(tmp_path / "layer"), rows=1)
    assert spark.read.csv(str(tmp_path / "layer"), header=True).first().geom == "504F494E542831203229"
