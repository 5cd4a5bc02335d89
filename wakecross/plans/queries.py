"""The registered queries. Each takes a session and the folder of the given tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakecross.functions.grid import cell_bounds, cell_level, cell_of, cell_parent, cell_text
from wakecross.functions.text import binary_extent, geojson_extent, line_text, line_wkb, point_wkb, wkt_extent
from wakecross.functions.units import LINE_LEVEL, PING_LEVEL, PING_RADIUS
from wakecross.operators import extent as X
from wakecross.operators import harbours as H
from wakecross.operators import layers as L
from wakecross.operators import sampling as S
from wakecross.operators import summaries as A
from wakecross.operators import trajectories as T
from wakecross.operators.cover import capsule_cover, disc_cover
from wakecross.operators.line_encounters import line_encounters
from wakecross.operators.ping_encounters import ping_encounters
from wakecross.operators.steps import let
from wakecross.plans import fixture
from wakecross.sources import archives, ports, positions, tables

Query = Callable[[SparkSession, str], DataFrame]

TIME_RANGE = ("2024-01-01T00:30:00+00:00", "2024-01-01T01:59:00+00:00")
TRACKED = 366_000_007
PORT_RADIUS = 0.003
NEAR_SECONDS = 600
LARGE_ORDER = 200_000
TOLERANCE = 0.0005
SMALL_AREA = 4e6
HEATMAP_BELOW = 100.0
SRID = 4326
REPLACED = 1
TRACK_ROWS = 100_000


def seconds(column: str):
    return F.unix_seconds(column).alias(column)


def _in_seconds(frame: DataFrame) -> DataFrame:
    """Timestamps as epoch seconds, so that any engine compares them alike."""
    stamps = {name for name, kind in frame.dtypes if kind == "timestamp"}
    return frame.select([seconds(c) if c in stamps else F.col(c) for c in frame.columns])


# -- sources, filters, projections -------------------------------------------


def ais_cargo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions.cargo_pings(positions.snake_case(fixture.raw_positions(spark, sf_dir)))
    return _in_seconds(rows.select("ping_id", "mmsi", "ts", "vessel_type", "status", "sog", "heading"))


def ais_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions.in_time_range(fixture.pings(spark, sf_dir), *TIME_RANGE)
    return _in_seconds(rows.select("ping_id", "mmsi", "ts"))


def point_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.pings(spark, sf_dir).select("ping_id", "lon", "lat", "point", "ix", "sog_kmph")


def track_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.track(fixture.pings(spark, sf_dir), TRACKED, TRACK_ROWS)


def star_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.pings(spark, sf_dir).select("ping_id", "mmsi", "vessel_name", "lon", "lat", "ix")
    return rows.selectExpr("lower(hex(ix)) AS ix", "* EXCEPT (ix)").drop("vessel_name")


def daily_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive names between the first and the last day of events, with their rows."""
    days = fixture.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    bounds = days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    counts = days.groupBy(archives.archive_name(F.col("day")).alias("file_name")).agg(
        F.count(F.lit(1)).alias("messages")
    )
    manifest = archives.daily_manifest(bounds)
    return manifest.join(counts, "file_name", "left").select(
        "file_name", F.coalesce("messages", F.lit(0)).alias("messages")
    )


def missing_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive names of the order period for days without a large order."""
    orders = fixture.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    bounds = orders.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    large = orders.where(F.col("o_totalprice") > LARGE_ORDER)
    present = large.select(archives.archive_name(F.col("day")).alias("file_name"))
    return archives.missing_archives(archives.daily_manifest(bounds), present).select("file_name")


def position_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions written as CSV files and read by position with the fixed schema."""
    path = tables.shared_folder(spark)
    _position_columns(fixture.raw_positions(spark, sf_dir)).write.option("header", True).csv(path)
    read = positions.snake_case(positions.read_positions(spark, path))
    return _in_seconds(read.select("mmsi", "ts", "lon", "lat", "sog", "heading", "vessel_name", "status"))


def _position_columns(raw: DataFrame) -> DataFrame:
    """The columns of a position file, in file order; those without data are NULL."""
    schema = raw.sparkSession.createDataFrame([], positions.POSITION_SCHEMA).schema
    have = {c.lower() for c in raw.columns}
    return raw.select(
        [(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def zip_ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions packed into a folder of zip archives of several members, and read out of it by byte ranges.

    The names of some vessels hold a line feed, which is quoted in the files.
    """
    raw = fixture.raw_positions(spark, sf_dir)
    broken = F.concat("VesselName", F.lit("\n"), F.col("ping_id").cast("string"))
    columns = _position_columns(raw.withColumn("VesselName", F.when(F.col("ping_id") % 5 == 0, broken).otherwise(F.col("VesselName"))))
    path = tables.shared_folder(spark)
    lines = columns.select(F.to_csv(F.struct(*columns.columns)).alias("line"))
    archives.write_archives(lines, path, ",".join(columns.columns), rows_per_member=2_000)
    read = positions.snake_case(archives.read_archives(spark, path))
    return _in_seconds(read.select("mmsi", "ts", "lon", "lat", "sog", "heading", "vessel_name", "status"))


def replaced_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustered table by hours, one of which is written again with other vessels; one cell range is read back."""
    path = tables.shared_folder(spark)
    hour = F.expr("cast((unix_seconds(ts) div 3600) % 24 as int)").alias("hour")
    rows = fixture.pings(spark, sf_dir).select("ping_id", "mmsi", "ts", "ix", hour)
    tables.overwrite_parts(rows, path, "hour", "ix", "ts")
    again = rows.where(F.col("hour") == REPLACED).withColumn("mmsi", F.col("mmsi") + 1)
    tables.overwrite_parts(again, path, "hour", "ix", "ts")
    read = spark.read.parquet(path).where(F.col("ix") < cell_of(F.lit(-119.5), F.lit(33.5), PING_LEVEL))
    return _in_seconds(read.select("ping_id", "mmsi", "ts", "hour"))


def ports_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port names and points out of a written GeoJSON file of several lines."""
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("name").alias("PORT_NAME")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    features = F.array_sort(F.collect_list(feature)).alias("features")
    document = fixture.harbours(spark, sf_dir).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features)).alias("value"))
    path = tables.shared_folder(spark)
    # One document of many lines.
    document.select(F.replace("value", F.lit("},{"), F.lit("},\n{")).alias("value")).coalesce(1).write.text(path)
    return ports.read_ports(spark, path).select("name", "lon", "lat")


def clustered_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings written in order of cell and time, and one cell range and hour read back."""
    path = tables.shared_folder(spark)
    rows = fixture.pings(spark, sf_dir).select("ping_id", "mmsi", "ts", "ix")
    tables.overwrite_files(tables.clustered(rows, "ix", "ts"), path)
    return _in_seconds(positions.in_time_range(spark.read.parquet(path), *TIME_RANGE))


def schema_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of visits, replaced by one of other columns under its name."""
    path = tables.shared_folder(spark)
    rows = fixture.pings(spark, sf_dir)
    tables.overwrite_files(rows.select("mmsi", "vessel_name"), path)
    tables.overwrite_files(rows.groupBy("ix").agg(F.count(F.lit(1)).alias("pings"), F.max("ts").alias("last")), path)
    return _in_seconds(spark.read.parquet(path))


def cached_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings and vessels per cell and in all, from one frame that is cached while both are written."""
    with tables.cached(fixture.pings(spark, sf_dir).select("ix", "mmsi")) as rows:
        counts = [F.count(F.lit(1)).alias("pings"), F.countDistinct("mmsi").alias("vessels")]
        cells = tables.stored(rows.groupBy("ix").agg(*counts))
        whole = tables.stored(rows.agg(*counts).select(F.lit(-1).cast("long").alias("ix"), "pings", "vessels"))
    return cells.unionByName(whole)


def track_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the whole track of one vessel."""
    return tables.preview(positions.track(fixture.pings(spark, sf_dir), TRACKED), 5)


def wkb_srid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per SRID where every other ping is EWKB and the rest plain WKB."""
    lon, lat = F.col("lon"), F.col("lat")
    tagged = F.when(F.col("ping_id") % 2 == 0, point_wkb(lon, lat, SRID)).otherwise(point_wkb(lon, lat))
    return L.srid_counts(fixture.pings(spark, sf_dir).select(tagged.alias("geom")), "geom")


def wkb_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each line, read back from a binary collection of the line and its first point, which has a SRID."""
    points = F.col("points")
    parts = F.concat(line_wkb(points), point_wkb(points[0].lon, points[0].lat, SRID))
    shapes = F.concat(F.unhex(F.lit("010700000002000000")), parts)
    lines = T.trajectories(fixture.pings(spark, sf_dir)).select("mmsi", "window_start", shapes.alias("geom"))
    return _in_seconds(let(lines, e=binary_extent(F.col("geom"))).select("mmsi", "window_start", "e.*"))


def binary_layer_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and zoom of a layer of points in binary form."""
    points = fixture.pings(spark, sf_dir).select(point_wkb(F.col("lon"), F.col("lat")).alias("geom"))
    view = L.geometry_layer(points, "geom", L.Form.BINARY).centre
    return view.withColumn("map_zoom", F.col("map_zoom").cast("long"))


# -- grid and covers ----------------------------------------------------------


def cell_bounds_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell, box = F.col("ix"), F.col("box")
    cells = fixture.pings(spark, sf_dir).select("ix").distinct()
    return cells.withColumn("box", cell_bounds(cell)).select(
        "ix", cell_text(cell).alias("text"), cell_level(cell).alias("level"),
        cell_parent(cell, 3).alias("parent"), box.xmin.alias("xmin"), box.ymin.alias("ymin"),
        box.xmax.alias("xmax"), box.ymax.alias("ymax"),
    )


def disc_cover_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    discs = fixture.pings(spark, sf_dir).select("ping_id", "lon", "lat").withColumn("r", F.lit(PING_RADIUS))
    return disc_cover(discs, PING_LEVEL).select("ping_id", "cell", "core")


def capsule_cover_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = T.buffered_segments(fixture.pings(spark, sf_dir))
    return capsule_cover(segments, LINE_LEVEL + 1).select("ping_id", "cell", "core")


def harbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harbour cells from port features that go through GeoJSON text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("name").alias("PORT_NAME")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    document = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    texts = fixture.harbours(spark, sf_dir).select(document.alias("text"))
    parsed = texts.select(F.from_json("text", ports.PORTS_SCHEMA).alias("c")).select("c.*")
    return H.harbour_cells(ports.ports_of(parsed), PORT_RADIUS)


# -- ping encounters ----------------------------------------------------------


def ping_pairs_reference_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_seconds(ping_encounters(fixture.pings(spark, sf_dir)))


def ping_pairs_corrected_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_seconds(ping_encounters(fixture.pings(spark, sf_dir), mode="corrected"))


def ping_pairs_shared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ping_encounters(fixture.pings(spark, sf_dir), emit="shared", max_seconds=NEAR_SECONDS)
    return pairs.select("ping_1", "ping_2", "ix")


def ping_pairs_outside_harbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = H.harbour_cells(fixture.harbours(spark, sf_dir), None)
    pairs = ping_encounters(
        fixture.pings(spark, sf_dir), emit="shared", max_seconds=NEAR_SECONDS, outside=cells
    )
    return pairs.select("ping_1", "ping_2", "ix")


def encounter_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.encounter_heatmap(ping_encounters(fixture.pings(spark, sf_dir), emit="shared"))


def encounter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    heatmap = A.encounter_heatmap(ping_encounters(fixture.pings(spark, sf_dir)), ("mmsi_1", "mmsi_2"))
    return A.busiest(heatmap, 100)


def heatmap_sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat map by SQL over views, of pings of different vessels per cell."""
    fixture.pings(spark, sf_dir).createOrReplaceTempView("indexed_pings")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY VIEW cell_visits AS "
        "SELECT ix, count(*) AS count FROM indexed_pings GROUP BY ix, mmsi"
    )
    return spark.sql(
        "SELECT ix, sum(count) AS count, count(*) AS vessels FROM cell_visits"
        " GROUP BY ix ORDER BY count DESC, ix LIMIT 10"
    )


# -- trajectories and line encounters -----------------------------------------


def tumbling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.trajectories(fixture.pings(spark, sf_dir))
    first, last = F.col("points")[0], F.element_at("points", -1)
    return _in_seconds(
        lines.select(
            "mmsi", "window_start", "window_end", "n_points", first.ping_id.alias("first_ping"),
            last.ping_id.alias("last_ping"), F.array_max("points.lon").alias("east"),
            line_text(F.col("points")).alias("line"),
        )
    )


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.trajectory_segments(fixture.pings(spark, sf_dir))
    return _in_seconds(rows.select("ping_id", "mmsi", "window_start", "x1", "y1", "x2", "y2", "n_points"))


def line_buffer_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.buffered_segments(fixture.pings(spark, sf_dir), area_cap=None)
    return _in_seconds(rows.select("mmsi", "window_start", "n_points", "r").distinct())


def line_area_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.buffered_segments(fixture.pings(spark, sf_dir), area_cap=SMALL_AREA)
    return _in_seconds(rows.select("mmsi", "window_start").distinct())


def thinned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.thinned(fixture.pings(spark, sf_dir), TOLERANCE)
    return _in_seconds(rows.select("ping_id", "mmsi", "window_start"))


def _candidates(spark: SparkSession, sf_dir: str, emit: str = "shared") -> DataFrame:
    return line_encounters(T.buffered_segments(fixture.pings(spark, sf_dir)), emit=emit)


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_seconds(_candidates(spark, sf_dir, "point"))


def line_pairs_shared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_seconds(_candidates(spark, sf_dir).drop("window_end"))


def _named(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """The lines that pairs name, and no others."""
    return T.trajectories(fixture.pings(spark, sf_dir), only=A.named_lines(pairs))


def line_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.stored(A.line_heatmap(_candidates(spark, sf_dir), HEATMAP_BELOW))
    # The joins with the lines lose the order of the cells.
    return _in_seconds(A.with_lines(cells, _named(spark, sf_dir, cells))).orderBy(F.desc("count"), "ix")


def _outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line encounters away from harbours, whose cells are left out before pairing."""
    cells = H.harbour_cells(fixture.harbours(spark, sf_dir), None)
    return line_encounters(T.buffered_segments(fixture.pings(spark, sf_dir)), outside=cells)


def line_cells_outside_harbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_seconds(_outside(spark, sf_dir).drop("window_end"))


def pairs_outside_harbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair of vessels that meets outside harbours, with both lines."""
    pairs = tables.stored(H.first_encounters(_outside(spark, sf_dir)))
    return _in_seconds(A.with_lines(pairs, _named(spark, sf_dir, pairs)))


def paths_outside_harbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines behind the pairs that meet outside harbours, as map rows."""
    pairs = tables.stored(H.first_encounters(_outside(spark, sf_dir)))
    return _in_seconds(A.paths(pairs, _named(spark, sf_dir, pairs)))


def line_heatmap_sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line encounters per cell by SQL over views, the busiest cells first."""
    _candidates(spark, sf_dir).createOrReplaceTempView("line_candidates")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY VIEW cell_encounters AS "
        "SELECT index AS ix, count(*) AS count, count(DISTINCT vessel_1, vessel_2) AS pairs FROM line_candidates GROUP BY index"
    )
    return spark.sql("SELECT ix, count, pairs FROM cell_encounters ORDER BY count DESC, ix LIMIT 100")


def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines and thinned points where every line of more than three pings is handled in parts."""
    pings = fixture.pings(spark, sf_dir)
    kept = T.thinned(pings, TOLERANCE, part_rows=3).groupBy("mmsi", "window_start").agg(F.count(F.lit(1)).alias("kept"))
    lines = T.trajectories(pings, part_rows=3).select("mmsi", "window_start", "n_points", line_text(F.col("points")).alias("line"))
    return _in_seconds(lines.join(kept, ["mmsi", "window_start"], "left"))


# -- extent, samples, layers --------------------------------------------------


def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extent(fixture.pings(spark, sf_dir), X.point_extent())


def extent_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = X.measured_extent(X.extent(fixture.pings(spark, sf_dir), X.point_extent()))
    return measured.select(
        F.round("width_meters", 3).alias("width_meters"), F.round("height_meters", 3).alias("height_meters"),
        F.round("max_meters", 3).alias("max_meters"), F.col("zoom").cast("long").alias("zoom"), "pnt_sw", "pnt_ne",
    )


def vessel_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent and zoom for each vessel's own pings."""
    rows = fixture.pings(spark, sf_dir).groupBy("mmsi").agg(
        F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax")
    )
    xmin, ymin, xmax, ymax = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    size = F.greatest(X.geodesic_metres(xmin, ymin, xmax, ymin), X.meridian_metres(ymin, ymax))
    return _sized(rows, size)


def _sized(rows: DataFrame, size: Column) -> DataFrame:
    measured = let(rows, size=size)
    return measured.select(
        "mmsi", F.round("size", 3).alias("meters"), X.zoom_level(F.col("size")).cast("long").alias("zoom")
    )


def vessel_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodesic between each vessel's first ping and a place in the other half of the globe, with zoom."""
    rows = fixture.pings(spark, sf_dir).groupBy("mmsi").agg(F.min_by(F.struct("lon", "lat"), "ping_id").alias("p"))
    lon = -F.col("p.lon") - (F.col("mmsi") % 40)
    return _sized(rows, X.geodesic_metres(F.col("p.lon"), F.col("p.lat"), lon, -F.col("p.lat") + 60.0))


def zoom_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = X.zoom_info(fixture.pings(spark, sf_dir), X.point_extent())
    return view.withColumn("map_zoom", F.col("map_zoom").cast("long"))


def wkt_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each line, read back from its WKT and from GeoJSON text."""
    lines = T.trajectories(fixture.pings(spark, sf_dir))
    pairs = F.transform("points", lambda p: F.array(p.lon, p.lat))
    geojson = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))
    both = lines.select(
        "mmsi", "window_start", wkt_extent(line_text(F.col("points"))).alias("w"), geojson_extent(geojson).alias("g")
    )
    return _in_seconds(
        both.select("mmsi", "window_start", "w.xmin", "w.ymax", F.col("g.ymin"), F.col("g.xmax"))
    )


def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bounded_sample(fixture.pings(spark, sf_dir), "ping_id", 250).select("ping_id", "lon", "lat")


def distinct_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_rows(fixture.pings(spark, sf_dir), ["ix", "vessel_name"], 3_000)


def formatted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_count(fixture.pings(spark, sf_dir))


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map rows of the busiest cells, their ids as text."""
    visits = fixture.pings(spark, sf_dir).groupBy("ix").agg(
        F.count(F.lit(1)).alias("count"), F.max("sog").alias("speed")
    )
    return L.layer_rows(L.Layer(A.busiest(visits, 100), "ix", L.Form.CELL, hidden=("speed",)))


def layer_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and zoom of a layer of cells."""
    cells = fixture.pings(spark, sf_dir).select(cell_of(F.col("lon"), F.col("lat"), 12).alias("ix"))
    view = L.cell_layer(cells, "ix").centre
    return view.withColumn("map_zoom", F.col("map_zoom").cast("long"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        ais_cargo_filter, ais_time_range, point_index, track_listing, star_except, daily_manifest,
        missing_archives, position_csv_roundtrip, zip_ingest_roundtrip, ports_file, clustered_write_roundtrip, replaced_hour,
        schema_replaced, cached_counts, track_preview, wkb_srid, wkb_extents, binary_layer_centre,
        cell_bounds_text, disc_cover_cells, capsule_cover_cells, harbour_cells, ping_pairs_reference_window,
        ping_pairs_corrected_window, ping_pairs_shared_cells, ping_pairs_outside_harbours, encounter_heatmap,
        encounter_topk, heatmap_sql_view, tumbling_lines, line_segments, line_buffer_radius, line_area_cap,
        thinned_lines, cut_lines, line_pairs, line_pairs_shared_cells, line_heatmap, line_heatmap_sql_view,
        line_cells_outside_harbours, pairs_outside_harbours, paths_outside_harbours, bbox, extent_measures, vessel_zoom, vessel_distances, zoom_info, wkt_extents, bounded_sample,
        distinct_limit, formatted_count, layer_rows, layer_centre,
    )
}
