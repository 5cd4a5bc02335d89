"""Extent of a frame, and the map centre and zoom for it. All results are one row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakecross.functions.grid import cell_bounds
from wakecross.functions.scale import geodesic_metres, meridian_metres, zoom_level
from wakecross.functions.text import binary_extent, geojson_extent, point_text, wkt_extent
from wakecross.operators.sampling import bounded_sample
from wakecross.operators.steps import let

# Centre and zoom where there is nothing to show.
DEFAULT_CENTRE = (0.0, 0.0, 3)

# How the geometry column of a layer is read.
EXTENT_OF = {
    "wkt": wkt_extent,
    "geojson": geojson_extent,
    "binary": binary_extent,
    "cell": cell_bounds,
    "cell_text": lambda text: cell_bounds(F.conv(text, 16, 10).cast("long")),
}


def column_extent(geometry: Column, form: str) -> Column:
    """Extent of one geometry as a struct of xmin, ymin, xmax, ymax."""
    return EXTENT_OF[form](geometry)


def extent(frame: DataFrame, geometry: Column) -> DataFrame:
    """Extent of all rows; ``geometry`` is a struct of xmin, ymin, xmax, ymax."""
    return frame.select(geometry.alias("e")).agg(
        F.min("e.xmin").alias("xmin"), F.min("e.ymin").alias("ymin"),
        F.max("e.xmax").alias("xmax"), F.max("e.ymax").alias("ymax"),
    )


def point_extent(lon: str = "lon", lat: str = "lat") -> Column:
    """The extent of a point in two typed columns."""
    return F.struct(
        F.col(lon).alias("xmin"), F.col(lat).alias("ymin"), F.col(lon).alias("xmax"), F.col(lat).alias("ymax")
    )


def measured_extent(bounds: DataFrame) -> DataFrame:
    """Adds centre, corner points, width, height, the larger of both, and zoom.

    The width is the geodesic between the southern corners, which for an extent of over half the
    globe runs around its other side, the height that of the western edge.
    """
    xmin, ymin, xmax, ymax = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    sized = bounds.select(
        "xmin", "ymin", "xmax", "ymax",
        ((xmin + xmax) / 2.0).alias("centroid_x"), ((ymin + ymax) / 2.0).alias("centroid_y"),
        point_text(xmin, ymin).alias("pnt_sw"), point_text(xmin, ymax).alias("pnt_nw"),
        point_text(xmax, ymin).alias("pnt_se"), point_text(xmax, ymax).alias("pnt_ne"),
    )
    sized = let(sized, width_meters=geodesic_metres(xmin, ymin, xmax, ymin), height_meters=meridian_metres(ymin, ymax))
    larger = F.greatest("width_meters", "height_meters")
    return sized.withColumn("max_meters", larger).withColumn("zoom", zoom_level(F.col("max_meters")))


def zoom_info(frame: DataFrame, geometry: Column, sample_rows: int | None = None) -> DataFrame:
    """Map centre and zoom (map_x, map_y, map_zoom) for a frame.

    An empty frame yields the default centre. ``sample_rows`` bounds the distinct
    extents that are looked at; rows without a geometry are none of them.
    """
    rows = frame.select(geometry.alias("e"))
    if sample_rows is not None:
        known = rows.where(F.col("e.xmin").isNotNull()).distinct()
        rows = bounded_sample(known, "e", sample_rows)
    measured = measured_extent(extent(rows, F.col("e")))
    known = F.col("xmin").isNotNull()
    x, y, zoom = DEFAULT_CENTRE
    return measured.select(
        F.when(known, F.col("centroid_x")).otherwise(x).alias("map_x"),
        F.when(known, F.col("centroid_y")).otherwise(y).alias("map_y"),
        F.when(known, F.col("zoom")).otherwise(zoom).alias("map_zoom"),
    )
