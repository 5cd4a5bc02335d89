"""Map layers: named frames of rows ready for display, with centre and zoom."""

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.functions.grid import cell_text
from wakecross.functions.text import binary_srid
from wakecross.operators.extent import column_extent, zoom_info


class Form(Enum):
    """What the shown column of a layer holds."""

    WKT = "wkt"
    GEOJSON = "geojson"
    BINARY = "binary"
    CELL = "cell"
    CELL_TEXT = "cell_text"


@dataclass(frozen=True)
class Layer:
    """A frame to show on a map."""

    frame: DataFrame
    column: str
    form: Form = Form.WKT
    name: str | None = None
    sample_rows: int | None = None
    hidden: tuple[str, ...] = ()


@dataclass(frozen=True)
class MapView:
    """Layers by name and the one-row frame map_x, map_y, map_zoom."""

    layers: dict[str, DataFrame]
    centre: DataFrame


def layer_rows(layer: Layer) -> DataFrame:
    """The rows of a layer: cells as text and first, binary as hex, hidden columns dropped."""
    frame, column = layer.frame, layer.column
    if layer.form is Form.CELL:
        frame = frame.select(cell_text(F.col(column)).alias(column), *[c for c in frame.columns if c != column])
    elif layer.form is Form.BINARY:
        frame = frame.withColumn(column, F.hex(column))
    return frame.drop(*layer.hidden)


def map_view(*layers: Layer, centre: tuple[float, float, float] | None = None) -> MapView:
    """All layers; centre and zoom come from the first one unless given."""
    named = {
        layer.name if layer.name is not None else f"layer_{number}": layer_rows(layer)
        for number, layer in enumerate(layers)
    }
    first = layers[0]
    if centre is not None:
        spark = first.frame.sparkSession
        view = spark.range(1).select(*[F.lit(v).alias(c) for v, c in zip(centre, ("map_x", "map_y", "map_zoom"))])
    else:
        shape = column_extent(F.col(first.column), first.form.value)
        view = zoom_info(first.frame, shape, first.sample_rows)
    return MapView(named, view)


def geometry_layer(frame: DataFrame, column: str, form: Form = Form.WKT, hidden: tuple[str, ...] = ()) -> MapView:
    """A view of one layer of geometries."""
    return map_view(Layer(frame, column, form, hidden=hidden))


def cell_layer(frame: DataFrame, column: str) -> MapView:
    """A view of one layer of grid cells."""
    return map_view(Layer(frame, column, Form.CELL))


def write_layer(layer: Layer, path: str, rows: int | None = None) -> None:
    """Writes the rows of a layer as CSV with header; ``rows`` bounds them for a browser."""
    frame = layer_rows(layer)
    if rows is not None:
        frame = frame.limit(rows)
    frame.write.mode("overwrite").option("header", True).csv(path)


def srid_counts(frame: DataFrame, column: str) -> DataFrame:
    """Rows per SRID in a WKB or EWKB column: more than one row means mixed input."""
    counted = frame.select(binary_srid(F.col(column)).alias("srid"))
    return counted.groupBy("srid").agg(F.count(F.lit(1)).alias("rows"))
