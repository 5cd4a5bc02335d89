"""Cells that buffered shapes touch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakecross.functions import geometry as G
from wakecross.functions.grid import cell_id, cell_level, cell_parent, cell_side, column_index, row_index
from wakecross.operators.joins import by_size
from wakecross.operators.segments import with_box_distances

# Room for rounding, in the search boxes only; exact tests decide.
SLACK = 1 + 1e-9

# Bits of ``first``: the cell is in the first column, the first row of its box.
FIRST_X, FIRST_Y = 1, 2


def cell_box(level: int) -> tuple[Column, Column, Column, Column]:
    """Outline of the cell in columns ix and iy."""
    side = cell_side(level)
    ix, iy = F.col("ix"), F.col("iy")
    return ix * side - 180.0, iy * side - 90.0, (ix + 1) * side - 180.0, (iy + 1) * side - 90.0


def box_keys(shapes: DataFrame, level: int, west, south, east, north, first: Column | None = None) -> DataFrame:
    """One row per shape and cell of its bounding box: ix, iy, first.

    If the boxes of two shapes overlap, exactly one shared cell is the first
    column of either box and the first row of either box. So a pair can be
    taken once, before any distance is computed. Bits of ``first`` are added.
    """
    kept = shapes.columns
    rows = shapes.select("*", F.explode(F.sequence(row_index(south, level), row_index(north, level))).alias("iy"))
    cells = rows.select("*", F.explode(F.sequence(column_index(west, level), column_index(east, level))).alias("ix"))
    bits = F.when(F.col("ix") == column_index(west, level), FIRST_X).otherwise(0) + F.when(
        F.col("iy") == row_index(south, level), FIRST_Y
    ).otherwise(0)
    if first is not None:
        bits = bits + first
    return cells.select(*kept, "ix", "iy", bits.alias("first"))


def _with_cell(rows: DataFrame, level: int, near_d2: Column, far_d2: Column) -> DataFrame:
    squared = F.col("r") * F.col("r")
    return (
        rows.where(near_d2 <= squared)
        .withColumn("core", far_d2 <= squared)
        .withColumn("cell", cell_id(F.col("ix"), F.col("iy"), level))
        .drop("ix", "iy")
    )


def compacted(cells: DataFrame, level: int, coarsest: int) -> DataFrame:
    """The same area in fewer cells: four cells of one parent become the parent, up to level ``coarsest``.

    ``cells.cell`` is of one level; the result holds each place once, in cells of several levels.
    """
    current, done = cells.select("cell").distinct(), None
    for _ in range(level - coarsest):
        parent = cell_parent(F.col("cell"))
        counted = current.groupBy(parent.alias("parent")).agg(F.collect_list("cell").alias("cells"))
        left = counted.where(F.size("cells") < 4).select(F.explode("cells").alias("cell"))
        done = left if done is None else done.unionAll(left)
        current = counted.where(F.size("cells") == 4).select(F.col("parent").alias("cell"))
    return current if done is None else done.unionAll(current)


def outside_compacted(rows: DataFrame, compact: DataFrame, column: str, level: int, coarsest: int) -> DataFrame:
    """Rows whose cell of ``level`` lies in no cell of a compacted cover, whatever that cell's level.

    A cell's ancestors are prefixes of its Z-order id, so each level is one
    join on the shifted id; a level without cells needs none.
    """
    found = {r["level"] for r in compact.select(cell_level(F.col("cell")).alias("level")).distinct().collect()}
    for up in range(level - coarsest + 1):
        if level - up not in found:
            continue
        own = compact.where(cell_level(F.col("cell")) == level - up).select(F.col("cell").alias("_prefix"))
        prefixed = rows.withColumn("_prefix", cell_parent(F.col(column), up) if up else F.col(column))
        rows = prefixed.join(by_size(own), "_prefix", "left_anti").drop("_prefix")
    return rows


def disc_cover(discs: DataFrame, level: int) -> DataFrame:
    """Cells that the disc (lon, lat, r) touches; ``core`` where it holds all of a cell.

    Rows of cells come first, then the columns along the chord of each row, so
    no step builds more than one row of cells at a time.
    """
    lon, lat, r = F.col("lon"), F.col("lat"), F.col("r")
    reach = r * SLACK
    low = F.col("iy") * cell_side(level) - 90.0
    gap = F.greatest(low - lat, lat - (low + cell_side(level)), F.lit(0.0))
    chord = F.sqrt(F.greatest(reach * reach - gap * gap, F.lit(0.0))) + (SLACK - 1) * r
    rows = (
        discs.withColumn("iy", F.explode(F.sequence(row_index(lat - reach, level), row_index(lat + reach, level))))
        .withColumn("half", chord)
        .withColumn(
            "ix",
            F.explode(F.sequence(column_index(lon - F.col("half"), level), column_index(lon + F.col("half"), level))),
        )
        .drop("half")
    )
    box = cell_box(level)
    return _with_cell(rows, level, G.point_box_d2(lon, lat, box), G.point_box_far_d2(lon, lat, box))


def capsule_cover(segments: DataFrame, level: int) -> DataFrame:
    """Cells that the buffered segment (x1, y1, x2, y2, r) touches, with ``core``.

    In each row of cells only the columns near the stretch of the segment that
    passes the row are tried. A capsule is convex: it holds a cell if it holds
    the corners.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    reach = F.col("r") * SLACK
    low = F.col("iy") * cell_side(level) - 90.0
    rise = F.nullif(y2 - y1, F.lit(0.0))
    enters, leaves = (low - reach - y1) / rise, (low + cell_side(level) + reach - y1) / rise
    zero, one = F.lit(0.0), F.lit(1.0)
    start = F.greatest(F.coalesce(F.least(enters, leaves), zero), zero)
    end = F.least(F.coalesce(F.greatest(enters, leaves), one), one)
    xa, xb = x1 + F.least(start, one) * (x2 - x1), x1 + F.greatest(end, zero) * (x2 - x1)
    rows = (
        segments.withColumn(
            "iy",
            F.explode(
                F.sequence(
                    row_index(F.least(y1, y2) - reach, level), row_index(F.greatest(y1, y2) + reach, level)
                )
            ),
        )
        .withColumn("xa", F.least(xa, xb) - reach)
        .withColumn("xb", F.greatest(xa, xb) + reach)
        .withColumn("ix", F.explode(F.sequence(column_index(F.col("xa"), level), column_index(F.col("xb"), level))))
        .drop("xa", "xb")
    )
    near = with_box_distances(rows, (x1, y1, x2, y2), cell_box(level))
    return _with_cell(near, level, F.col("near_d2"), F.col("far_d2")).drop("near_d2", "far_d2")
