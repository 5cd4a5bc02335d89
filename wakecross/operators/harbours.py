"""Harbour areas, and encounters away from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.functions.units import HARBOUR_RADIUS, PING_LEVEL
from wakecross.operators.cover import disc_cover
from wakecross.operators.joins import by_size
from wakecross.sources.tables import stored


def harbour_cells(ports: DataFrame, radius: float | None = HARBOUR_RADIUS, level: int = PING_LEVEL) -> DataFrame:
    """Name and cell for every cell within ``radius`` degrees of a port.

    Cells on the border count, and a cell near two ports comes twice. With
    radius None each port brings its own ``r``.
    """
    discs = ports if radius is None else ports.withColumn("r", F.lit(radius))
    return disc_cover(discs.select("name", "lon", "lat", "r"), level).select("name", "cell")


def outside_cells(candidates: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """Candidate rows whose cell is not among ``cells.cell``.

    Each row is judged by itself: a pair stays with its cells outside. The
    cells are broadcast only if a count shows that they are few.
    """
    listed = by_size(stored(cells.select(F.col("cell").alias(column)).distinct()))
    return candidates.join(listed, column, "left_anti")


def first_encounters(candidates: DataFrame) -> DataFrame:
    """One row per pair of vessels, with the window and cell of its earliest candidate, the smallest cell of a window.

    The minima are taken in two steps of fixed-width values, so that both are
    hash aggregates; each combines rows before its shuffle.
    """
    windows = candidates.groupBy("vessel_1", "vessel_2", "window_start").agg(F.min("index").alias("index"))
    earliest = F.min("window_start").alias("window_start")
    return windows.groupBy("vessel_1", "vessel_2").agg(earliest, F.min_by("index", "window_start").alias("index"))


def encounters_outside(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per pair of vessels that meets outside the cells, see ``first_encounters``.

    Line encounters can leave out the cells themselves, before pairing.
    """
    return first_encounters(outside_cells(candidates, cells, "index"))
