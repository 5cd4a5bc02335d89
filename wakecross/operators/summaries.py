"""Heat maps, and the lines behind their cells."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.functions.text import line_text


def encounter_heatmap(encounters: DataFrame, vessels: tuple[str, str] = ("vessel_1", "vessel_2")) -> DataFrame:
    """Encounters per cell and pair of vessels; a cell comes once per pair."""
    counts = encounters.groupBy("ix", *vessels).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("ix", *vessels, "count")


def busiest(heatmap: DataFrame, rows: int = 100) -> DataFrame:
    """The rows with the highest counts; ties in the order of the other columns."""
    others = [c for c in heatmap.columns if c != "count"]
    return heatmap.orderBy(F.desc("count"), *others).limit(rows)


def line_heatmap(candidates: DataFrame, below: float | None = None) -> DataFrame:
    """Line encounters per cell, with the first pair and window as an example.

    Cells with ``below`` encounters or more are left out before sorting. The
    first row is found in steps of fixed-width values, all of them hash aggregates.
    """
    one = F.count(F.lit(1)).alias("count")
    firsts = candidates.groupBy(F.col("index").alias("ix"), "window_start", "vessel_1").agg(one, F.min("vessel_2").alias("vessel_2"))
    windows = firsts.groupBy("ix", "window_start").agg(
        F.sum("count").alias("count"), F.min_by("vessel_2", "vessel_1").alias("vessel_2"), F.min("vessel_1").alias("vessel_1")
    )
    cells = windows.groupBy("ix").agg(
        F.sum("count").alias("count"), F.min_by("vessel_1", "window_start").alias("vessel_1"),
        F.min_by("vessel_2", "window_start").alias("vessel_2"), F.min("window_start").alias("window_start"),
    )
    if below is not None:
        cells = cells.where(F.col("count") < below)
    return cells.orderBy(F.desc("count"), "ix")


def named_lines(pairs: DataFrame) -> DataFrame:
    """Vessel and window of every line that takes part in ``pairs``, to read only these."""
    return pairs.select(F.explode(F.array("vessel_1", "vessel_2")).alias("mmsi"), "window_start").distinct()


def with_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds line_1 and line_2, the WKT of both vessels' lines in the row's window.

    ``lines`` comes from ``trajectories``. The joins lose the order of ``pairs``.
    """
    for side in ("1", "2"):
        line = lines.select(
            F.col("mmsi").alias(f"vessel_{side}"), "window_start", F.col("points").alias(f"points_{side}")
        )
        pairs = pairs.join(line, [f"vessel_{side}", "window_start"], "left")
    texts = {f"line_{side}": line_text(F.col(f"points_{side}")) for side in ("1", "2")}
    return pairs.withColumns(texts).drop("points_1", "points_2")


def paths(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The WKT of each line that takes part in ``pairs``, for a map."""
    drawn = lines.join(named_lines(pairs), ["mmsi", "window_start"], "left_semi")
    return drawn.select("mmsi", "window_start", line_text(F.col("points")).alias("line"))
