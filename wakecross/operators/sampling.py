"""Bounded samples and ordered limits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(frame: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with a value in ``column``, the same on every run.

    Rows are ranked by the md5 of the column's text: each task keeps its lowest
    ``rows``, and only those are merged. Equal values rank alike, so drop
    duplicates first where each value should count once.
    """
    rank = F.md5(F.col(column).cast("string").cast("binary"))
    return frame.dropna(subset=[column]).orderBy(rank, column).limit(rows)


def distinct_rows(frame: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The first ``rows`` distinct combinations of columns, in their order."""
    return frame.select(*columns).distinct().orderBy(*columns).limit(rows)
