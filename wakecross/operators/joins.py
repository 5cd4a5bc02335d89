"""Choosing how a side of a join travels by its true size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a few fixed-width columns that fit every executor many times over.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def by_size(frame: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame marked for broadcast if it has at most ``rows`` rows and ``size`` bytes of text, else for a shuffle.

    Both are counted, up to the limit: Spark's own estimate does not see
    that a cover makes thousands of cells of one row. Store a frame first that
    costs more than a scan, since it is evaluated for the count and for the join.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in frame.dtypes if kind in ("string", "binary")]
    width = sum(texts, F.lit(0).cast("long"))
    found = frame.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    if found["rows"] <= rows and found["size"] <= size:
        return F.broadcast(frame)
    return frame.hint("merge")
