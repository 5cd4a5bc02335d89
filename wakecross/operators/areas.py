"""Area of the places within reach of a line, which count once however often the line passes them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakecross.functions import geometry as G
from wakecross.operators.steps import let

# Strips across a buffer in one radius. The area is right to some 2e-5 of its size.
STRIPS = 256


def area_bounds(r: Column, length: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """No more and no less than the area within ``r`` of a connected line, from its length and extent.

    At every place between its ends, along either axis, the buffer is two radii deep, and each end adds half a disc.
    It is at most the sum over the segments, and no larger than the buffered extent.
    """
    disc = F.lit(3.141592653589793) * r * r
    strip, extent = 2.0 * r * length + disc, (width + 2.0 * r) * (height + 2.0 * r)
    return 2.0 * r * F.greatest(width, height) + disc, F.least(strip, extent)


def swept_areas(segments: DataFrame, keys: list[str], strips: int = STRIPS) -> DataFrame:
    """(keys, area): the area, in squared units of the coordinates, within r of each line's segments.

    ``segments`` has x1, y1, x2, y2, r and the line's xmin; all rows of a line have one r. The buffer is cut into
    strips along x. In each strip, every segment near it covers one stretch of y; stretches are taken in order, and each
    adds what reaches beyond those before it. Rows grow with the length of a line in radii, and a line's strips lie
    in different tasks.
    """
    x1, y1, x2, y2, r = (F.col(c) for c in ("x1", "y1", "x2", "y2", "r"))
    step, start = r / strips, F.col("xmin") - r
    low = F.ceil((F.least(x1, x2) - r - start) / step - 0.5)
    high = F.floor((F.greatest(x1, x2) + r - start) / step - 0.5)
    offset = G.side_offset((x1, y1, x2, y2), r)
    rows = let(segments.select(*keys, "x1", "y1", "x2", "y2", "r", "xmin"), nx_=offset[0], ny_=offset[1]).select(
        "*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("strip")
    )
    rows = let(rows, at_=start + (F.col("strip") + 0.5) * step)
    parts = G.chord_parts(F.col("at_"), y1, x1, y2, x2, r, F.col("ny_"), F.col("nx_"))
    rows = let(rows, **{f"part{k}_": part for k, part in enumerate(parts)})
    ends = G.chord([F.col(f"part{k}_") for k in range(4)], y1, y2)
    cut = let(rows, low_=ends[0], high_=ends[1]).where("low_ IS NOT NULL").select(*keys, "strip", "r", "low_", "high_")
    before = Window.partitionBy(*keys, "strip").orderBy("low_", "high_").rowsBetween(Window.unboundedPreceding, -1)
    reached = cut.withColumn("reach_", F.coalesce(F.max("high_").over(before), F.col("low_")))
    added = F.greatest(F.col("high_") - F.greatest("low_", "reach_"), F.lit(0.0))
    return reached.groupBy(*keys).agg((F.sum(added) * F.max("r") / strips).alias("area"))
