"""Trajectories: the pings of one vessel in one time window, in time order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakecross.functions import geometry as G
from wakecross.functions.units import AREA_CAP, LINE_RADIUS, TRAJECTORY_WINDOW
from wakecross.operators.areas import area_bounds, swept_areas
from wakecross.operators.hot_keys import found_hot_keys
from wakecross.operators.joins import by_size
from wakecross.sources.tables import stored

# A trajectory above this many pings is handled in several parts.
PART_ROWS = 50_000

LINE = ["mmsi", "window_start"]
PART = [*LINE, "part"]


def window_pings(pings: DataFrame, length: str = TRAJECTORY_WINDOW) -> DataFrame:
    """Pings with the bounds of their tumbling window; a ping needs a vessel and a time."""
    timed = pings.where(F.col("mmsi").isNotNull() & F.col("ts").isNotNull()).select(
        "ping_id", "mmsi", "ts", "lon", "lat", F.window("ts", length).alias("w")
    )
    return timed.select(
        "ping_id", "mmsi", "ts", "lon", "lat",
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
    )


def part_pings(
    pings: DataFrame, length: str = TRAJECTORY_WINDOW, part_rows: int = PART_ROWS, only: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Windowed pings with the part of their line, and those of cut lines alone.

    Ordinary lines are one part, number 0, and have no ``line_points``. A line
    of very many pings, such as one of a shared vessel number, is cut into
    parts of at most ``part_rows``, so that no task has to take it whole. Its
    pings are put in order over all tasks by range, whatever they share, and
    stored, since a part is a stretch of that order.
    """
    timed = window_pings(pings, length)
    if only is not None:
        timed = timed.join(by_size(only.select(*LINE)), LINE, "left_semi")
    hot = found_hot_keys(timed, LINE, part_rows)
    whole = {"part": F.lit(0).cast("long"), "line_points": F.lit(None).cast("long")}
    if hot is None:
        return timed.withColumns(whole), None
    sizes = by_size(hot.select(*LINE, F.col("size").alias("line_points")))
    order = [*LINE, "ts", "ping_id"]
    ordered = timed.join(sizes, LINE).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts up within each range and leaves a gap between ranges.
    part = F.floor(F.monotonically_increasing_id() / part_rows)
    cut = stored(ordered.select(*timed.columns, part.alias("part"), "line_points"))
    return timed.join(sizes, LINE, "left_anti").withColumns(whole).unionByName(cut), cut


def _collected(parted: DataFrame, *keys: str) -> DataFrame:
    """The points of each group in time order; equal timestamps are ordered by ping id."""
    points = F.array_sort(F.collect_list(F.struct("ts", "ping_id", "lon", "lat"))).alias("points")
    return parted.groupBy(*keys, "window_end").agg(points)


def trajectories(
    pings: DataFrame, length: str = TRAJECTORY_WINDOW, part_rows: int = PART_ROWS, only: DataFrame | None = None
) -> DataFrame:
    """One row per vessel and window, with the array of its points in time order.

    A line above ``part_rows`` pings is sorted in parts, and the parts' arrays
    are put together in their order. As one value, a line must stay below 2 GB of points;
    segments know no such limit. ``only`` names the lines to read, as
    rows of mmsi and window_start; other pings are dropped first.
    """
    parted, cut = part_pings(pings, length, part_rows, only)
    lines = _collected(parted.where("line_points IS NULL"), *LINE)
    if cut is not None:
        ordered = F.array_sort(F.collect_list(F.struct("part", "points"))).alias("parts")
        joined = _collected(cut, *PART).groupBy(*LINE, "window_end").agg(ordered)
        lines = lines.unionByName(joined.select(*LINE, "window_end", F.flatten("parts.points").alias("points")))
    return lines.withColumn("n_points", F.size("points").cast("long"))


def _part_ends(cut: DataFrame) -> DataFrame:
    """For each part of a cut line, the last point before it and the first point after it."""
    at, point = F.struct("ts", "ping_id"), F.struct("lon", "lat")
    ends = cut.groupBy(*PART).agg(F.min_by(point, at).alias("first"), F.max_by(point, at).alias("last"))
    along = Window.partitionBy(*LINE).orderBy("part")
    return ends.select(*PART, F.lag("last").over(along).alias("part_before"), F.lead("first").over(along).alias("part_after"))


def _with_neighbours(parted: DataFrame, cut: DataFrame | None) -> DataFrame:
    """Adds before and after, the neighbouring points of each ping on its line, also over the ends of parts."""
    along = Window.partitionBy(*PART).orderBy("ts", "ping_id")
    point = F.struct("lon", "lat")
    stepped = parted.withColumns({"before": F.lag(point).over(along), "after": F.lead(point).over(along)})
    if cut is None:
        return stepped
    joined = stepped.join(by_size(_part_ends(cut)), PART, "left")
    return joined.withColumns(
        {"before": F.coalesce("before", "part_before"), "after": F.coalesce("after", "part_after")}
    ).drop("part_before", "part_after")


def trajectory_segments(pings: DataFrame, length: str = TRAJECTORY_WINDOW, part_rows: int = PART_ROWS) -> DataFrame:
    """Segments between consecutive points of each line.

    A line of one point is a segment of length zero. Each row has n_points of
    its line, and length (degrees) and extent of its part of the line. One
    shuffle serves all window functions; the parts of a cut line are stitched.
    """
    parted, cut = part_pings(pings, length, part_rows)
    whole = Window.partitionBy(*PART)
    stepped = _with_neighbours(parted.withColumn("part_points", F.count(F.lit(1)).over(whole)), cut)
    n_points = F.coalesce("line_points", "part_points")
    end = F.coalesce("after", F.when(n_points == 1, F.struct("lon", "lat")))
    segments = stepped.select(
        *PART, "window_end", "ping_id", n_points.alias("n_points"),
        F.col("line_points").isNotNull().alias("is_cut"),
        F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        end.lon.alias("x2"), end.lat.alias("y2"),
    )
    measured = segments.withColumns({name: value.over(whole) for name, value in _measures().items()})
    return measured.where(F.col("x2").isNotNull())


def _measures() -> dict[str, Column]:
    """Length and extent over segments; a line's last row has no end and adds its start only."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return {
        "length": F.sum(F.sqrt(G.points_d2(x1, y1, x2, y2))),
        "xmin": F.min(F.least("x1", "x2")), "ymin": F.min(F.least("y1", "y2")),
        "xmax": F.max(F.greatest("x1", "x2")), "ymax": F.max(F.greatest("y1", "y2")),
    }


def whole_line_measures(segments: DataFrame) -> DataFrame:
    """Stored segments with length and extent of the whole line also where it is cut."""
    if segments.where("is_cut").isEmpty():
        return segments
    merge = {"length": F.sum, "xmin": F.min, "ymin": F.min, "xmax": F.max, "ymax": F.max}
    parts = segments.where("is_cut").groupBy(*PART).agg(*[F.max(c).alias(c) for c in merge])
    lines = parts.groupBy(*LINE).agg(*[f(c).alias(f"line_{c}") for c, f in merge.items()])
    joined = segments.join(by_size(lines), LINE, "left")
    return joined.withColumns({c: F.coalesce(f"line_{c}", c) for c in merge}).drop(
        *[f"line_{c}" for c in merge]
    )


def line_radius(n_points: Column, most: Column, base: float = LINE_RADIUS) -> Column:
    """Buffer radius of a line: the fewer points, the wider."""
    return most * base / n_points


def buffered_segments(
    pings: DataFrame,
    length: str = TRAJECTORY_WINDOW,
    base: float = LINE_RADIUS,
    area_cap: float | None = AREA_CAP,
    most: int | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Segments with the radius r of their line, without lines whose buffer has the area cap or more.

    ``most`` is the point count of the largest line. Unless given, it is a
    scalar subquery and so does not come to the driver. The segments are
    stored, since this and the steps that follow pass over them more than once.
    Most lines are decided by bounds from their length and extent; the buffers of
    the others are measured. Degrees are of one size within a line, that of its middle latitude.
    """
    segments = stored(trajectory_segments(pings, length, part_rows))
    largest = F.lit(most) if most is not None else segments.agg(F.max("n_points")).scalar()
    buffered = whole_line_measures(segments).withColumn("r", line_radius(F.col("n_points"), largest, base))
    if area_cap is None:
        return buffered
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    low, high = area_bounds(F.col("r"), F.col("length"), width, height)
    cap = area_cap / G.square_metres((F.col("ymin") + F.col("ymax")) / 2.0)
    open_lines = buffered.where((low < cap) & (high >= cap))
    if open_lines.isEmpty():
        return buffered.where(high < cap)
    areas = by_size(stored(swept_areas(open_lines, LINE)))
    measured = buffered.join(areas, LINE, "left")
    return measured.where((high < cap) | (F.col("area") < cap)).select(*buffered.columns)


def thinned(pings: DataFrame, tolerance: float, length: str = TRAJECTORY_WINDOW, part_rows: int = PART_ROWS) -> DataFrame:
    """Pings without inner points nearer than ``tolerance`` to the chord of their neighbours.

    The ends of a line stay.
    """
    around = _with_neighbours(*part_pings(pings, length, part_rows))
    chord = (F.col("before.lon"), F.col("before.lat"), F.col("after.lon"), F.col("after.lat"))
    at = G.foot(F.col("lon"), F.col("lat"), chord)
    off = G.foot_d2(F.col("lon"), F.col("lat"), chord, at)
    inner = F.col("before").isNotNull() & F.col("after").isNotNull()
    return around.where(~(inner & (off < tolerance * tolerance))).drop("before", "after", "line_points", "part")
