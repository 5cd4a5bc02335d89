"""Encounters between single pings: near in space, and in time for their speeds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakecross.functions import geometry as G
from wakecross.functions.grid import cell_column, cell_id, cell_of, cell_row
from wakecross.functions.motion import SHORTEST_WINDOW, half_window, velocity, window_of_velocities
from wakecross.functions.units import PING_LEVEL, PING_RADIUS
from wakecross.operators.cover import FIRST_X, FIRST_Y, SLACK, box_keys, cell_box
from wakecross.operators.discs import discs_meet_in_box
from wakecross.operators.hot_keys import KEY_ROWS, same_tile, tile_hot_keys
from wakecross.operators.joins import by_size
from wakecross.sources.tables import stored

FIRST_T = 4
EMIT = ("point", "shared")

# Width of a time bucket in seconds: near the usual window, so that most pings
# fall into one or two buckets.
BUCKET_SECONDS = {"reference": 14_400, "corrected": 900}


def _buckets(
    pings: DataFrame, radius: float, mode: str, bucket_seconds: float, max_seconds: float | None
) -> tuple[Column, Column]:
    """First and last time bucket that a ping's own half of a window reaches into.

    Two pings within their window share a bucket, and exactly one shared
    bucket is the first of either. Buckets beyond the first and last ping are
    left out: they meet nothing, and speeds without sense stay harmless.
    """
    seconds = F.unix_micros("ts") / 1e6
    half = half_window(F.col("sog_kmph"), radius, mode)
    if max_seconds is not None:
        half = F.least(half, F.lit(max_seconds + 1.0))
    low, high = seconds - half, seconds + half
    if mode == "reference":
        times = pings.agg((F.unix_micros(F.min("ts")) / 1e6).alias("low"), (F.unix_micros(F.max("ts")) / 1e6).alias("high"))
        low = F.greatest(low, times.select("low").scalar())
        high = F.least(high, times.select("high").scalar())
    return F.floor(low / bucket_seconds), F.floor(high / bucket_seconds)


def ping_keys(
    pings: DataFrame, radius: float, level: int, mode: str, max_seconds: float | None = None
) -> DataFrame:
    """Pings keyed by each cell and time bucket they can meet another ping in."""
    bucket_seconds = BUCKET_SECONDS[mode]
    if max_seconds is not None:
        bucket_seconds = min(bucket_seconds, max(2 * max_seconds, SHORTEST_WINDOW))
    velocities = velocity(F.col("sog_kmph"), F.col("heading"), mode)
    known = F.col("mmsi").isNotNull() & F.col("sog_kmph").isNotNull() & F.col("ts").isNotNull()
    if mode == "reference":
        known = known & F.col("heading").isNotNull()
    earliest, latest = _buckets(pings, radius, mode, bucket_seconds, max_seconds)
    carried = ["ping_id", "mmsi", "vessel_name", "ts", "lon", "lat", "sog_kmph", "vx", "vy"]
    timed = pings.where(known).select(
        *carried[:-2], velocities[0].alias("vx"), velocities[1].alias("vy"), earliest.alias("earliest"),
        F.explode(F.sequence(earliest, latest)).alias("bucket"),
    )
    first_t = F.when(F.col("bucket") == F.col("earliest"), FIRST_T).otherwise(0)
    reach = radius * SLACK
    lon, lat = F.col("lon"), F.col("lat")
    boxed = box_keys(timed, level, lon - reach, lat - reach, lon + reach, lat + reach, first_t)
    return boxed.select(*carried, "ix", "iy", "bucket", "first")


def _velocity(side: str) -> tuple[Column, Column, Column]:
    return F.col(f"{side}.sog_kmph"), F.col(f"{side}.vx"), F.col(f"{side}.vy")


def ping_encounters(
    pings: DataFrame,
    radius: float = PING_RADIUS,
    level: int = PING_LEVEL,
    mode: str = "reference",
    emit: str = "point",
    max_seconds: float | None = None,
    outside: DataFrame | None = None,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Pairs of pings of two vessels whose discs meet within the pair's window.

    ``emit="point"`` yields each pair once, in the cell of its midpoint.
    ``emit="shared"`` yields one row per cell in which both discs meet.
    ``max_seconds`` adds a fixed limit to the window. ``outside`` is a frame
    of cells (same level, shared mode only) to leave out before pairing: the
    result is that of leaving them out afterwards, but busy cells never pair.
    """
    if emit not in EMIT or mode not in BUCKET_SECONDS:
        raise ValueError(f"unknown emit or mode: {emit}, {mode}")
    keyed = ping_keys(pings, radius, level, mode, max_seconds)
    if outside is not None:
        if emit != "shared":
            raise ValueError("cells can be left out before pairing in shared mode only")
        cells = outside.select("cell").distinct().select(cell_column(F.col("cell")).alias("ix"), cell_row(F.col("cell")).alias("iy"))
        keyed = keyed.join(by_size(stored(cells)), ["ix", "iy"], "left_anti")
    tiled = tile_hot_keys(keyed, ["ix", "iy", "bucket"], "ping_id", key_rows)

    a, b = tiled.alias("a"), tiled.alias("b")
    once = FIRST_T if emit == "shared" else FIRST_X + FIRST_Y + FIRST_T
    ax, ay, bx, by = (F.col(c) for c in ("a.lon", "a.lat", "b.lon", "b.lat"))
    apart = F.floor(F.abs(F.unix_micros("a.ts") - F.unix_micros("b.ts")) / 1e6)
    within = apart < window_of_velocities(_velocity("a"), _velocity("b"), radius, mode)
    tests = [
        *[F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("ix", "iy", "bucket", "tile")],
        F.col("a.first").bitwiseOR(F.col("b.first")).bitwiseAND(once) == once,
        same_tile(),
        F.col("a.mmsi") < F.col("b.mmsi"),
        G.points_d2(ax, ay, bx, by) <= (radius + radius) * (radius + radius),
        within,
    ]
    if max_seconds is not None:
        tests.append(apart <= max_seconds)
    met = a.join(b.hint("merge"), G.all_of(tests)).select(
        F.col("a.ping_id").alias("ping_1"),
        F.col("b.ping_id").alias("ping_2"),
        F.col("a.mmsi").alias("mmsi_1"),
        F.col("b.mmsi").alias("mmsi_2"),
        F.col("a.vessel_name").alias("vessel_1"),
        F.col("b.vessel_name").alias("vessel_2"),
        F.col("a.ts").alias("timestamp_1"),
        F.col("b.ts").alias("timestamp_2"),
        ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"),
        F.col("a.ix").alias("ix"), F.col("a.iy").alias("iy"),
    )
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    if emit == "shared":
        r = F.lit(radius)
        met = discs_meet_in_box(met, (ax, ay, r), (bx, by, r), cell_box(level))
        cell = cell_id(F.col("ix"), F.col("iy"), level)
    else:
        cell = cell_of((ax + bx) / 2.0, (ay + by) / 2.0, level)
    return met.withColumn("ix", cell).drop("iy", "ax", "ay", "bx", "by")
