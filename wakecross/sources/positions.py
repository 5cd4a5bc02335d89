"""Position files, the cargo filter, and the indexed ping table."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakecross.functions.grid import cell_of
from wakecross.functions.motion import kmph
from wakecross.functions.text import point_text
from wakecross.functions.units import PING_LEVEL

# The columns of a position file, in file order, and their types.
POSITION_SCHEMA = """
    MMSI INT, BaseDateTime TIMESTAMP, LAT DOUBLE, LON DOUBLE,
    SOG DOUBLE, COG DOUBLE, Heading DOUBLE,
    VesselName STRING, IMO STRING, CallSign STRING,
    VesselType INT, Status INT, Length INT, Width INT,
    Draft DOUBLE, Cargo INT, TranscieverClass STRING
"""

# Fixed value: the vessel type of cargo ships.
CARGO = 70

SNAKE_CASE = {
    "BaseDateTime": "ts",
    "VesselName": "vessel_name",
    "CallSign": "call_sign",
    "VesselType": "vessel_type",
    "TranscieverClass": "transceiver_class",
}


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder. Columns bind by position; other files are skipped."""
    return spark.read.csv(path, header=True, schema=POSITION_SCHEMA, pathGlobFilter="*.csv")


def snake_case(positions: DataFrame) -> DataFrame:
    """Positions under the column names the operators use."""
    renamed = positions.withColumnsRenamed(SNAKE_CASE)
    return renamed.select([F.col(name).alias(name.lower()) for name in renamed.columns])


def cargo_pings(pings: DataFrame) -> DataFrame:
    """Pings of cargo vessels that report a status."""
    return pings.where((F.col("vessel_type") == CARGO) & F.col("status").isNotNull())


def on_earth(pings: DataFrame) -> DataFrame:
    """Drops pings without a position, such as latitude 91 or longitude 181."""
    return pings.where(F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-90.0, 90.0))


def _instant(value: str | datetime) -> Column:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return F.lit(value)


def in_time_range(pings: DataFrame, first: str | datetime, last: str | datetime) -> DataFrame:
    """Pings between two instants, both included."""
    return pings.where(F.col("ts").between(_instant(first), _instant(last)))


def index_pings(pings: DataFrame, level: int = PING_LEVEL) -> DataFrame:
    """Adds point text, grid cell and km/h, and a ping id where there is none.

    A generated id is a hash of the whole row, so it stays the same however
    the rows are read again; equal rows share one.
    """
    if "ping_id" not in pings.columns:
        pings = pings.withColumn("ping_id", F.xxhash64(*pings.columns))
    return on_earth(pings).withColumns(
        {
            "point": point_text(F.col("lon"), F.col("lat")),
            "ix": cell_of(F.col("lon"), F.col("lat"), level),
            "sog_kmph": kmph(F.col("sog")),
        }
    )


def track(pings: DataFrame, mmsi: int, rows: int | None = None) -> DataFrame:
    """The pings of one vessel in time order; ``rows`` bounds them, for a map."""
    ordered = pings.where(F.col("mmsi") == mmsi).orderBy("ts", "ping_id")
    if rows is not None:
        ordered = ordered.limit(rows)
    return ordered.select("ix", "mmsi", "vessel_name", F.col("ts").cast("string").alias("ts"))
