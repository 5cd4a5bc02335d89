"""Port locations from a GeoJSON feature collection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS_SCHEMA = """
    type STRING,
    features ARRAY<STRUCT<
        type: STRING,
        properties: STRUCT<PORT_NAME: STRING>,
        geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>
    >>
"""


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """Port names and points. The schema is given, so there is no inference job."""
    return ports_of(spark.read.schema(PORTS_SCHEMA).option("multiLine", True).json(path))


def ports_of(collection: DataFrame) -> DataFrame:
    """One row per point feature of parsed feature collections."""
    return (
        collection.select(F.explode("features").alias("feature"))
        .select(
            F.col("feature.properties.PORT_NAME").alias("name"),
            F.to_json("feature.geometry").alias("json_geometry"),
            F.col("feature.geometry.coordinates").alias("at"),
        )
        .select("name", "json_geometry", F.col("at")[0].alias("lon"), F.col("at")[1].alias("lat"))
    )
