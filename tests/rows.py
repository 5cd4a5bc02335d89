"""Hand-made pings."""

from datetime import datetime, timedelta, timezone

SCHEMA = "ping_id LONG, mmsi LONG, vessel_name STRING, ts TIMESTAMP, lon DOUBLE, lat DOUBLE, sog DOUBLE, sog_kmph DOUBLE, heading DOUBLE"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def pings_of(spark, *rows):
    """Pings from (mmsi, seconds, lon, lat[, km/h[, heading]])."""
    data = []
    for number, row in enumerate(rows):
        mmsi, seconds, lon, lat, *rest = row
        speed = rest[0] if rest else 20.0
        heading = rest[1] if len(rest) > 1 else 0.0
        data.append((number, mmsi, f"V{mmsi}", START + timedelta(seconds=seconds), lon, lat, speed, speed, heading))
    return spark.createDataFrame(data, SCHEMA)
