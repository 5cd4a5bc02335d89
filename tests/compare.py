"""Runs registered queries next to their SQL twins in DuckDB."""

import math
from datetime import date, datetime
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with a view per given table."""
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = [tuple(_plain(row[k]) for k in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark, connection, query, sql: str, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    """Sorted rows of both engines, after checking the column names."""
    frame = query(spark, sf_dir)
    relation = connection.sql(sql)
    assert sorted(frame.columns) == sorted(relation.columns)
    return rows_of(frame.columns, frame.collect()), rows_of(relation.columns, relation.fetchall())
