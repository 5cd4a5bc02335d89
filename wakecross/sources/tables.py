"""Tables and views: overwrite, clustered overwrite, read, set-up."""

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_schema(spark: SparkSession, name: str) -> None:
    """Creates a schema if needed and makes it the current one."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    spark.catalog.setCurrentDatabase(name)


# Folders of the workspaces that are open, the innermost last.
_WORKSPACES: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    """Spark's own file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_root(spark: SparkSession) -> str:
    """The folder that all of the cluster can write to and read from.

    That is the session's ``spark.checkpoint.dir``. Only a session in one
    process, as in tests, may leave it unset and gets a local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
        root = tempfile.mkdtemp(prefix="wakecross-")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name for written tables, below the cluster's shared folder.

    What is written there is deleted when its workspace closes, and else when the driver ends.
    """
    own = f"{shared_root(spark)}/wakecross-{uuid.uuid4().hex}"
    system, place = _file_system(spark, own)
    system.mkdirs(place)
    system.deleteOnExit(place)
    if _WORKSPACES:
        _WORKSPACES[-1].append(own)
    return f"{own}/data"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Owns the folders that are written while the block runs, and deletes them at its end.

    Frames built on them can be used inside the block only: collect or write them there.
    """
    _WORKSPACES.append([])
    try:
        yield
    finally:
        for folder in _WORKSPACES.pop():
            system, place = _file_system(spark, folder)
            system.delete(place, True)


def overwrite_table(frame: DataFrame, name: str) -> None:
    """Replaces a table, its schema included."""
    frame.write.mode("overwrite").saveAsTable(name)


def overwrite_files(frame: DataFrame, path: str) -> None:
    """Replaces the parquet files of a folder, their schema included."""
    frame.write.mode("overwrite").parquet(path)


def stored(frame: DataFrame) -> DataFrame:
    """The rows of a frame, written once to the shared folder and read from there.

    This cuts a long lineage between two steps. It outlives lost executors, and
    later passes over it read only the columns and row groups they need.
    """
    path = shared_folder(frame.sparkSession)
    overwrite_files(frame, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def cached(frame: DataFrame) -> Iterator[DataFrame]:
    """A frame kept in the cluster's memory and disk while the block runs.

    Only this frame is released afterwards, not what others have cached.
    """
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def preview(frame: DataFrame, rows: int = 1) -> DataFrame:
    """A few rows to look at; without an order they may be any."""
    return frame.limit(rows)


def clustered(frame: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Rows laid out by range of the given columns, and sorted within each file.

    Written as parquet, the min/max statistics of files and row groups then skip
    most data for filters on these columns. Cell ids sort in Z-order. Ranges are
    sampled on all the columns, so that a hot cell is split by the later ones.
    """
    if partitions is None:
        ranged = frame.repartitionByRange(*columns)
    else:
        ranged = frame.repartitionByRange(partitions, *columns)
    return ranged.sortWithinPartitions(*columns)


def overwrite_parts(frame: DataFrame, path: str, part: str, *columns: str) -> None:
    """Replaces the parts of a clustered table that the frame has rows of, and leaves the others as they are.

    ``part`` is the column, such as a day, that the table is divided by into folders; each part is laid out as
    ``clustered`` does, so that file statistics go on skipping data after any number of replacements.
    """
    laid = clustered(frame, part, *columns)
    laid.write.partitionBy(part).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def spread(frame: DataFrame, *columns: str, factor: int = 4, source: DataFrame | None = None) -> DataFrame:
    """Enough tasks for heavy work per row: ``factor`` per core of the cluster.

    Input that already comes in at least one part per core is left as it is,
    since a shuffle of large input costs more than it gains. ``source``, the
    table behind the frame, is quicker to ask for its parts.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if (source or frame).rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores * factor, *columns)


def row_count(frame: DataFrame) -> DataFrame:
    """Number of rows, plain and with thousands separators, as one row."""
    return frame.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.format_number("rows", 0).alias("text")
    )
