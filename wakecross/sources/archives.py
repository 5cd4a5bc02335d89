"""Daily zip archives of position files."""

import errno
import io
import itertools
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakecross.sources.positions import POSITION_SCHEMA
from wakecross.sources.tables import stored

RECORDS_PER_BATCH = 20_000


def archive_name(day: Column) -> Column:
    """Name of the archive of one day."""
    return F.concat(F.lit("AIS_"), F.date_format(day, "yyyy_MM_dd"), F.lit(".zip"))


def daily_manifest(bounds: DataFrame) -> DataFrame:
    """One archive name per day; ``bounds`` has the columns first_day and last_day."""
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return days.select("day", archive_name(F.col("day")).alias("file_name"))


def missing_archives(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """The files of the manifest that are not among ``present.file_name``."""
    return manifest.join(present.select("file_name").distinct(), "file_name", "left_anti")


def present_archives(spark: SparkSession, path: str) -> DataFrame:
    """Names of the archives in a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


class _Ranges(io.RawIOBase):
    """A file of a store with the errors of Python's own files; ``zipfile`` relies on them in small archives."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if start + offset < 0:
            raise OSError(errno.EINVAL, "position before the start of the file")
        return self.file.seek(start + offset)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def open_seekable(path: str):
    """A file of any mounted or known store, opened for reading byte ranges."""
    if path.startswith("file:"):
        return _Ranges(fs.LocalFileSystem().open_input_file(unquote("/" + path[5:].lstrip("/"))))
    if "://" not in path:
        return _Ranges(fs.LocalFileSystem().open_input_file(path))
    # Names of one store that differ between readers.
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return _Ranges(system.open_input_file(inner))


def _records(text: Iterator[str]) -> Iterator[str]:
    """Records of CSV text: lines, put together while a quoted field is open."""
    held, quotes = [], 0
    for line in text:
        held.append(line)
        # A quote after a backslash belongs to the field's text.
        quotes += line.count('"') - line.count('\\"')
        if quotes % 2 == 0:
            yield "".join(held).rstrip("\r\n")
            held, quotes = [], 0
    if held:
        yield "".join(held).rstrip("\r\n")


def _member_lister() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task functions are made here, so that they travel to executors by value."""

    def members(batches):
        """The CSV members of each archive, from the directory at its end."""
        for batch in batches:
            for path in batch["path"]:
                with open_seekable(path) as source, zipfile.ZipFile(source) as archive:
                    found = [i for i in archive.infolist() if i.filename.lower().endswith(".csv")]
                    # A task without rows has left an archive without members.
                    if found:
                        yield pd.DataFrame({
                            "path": [path] * len(found), "member": [i.filename for i in found], "size": [i.file_size for i in found],
                        })

    return members


def _record_reader() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def records(batches):
        """The records of each member but its header, streamed out of its range of the archive."""
        for batch in batches:
            for path, name in zip(batch["path"], batch["member"]):
                with open_seekable(path) as source, zipfile.ZipFile(source) as archive, archive.open(name) as member:
                    text = _records(io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline=""))
                    next(text, None)
                    while block := list(itertools.islice(text, RECORDS_PER_BATCH)):
                        yield pd.DataFrame({"path": path, "record": block})

    return records


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size) of every CSV in the archives of a folder; only their directories are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    return files.mapInPandas(_member_lister(), "path STRING, member STRING, size LONG")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Positions of every CSV in the archives of a folder, in a task per member.

    Archives are read by byte ranges, first their directories, then each member on its own, so their size has no
    limit and one archive serves many tasks. Records are streamed, with line feeds inside quotes, and bytes that
    are not UTF-8 become replacement characters. Where there are fewer members than cores, records are
    spread over all of them before they are parsed.
    """
    members = stored(archive_members(spark, path))
    cores, found = spark.sparkContext.defaultParallelism, members.count()
    tasks = members.repartition(max(found, 1))
    records = tasks.mapInPandas(_record_reader(), "path STRING, record STRING")
    if 0 < found < cores:
        records = records.repartition(cores)
    return records.select(F.from_csv("record", POSITION_SCHEMA).alias("p")).select("p.*")


def write_archives(lines: DataFrame, path: str, header: str, rows_per_member: int = 100_000) -> None:
    """Writes CSV lines to a folder as zip archives, one per task, in members of at most so many rows."""
    os_path = path.rstrip("/")

    def write(batches):
        task = TaskContext.get().partitionId()
        rows = itertools.chain.from_iterable(batch["line"] for batch in batches)
        # One name a task, so that a task that is run again replaces its own archive.
        with _writable(f"{os_path}/part-{task:05d}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for number in itertools.count():
                block = list(itertools.islice(rows, rows_per_member))
                if not block:
                    break
                archive.writestr(f"part-{number}.csv", "\n".join([header, *block]) + "\n")
        yield pd.DataFrame({"done": [task]})

    lines.select("line").mapInPandas(write, "done INT").agg(F.count("done")).collect()


def _writable(path: str):
    if path.startswith("file:") or "://" not in path:
        local = unquote("/" + path.removeprefix("file:").lstrip("/"))
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return fs.LocalFileSystem().open_output_stream(local)
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return system.open_output_stream(inner)
