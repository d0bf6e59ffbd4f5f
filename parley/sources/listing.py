"""A listing of recordings as a data source, for batch reads and as a stream.

``spark.read.format("recording_listing")`` lists files below ``path`` by name, size and time of
change; contents are never opened. Folders directly below ``path`` are dealt over at most
``tasks`` partitions (64 by default): tasks list them, the driver sees their names only.
``since`` (an ISO instant) leaves out what has not changed after it.

As a stream, an offset is an instant: a micro-batch has the files changed after the last one,
up to ``lag`` seconds before now (1 by default). Such a span is over when it is read, so its
listing is the same however often it is read, and a restart gives each file once. A file that
is put in place with an old time of change is not seen, as by any listing by time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file_id string, folder string, name string, size_bytes long, modified_at timestamp"
EPOCH = dt.datetime.fromtimestamp(0, dt.timezone.utc)
#: partitions of a listing; many small folders share one, as a task costs far more than a listing
TASKS = 64


@dataclass
class Folders(InputPartition):
    """Files of some folders (path, name, and whether those below count) changed after ``after`` and up to ``upto``, in microseconds; null is open."""

    folders: list[tuple[str, str, bool]]
    after: int | None = None
    upto: int | None = None


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _micros(instant: dt.datetime) -> int:
    return (instant - EPOCH) // dt.timedelta(microseconds=1)


def _folders(options: dict[str, str], after: int | None, upto: int | None) -> list[Folders]:
    system, root = _system(options["path"])
    found = system.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    folders = [(root, "", False), *((x.path, x.base_name, True) for x in found if x.type == pafs.FileType.Directory)]
    n = min(int(options.get("tasks", TASKS)), len(folders))
    return [Folders(folders[i::n], after, upto) for i in range(n)]


def _listed(options: dict[str, str], some: Folders) -> Iterator[tuple]:
    system, _ = _system(options["path"])
    suffix = options.get("suffix", ".wav")
    for path, name, deep in some.folders:
        for x in system.get_file_info(pafs.FileSelector(path, recursive=deep, allow_not_found=True)):
            if x.type != pafs.FileType.File or not x.base_name.endswith(suffix) or x.base_name.startswith((".", "_")):
                continue
            changed = x.mtime_ns // 1000
            if (some.after is None or changed > some.after) and (some.upto is None or changed <= some.upto):
                yield x.path, name, x.base_name, x.size, EPOCH + dt.timedelta(microseconds=changed)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        since = options.get("since")
        instant = dt.datetime.fromisoformat(since) if since else None
        if instant is not None and instant.tzinfo is None:
            instant = instant.replace(tzinfo=dt.timezone.utc)
        self.after = None if instant is None else _micros(instant)

    def partitions(self) -> list[Folders]:
        return _folders(self.options, self.after, None)

    def read(self, partition: Folders) -> Iterator[tuple]:
        return _listed(self.options, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.batch = _Batch(options)

    def initialOffset(self) -> dict:
        return {"upto": self.batch.after if self.batch.after is not None else -1}

    def latestOffset(self) -> dict:
        lag = dt.timedelta(seconds=float(self.options.get("lag", 1)))
        return {"upto": _micros(dt.datetime.now(dt.timezone.utc) - lag)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return _folders(self.options, start["upto"], end["upto"])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return _listed(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class RecordingListing(DataSource):
    """Options: ``path``, ``suffix`` (`.wav`), ``since``, ``tasks`` and, for a stream, ``lag``."""

    @classmethod
    def name(cls) -> str:
        return "recording_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingListing)
