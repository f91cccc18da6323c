"""Files of binary event batches as a data source, for batch and stream: ``spark.read.format("event_batches").load(folder)``.

A file is a sequence of batches, each with its length (32 bits, little-endian) before it. The folder is one that the driver and
all executors reach as a path.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from pulsegrid.session import ship_package

from . import wire

SCHEMA = "file string, batch int, place int, timestamp long, duration_ms float, status_code int, is_error boolean"
SUFFIX = ".events"
#: Bytes of files in a partition, about.
PART_BYTES = 64 << 20
_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _batches(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while len(head := f.read(4)) == 4:
            body = f.read(struct.unpack("<I", head)[0])
            yield body


def _read(folder: str, names: list[str], pushed: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The events of the files, a batch at a time, without those that the pushed filters leave out."""
    for name in names:
        for number, body in enumerate(_batches(os.path.join(folder, name))):
            events = wire.decode_batch(body)
            keep = np.ones(len(events), bool)
            for compare, column, value in pushed:
                keep &= compare(events[column].astype(np.float64 if column == "duration_ms" else np.int64), value)
            at = np.flatnonzero(keep)
            own = events[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), number, np.int32)), pa.array(at.astype(np.int32)), pa.array(own["timestamp"].astype(np.int64)), pa.array(own["duration_ms"]), pa.array(own["status_code"].astype(np.int32)), pa.array(own["status_code"] >= 400)],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )


def _names(folder: str, after: str = "", upto: str | None = None) -> list[str]:
    return sorted(n for n in os.listdir(folder) if n.endswith(SUFFIX) and n > after and (upto is None or n <= upto))


def _parts(folder: str, names: list[str]) -> list[Files]:
    """Partitions of whole files, of about PART_BYTES each."""
    out, held, size = [], [], 0
    for n in names:
        held.append(n)
        size += os.path.getsize(os.path.join(folder, n))
        if size >= PART_BYTES:
            out.append(Files(held))
            held, size = [], 0
    return [*out, Files(held)] if held or not out else out


class EventFilesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.pushed = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of times, durations and codes are made on the decoded arrays; Spark makes the others."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _COMPARE and len(column) == 1 and column[0] in ("timestamp", "duration_ms", "status_code") and f.value is not None:
                self.pushed.append((_COMPARE[type(f)], column[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return _parts(self.folder, _names(self.folder))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition.names, self.pushed)


class EventFilesStream(DataSourceStreamReader):
    """Files by name: an offset is the last one read, so new files must have names after the old ones'."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(_names(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _parts(self.folder, _names(self.folder, start["file"], end["file"]))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition.names, [])

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    def __init__(self, draft: str | None):
        self.draft = draft


class EventFilesWriter(DataSourceWriter):
    """Rows (body) as files of batches, one for each task, which get their names when the job is committed."""

    def __init__(self, folder: str, prefix: str):
        self.folder, self.prefix = folder, prefix

    def write(self, rows) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        draft = os.path.join(self.folder, f"_{uuid.uuid4().hex}")
        n = 0
        with open(draft, "wb") as f:
            for r in rows:
                f.write(struct.pack("<I", len(r["body"])) + bytes(r["body"]))
                n += 1
        if n:
            return Written(draft)
        os.remove(draft)
        return Written(None)

    def commit(self, messages: list[Written | None]) -> None:
        drafts = [m.draft for m in messages if m is not None and m.draft]
        for i, draft in enumerate(drafts):
            os.rename(draft, os.path.join(self.folder, f"{self.prefix}-{i:06d}{SUFFIX}"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.draft and os.path.exists(m.draft):
                os.remove(m.draft)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_batches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EventFilesReader:
        return EventFilesReader(self.options["path"])

    def streamReader(self, schema) -> EventFilesStream:
        return EventFilesStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> EventFilesWriter:
        return EventFilesWriter(self.options["path"], self.options.get("prefix", "part"))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter pushdown."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventFiles)
