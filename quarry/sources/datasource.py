"""Web archives as a Spark data source: spark.read.format("warc") and df.write.format("warc")."""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.sources.formats import record_bytes

SCHEMA = "kind string, uri string, date string, content_type string, block binary"


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    """A task for each file; records are read one at a time."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        return [File(os.path.join(self.path, x)) for x in sorted(os.listdir(self.path)) if x.endswith(".warc.gz")]

    def read(self, partition: File) -> Iterator[tuple]:
        with gzip.open(partition.path) as f:
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue
                fields = {}
                while (line := f.readline().rstrip(b"\r\n")):
                    k, _, v = line.decode().partition(": ")
                    fields[k] = v
                block = f.read(int(fields["Content-Length"]))
                yield fields["WARC-Type"], fields.get("WARC-Target-URI"), fields["WARC-Date"], fields["Content-Type"], block


class WarcWriter(DataSourceWriter):
    """A file for each task, under a name of the attempt until the job commits."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        temporary, n = os.path.join(self.path, f".{part}-{uuid.uuid4().hex}"), 0
        with open(temporary, "wb") as out:
            for r in rows:
                out.write(gzip.compress(record_bytes(r.kind, r.date, f"{part:05d}-{n:012d}", r.uri or "", r.content_type or "", {}, bytes(r.block or b"")), mtime=0))
                n += 1
        return Written(temporary, os.path.join(self.path, f"part-{part:05d}.warc.gz"), n)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)
