"""Journals as a Spark data source: append-only JSON lines that are written once, read strictly, and never half taken.

A journal is a folder. Before anything else the driver writes its begin mark, and refuses a folder that has one: what exists
is never overwritten or resumed. Every task writes a part of its own, the header first, rows after it, and tells the driver
the part's name, number of entries and digest. Only the driver's commit, one file put in place at once, makes parts
entries of the journal. So a write that dies leaves a begin mark without a commit, whose parts no reader takes. A stream
commits one file for each micro-batch, and a batch that is written again replaces nothing.

    spark.dataSource.register(JournalSource)
    rows.write.format("journal").option("path", folder).option("protocol", digest).mode("append").save()
    spark.read.format("journal").load(folder)
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BEGIN, COMMIT = "_begin.json", "_commit-"
SCHEMA = "part string, line long, entry string"


class JournalError(ValueError):
    """What breaks a journal's rules."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def names_in(path: str) -> list[str]:
    system, folder = located(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(posixpath.basename(x.path) for x in found)


def read_bytes(path: str, name: str) -> bytes:
    system, folder = located(path)
    with system.open_input_stream(f"{folder}/{name}") as file:
        return file.read()


def put(path: str, name: str, content: bytes) -> None:
    """A file written under another name and then put in its place at once."""
    system, folder = located(path)
    system.create_dir(folder, recursive=True)
    waiting = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(waiting) as file:
        file.write(content)
    system.move(waiting, f"{folder}/{name}")


def begin(path: str, protocol: str) -> None:
    """Write the begin mark; a folder that holds anything is refused."""
    if held := names_in(path):
        raise FileExistsError(f"{path} holds {held[0]}; a journal is written once")
    put(path, BEGIN, json.dumps({"event": "header", "protocol": protocol}).encode())


def commits(path: str) -> list[dict]:
    """The commits of a journal in order of their batches."""
    found = [json.loads(read_bytes(path, x)) for x in names_in(path) if x.startswith(COMMIT)]
    return sorted(found, key=lambda x: x["batch"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    entries: int
    digest: str


@dataclass
class PartOf(InputPartition):
    name: str
    entries: int
    digest: str
    protocol: str


def write_part(path: str, protocol: str, rows: Iterator) -> Part:
    """One task's rows as a part: the header, then an entry for each row, JSON with sorted keys; NaN and infinities are refused."""
    system, folder = located(path)
    name, digest, n = f"part-{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0
    with system.open_output_stream(f"{folder}/{name}") as file:

        def append(entry: dict) -> None:
            line = json.dumps(entry, ensure_ascii=False, allow_nan=False, sort_keys=True, default=str).encode() + b"\n"
            digest.update(line)
            file.write(line)

        append({"event": "header", "protocol": protocol})
        for row in rows:
            append(row.asDict(recursive=True))
            n += 1
    return Part(name, n, digest.hexdigest())


def read_part(path: str, part: PartOf) -> Iterator[tuple[str, int, str]]:
    """Entries of one part, read strictly: its digest, its header and its number of entries must be those that the commit tells."""
    data = read_bytes(path, part.name)
    if hashlib.sha256(data).hexdigest() != part.digest:
        raise JournalError(f"{part.name} is not as it was committed")
    header, *lines = data.decode().split("\n")[:-1]
    if json.loads(header) != {"event": "header", "protocol": part.protocol} or len(lines) != part.entries:
        raise JournalError(f"{part.name} does not begin with its header or has other entries")
    yield from ((part.name, i, line) for i, line in enumerate(lines))


def commit(path: str, protocol: str, messages: list, batch: int) -> None:
    """Make parts entries of the journal; the commit of a batch that has one stays as it is."""
    name = f"{COMMIT}{batch:012d}.json"
    if name not in names_in(path):
        parts = [{"name": x.name, "entries": x.entries, "digest": x.digest} for x in messages if x is not None]
        put(path, name, json.dumps({"batch": batch, "protocol": protocol, "parts": parts}).encode())


def drop(path: str, messages: list) -> None:
    """Remove the parts of a write that failed, as far as they are known."""
    system, folder = located(path)
    for x in messages:
        if x is not None:
            system.delete_file(f"{folder}/{x.name}")


def parts_of(path: str, found: list[dict]) -> list[PartOf]:
    mark = json.loads(read_bytes(path, BEGIN)) if BEGIN in names_in(path) else None
    if mark is None:
        raise JournalError(f"{path} has no begin mark")
    if any(x["protocol"] != mark["protocol"] for x in found):
        raise JournalError("a commit has another protocol than the journal")
    return [PartOf(**part, protocol=x["protocol"]) for x in found for part in x["parts"]]


class JournalSource(DataSource):
    """Format journal; options path and, for writing, protocol."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return JournalReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return JournalStreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise JournalError("a journal is never overwritten")
        begin(self.options["path"], self.options["protocol"])
        return JournalWriter(self.options["path"], self.options["protocol"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        path, protocol = self.options["path"], self.options["protocol"]
        if BEGIN not in names_in(path):
            begin(path, protocol)
        elif json.loads(read_bytes(path, BEGIN))["protocol"] != protocol:
            raise FileExistsError(f"{path} is the journal of another protocol")
        return JournalStreamWriter(path, protocol)


class JournalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[PartOf]:
        return parts_of(self.path, commits(self.path))

    def read(self, partition: PartOf | None) -> Iterator[tuple[str, int, str]]:
        return read_part(self.path, partition) if partition is not None else iter(())


class JournalStreamReader(DataSourceStreamReader):
    """Commits are the offsets of a stream: each is read once, in order."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[PartOf]:
        return parts_of(self.path, commits(self.path)[start["commits"] : end["commits"]])

    def read(self, partition: PartOf) -> Iterator[tuple[str, int, str]]:
        return read_part(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go: entries stay."""


class JournalWriter(DataSourceWriter):
    def __init__(self, path: str, protocol: str):
        self.path, self.protocol = path, protocol

    def write(self, iterator: Iterator) -> Part:
        return write_part(self.path, self.protocol, iterator)

    def commit(self, messages: list) -> None:
        commit(self.path, self.protocol, messages, 0)

    def abort(self, messages: list) -> None:
        drop(self.path, messages)


class JournalStreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, protocol: str):
        self.path, self.protocol = path, protocol

    def write(self, iterator: Iterator) -> Part:
        return write_part(self.path, self.protocol, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        commit(self.path, self.protocol, messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        drop(self.path, messages)
