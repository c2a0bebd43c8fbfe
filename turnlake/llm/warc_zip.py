"""WARC records in ZIP packages: written by tasks, read back by ranges without unpacking an archive.

A package is a ZIP file with stored (not deflated) members: `archive/*.warc.gz`, in which every record is a gzip member of
its own, and `indexes/*.cdxj`, which names each record's place. The reader takes three steps, each a Spark stage: one row
for each package finds its members in the central directory (32-bit or ZIP64) by reading the end of the file; one row for
each index member gives its lines; then records are dealt by file and place, and a task reads runs of neighbouring
records. Nothing is unpacked and no package is held whole.

Packages lie in a folder that driver and executors share; any file system that pyarrow.fs knows by its URI will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.shared import hot_join, shared_dir, small_batches, staged

#: A task begins another package when one has this many bytes; payloads are not split, so one package may be longer.
PACKAGE_BYTES = 64 << 20
#: Records with equal payloads of at least this many bytes are written once.
LEAST_SHARED = 0
#: Neighbouring records of one archive are read at once up to this many bytes, if the gap between two is no longer than GAP.
READ_BYTES, GAP = 4 << 20, 64 << 10
#: Index lines in a batch, and bytes of an index or a directory read at once.
LINES, BLOCK = 2_000, 1 << 20
#: Date of the records: the tables name none, and reruns agree.
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the ZIP format: signatures and lengths of the end record, its ZIP64 locator and record, and the two headers.
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
CENTRAL, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
LONGEST_COMMENT, FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFF, 0xFFFFFFFF, 1

MEMBERS = "package string, name string, start long, size long, method int"
ENTRIES = "package string, archive string, start long, length long"
RECORDS = "package string, archive string, start long, record_id string, record_type string, target_uri string, refers_to string, http_length long, payload_digest string, payload binary"


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place, by path or URI."""
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def first_holders(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """pages as rows (row, page_id, url, html, refers_to, revisit): revisit marks a row whose payload a smaller page_id (null last), or an earlier equal row, has.

    Equal payloads are told by SHA-256 and length; a payload shorter than least bytes is never shared. The rows of a
    payload that many pages have are dealt over tasks.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html)
    size = F.octet_length("html")
    rows = rows.withColumn("same", F.when(size >= least, F.concat_ws(":", F.sha2("html", 256), size)))
    first = F.min(F.struct(F.col("page_id").isNull().alias("null"), F.col("page_id").alias("page_id"), F.col("row").alias("row")))
    holders = staged(rows.where(F.col("same").isNotNull()).groupBy("same").agg(first.alias("first"), F.count("*").alias("n")))
    total = holders.agg(F.sum("n")).first()[0] or 0
    shared = hot_join(rows.where(F.col("same").isNotNull()), holders, ["same"], F.col("row"), count="n", total=total)
    revisit = F.col("row") != F.col("first.row")
    found = shared.select("row", "page_id", "url", "html", F.when(revisit, F.col("first.page_id")).alias("refers_to"), revisit.alias("revisit"))
    if least <= 0:
        return found
    alone = rows.where(F.col("same").isNull()).select("row", "page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    return found.unionByName(alone)


def record_id(page_id: int | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def as_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", escaped(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    block = head if revisit else head + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def escaped(url: str) -> str:
    """A url without white space or control characters, so that it fits in a header line."""
    return "".join(x if x > " " and not x.isspace() and x != "\x7f" else quote(x) for x in url)


def sort_key(url: str | None) -> str:
    """A url with its host's labels in reverse, as indexes sort them; without a host, the url itself."""
    clean = escaped(url or "")
    try:
        parts = urlsplit(clean)
    except ValueError:
        return clean
    if not parts.netloc:
        return clean
    return ",".join(reversed(parts.netloc.lower().split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


class PackageWriter:
    """One package: records go to the archive as they come, the index is written when it is closed."""

    def __init__(self, path: str):
        self.path = path
        system, inner = fs.FileSystem.from_uri(path)
        self.sink = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, url: str | None, record: bytes, kind: str, digest: str) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.archive.write(member)
        told = {"url": escaped(url or ""), "type": kind, "digest": f"sha1:{digest}", "length": len(member), "offset": self.size, "filename": "data.warc.gz"}
        self.lines.append(f"{sort_key(url)} {DATE} {json.dumps(told, sort_keys=True)}\n")
        self.size += len(member)

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(sorted(self.lines)))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines), self.size


def written(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES, least: int = LEAST_SHARED) -> DataFrame:
    """Write pages (page_id, url, html) as packages and return them: one row (package, records, bytes) for each.

    Every task writes files with names of their own and reports those that it finished; the report is itself written
    before it is used, so what a lost or repeated task leaves behind is never read. Nulls: html counts as empty, a null
    url gives a record without one, a null page_id a record without a number. Repeated rows are records of their own. An
    empty table gives no package; other columns are not read, so their names cannot clash.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                digest = sha1_base32(payload)
                record = as_record(row["page_id"], row["url"], payload, row["revisit"], row["refers_to"], digest)
                now = now or PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                now.add(row["url"], record, "revisit" if row["revisit"] else "response", digest)
                if now.size >= package_bytes:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("package", "records", "bytes"), x, strict=True)) for x in done], schema=pa.schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return staged(first_holders(pages, least).drop("row").mapInArrow(write, "package string, records long, bytes long"))


# Reading


def directory_place(file: pa.NativeFile, size: int) -> tuple[int, int, int]:
    """(start, length, members) of the central directory, from the records at the end of the file."""
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT - LOCATOR_SIZE)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + (struct.unpack_from("<H", tail, at + 20)[0] if at + END_SIZE <= len(tail) else 0) != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    members, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == members or FULL32 in (length, start):
        if at < LOCATOR_SIZE or tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] != LOCATOR:
            raise ValueError("no locator of a ZIP64 directory")
        (end64,) = struct.unpack_from("<Q", tail, at - LOCATOR_SIZE + 8)
        record = file.read_at(END64_SIZE, end64)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        members, length, start = struct.unpack_from("<QQQ", record, 32)
    return start, length, members


def members_of(package: str) -> Iterator[dict]:
    """The members of one package, in the order of its directory, which is read in blocks; start is where a member's bytes begin."""
    with opened(package) as file:
        at, length, count = directory_place(file, file.size())
        end, held = at + length, b""
        for _ in range(count):
            while len(held) < CENTRAL_SIZE or len(held) < CENTRAL_SIZE + sum(struct.unpack_from("<HHH", held, 28)):
                more = file.read_at(min(BLOCK, end - at), at)
                if not more:
                    raise ValueError("the central directory ends early")
                held, at = held + more, at + len(more)
            if held[:4] != CENTRAL:
                raise ValueError("no central header where one belongs")
            flags, method = struct.unpack_from("<HH", held, 8)
            packed, size, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", held, 20)
            (local,) = struct.unpack_from("<I", held, 42)
            name = held[CENTRAL_SIZE : CENTRAL_SIZE + name_size].decode("utf-8" if flags & 0x800 else "cp437")
            extra = held[CENTRAL_SIZE + name_size : CENTRAL_SIZE + name_size + extra_size]
            size, packed, local = wide(extra, size, packed, local)
            held = held[CENTRAL_SIZE + name_size + extra_size + comment_size :]
            header = file.read_at(LOCAL_SIZE, local)
            if header[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            yield {"package": package, "name": name, "start": local + LOCAL_SIZE + sum(struct.unpack_from("<HH", header, 26)), "size": packed, "method": method}


def wide(extra: bytes, *values: int) -> list[int]:
    """Header values with those that are full replaced by 64-bit ones from the extra field, which holds just these in order."""
    at, found = 0, list(values)
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            place = at + 4
            for i, value in enumerate(found):
                if value == FULL32:
                    (found[i],) = struct.unpack_from("<Q", extra, place)
                    place += 8
        at += 4 + length
    return found


def package_members(packages: DataFrame) -> DataFrame:
    """One row (package, name, start, size, method) for each member of the packages (package)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column("package").to_pylist():
                if package is not None:
                    yield from _batched(members_of(package), MEMBERS)

    return packages.select("package").mapInArrow(read, MEMBERS)


def _batched(rows: Iterator[dict], ddl: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == LINES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def record_places(members: DataFrame) -> DataFrame:
    """One row (package, archive, start, length) for each record of the archives among members; start counts from the package's first byte.

    From the index members, which are read in blocks; archives of a package without an index are walked record by record.
    A member that must be read and is not stored is an error, as its bytes cannot be addressed.
    """
    of = lambda prefix: F.filter("members", lambda x: x["name"].startswith(prefix) & ~x["name"].endswith("/"))
    each = members.groupBy("package").agg(F.collect_list(F.struct("name", "start", "size", "method")).alias("members"))
    packages = each.select("package", of("archive/").alias("archives"), of("indexes/").alias("indexes"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for x in row["archives"] + row["indexes"]:
                    if x["method"]:
                        raise ValueError(f"{x['name']} of {row['package']} is not stored")
                yield from _batched(indexed(row) if row["indexes"] else walked(row), ENTRIES)

    return packages.mapInArrow(places, ENTRIES)


def indexed(package: dict) -> Iterator[dict]:
    archives = {x["name"].removeprefix("archive/"): x for x in package["archives"]}
    with opened(package["package"]) as file:
        for index in package["indexes"]:
            for line in _lines(file, index["start"], index["size"]):
                told = json.loads(line[line.index(b" {") + 1 :])
                archive = archives[told["filename"]]
                yield {"package": package["package"], "archive": archive["name"], "start": archive["start"] + int(told["offset"]), "length": int(told["length"])}


def _lines(file: pa.NativeFile, at: int, size: int) -> Iterator[bytes]:
    end, held = at + size, b""
    while at < end:
        more = file.read_at(min(BLOCK, end - at), at)
        at += len(more)
        *whole, held = (held + more).split(b"\n")
        yield from (x for x in whole if x.strip())
    if held.strip():
        yield held


def walked(package: dict) -> Iterator[dict]:
    """Places of records by unpacking an archive's gzip members one after the other, keeping none."""
    with opened(package["package"]) as file:
        for archive in package["archives"]:
            at, end, begun, unpacker = archive["start"], archive["start"] + archive["size"], archive["start"], zlib.decompressobj(31)
            held = b""
            while at < end or held:
                if not held:
                    held = file.read_at(min(BLOCK, end - at), at)
                    at += len(held)
                unpacker.decompress(held)
                held = unpacker.unused_data if unpacker.eof else b""
                if unpacker.eof:
                    yield {"package": package["package"], "archive": archive["name"], "start": begun, "length": at - len(held) - begun}
                    begun, unpacker = at - len(held), zlib.decompressobj(31)


def records(places: DataFrame) -> DataFrame:
    """The records at places (package, archive, start, length), with their payloads: columns as in RECORDS.

    Places are dealt over tasks by file and range, so that a task reads runs of neighbours and a large package is shared
    among tasks. payload is null for a revisit; http_length is what the HTTP header says of the payload's length.
    """
    small_batches(places.sparkSession)
    dealt = places.repartition("package", F.expr(f"start div {READ_BYTES * 4}")).sortWithinPartitions("package", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for package, run in _runs(row for batch in batches for row in batch.to_pylist()):
            with opened(package) as file:
                first = run[0]["start"]
                block = file.read_at(run[-1]["start"] + run[-1]["length"] - first, first)
            for x in run:
                record = parsed(zlib.decompress(block[x["start"] - first : x["start"] - first + x["length"]], 31))
                held.append({"package": package, "archive": x["archive"], "start": x["start"]} | record)
                size += len(record["payload"] or b"")
                if size >= READ_BYTES or len(held) >= LINES:
                    yield from _batched(iter(held), RECORDS)
                    held, size = [], 0
        yield from _batched(iter(held), RECORDS)

    return dealt.mapInArrow(read, RECORDS)


def _runs(places: Iterator[dict]) -> Iterator[tuple[str, list[dict]]]:
    run: list[dict] = []
    for x in places:
        if run:
            end = run[-1]["start"] + run[-1]["length"]
            if x["package"] != run[0]["package"] or not 0 <= x["start"] - end <= GAP or x["start"] + x["length"] - run[0]["start"] > READ_BYTES:
                yield run[0]["package"], run
                run = []
        run.append(x)
    if run:
        yield run[0]["package"], run


def parsed(record: bytes) -> dict:
    """Fields of one record; a response's payload is what follows its HTTP header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    said = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_id": fields["warc-record-id"],
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "http_length": int(said[b"content-length"]) if b"content-length" in said else None,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload": None if revisit else payload,
    }


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages (package): directory, index, ranges."""
    return records(record_places(package_members(packages)))


def op13_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as packages and read back; a response's length and digest are those of the payload as read, a revisit's those that its record tells."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return digest(read_packages(written(pages)))


def digest(found: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda column: F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    @F.pandas_udf("string")
    def own(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: None if x is None else sha1_base32(x))

    return found.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "http_length").alias("payload_bytes"),
        F.coalesce(own("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP13_SQL = """
with p as (select page_id, coalesce(html, '') as html, row_number() over () as row from pages),
f as (
    select page_id, html, row, sha1(html) as hex,
        first_value(page_id) over w as first_page, row_number() over w as place
    from p
    window w as (partition by html order by page_id nulls last, row)
),
d as (
    select *, list_transform(range(8), lambda g: cast('0x' || substr(hex, cast(5 * g + 1 as integer), 5) as integer)) as parts from f
)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((parts[cast(i // 4 + 1 as integer)] >> cast(15 - 5 * (i % 4) as integer)) & 31) as integer), 1)), 'string_agg', '') as payload_digest,
    case when place = 1 then 'response' else 'revisit' end as record_type,
    case when place > 1 then first_page end as refers_to
from d
"""
