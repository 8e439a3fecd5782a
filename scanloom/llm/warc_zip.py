"""WARC records in ZIP packages: written by partitions, read back by ranges.

A package is a ZIP with two stored members: archive/data.warc.gz, whose records are gzip members of their
own, and indexes/index.tsv, with a line "offset length" of fixed width for each record.  The reader takes the
end record, the ZIP64 locator and directory, finds the members' places, reads a range of the index and each record
by its range; nothing is extracted, and a package is read by as many tasks as it has chunks of records.  Packages are written to and read from any store that Arrow knows by its address, below the
folder that all executors share; each task attempt writes files of its own, and only those named by the
attempt that counted are read.

Equal payloads of at least LEAST_BYTES bytes are stored once: the record with the smallest id is a response,
the others are revisits.  Null payloads are empty; null ids come after all others; of rows that have one id
and one payload, the first read is the response.  Rows are records of their own, however often they repeat; payloads
are whole, however long.  Other columns are not written.  An empty table gives no package and no row.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.shared import cut, numbered, shared_folder, tasks_for

LEAST_BYTES = 100
PACKAGE_BYTES = 256 << 20
CHUNK_RECORDS = 2_000
#: An index line: offset, tab, length, line end.
INDEX_LINE = "{:016d}\t{:012d}\n"
INDEX_BYTES = 30
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
NAMES = "urn:x-page:"


def record(page: int | None, url: str | None, payload: bytes, digest: str, original: str | None) -> bytes:
    """One WARC record; original: the id of the response that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if original is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:x-none:")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <{NAMES}{'' if page is None else page}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAMES}{original}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


class Package:
    """A ZIP file's members by name: (place of the data, size). Only stored members can be read by range."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.members = file, {}
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        count, length, start = struct.unpack("<10xHII", tail[end : end + 20])
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack("<8xQ", tail[end - 20 : end - 4])
            signature, count, length, start = struct.unpack("<4s28xQQQ", self.read(at, 56))
            if signature != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
        directory, at = self.read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, full, name, extra, comment, header = struct.unpack("<6xH8xIIHHH8xI", directory[at + 4 : at + 46])
            text = directory[at + 46 : at + 46 + name].decode()
            more = directory[at + 46 + name : at + 46 + name + extra]
            while len(more) >= 4:  # the ZIP64 field has, in this order, what does not fit above
                kind, n = struct.unpack("<HH", more[:4])
                if kind == 1:
                    wide = iter(struct.unpack(f"<{n // 8}Q", more[4 : 4 + n // 8 * 8]))
                    full, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (full, packed, header))
                more = more[4 + n :]
            self.members[text] = (header, packed, method)
            at += 46 + name + extra + comment

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def place(self, name: str) -> tuple[int, int]:
        header, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed: its records have no ranges")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory points")
        return header + 30 + sum(struct.unpack("<HH", local[26:30])), size


def with_originals(pages: DataFrame, page: str, payload: str, least: int) -> DataFrame:
    """pages has __row. Adds payload (binary), digest and original: null, or the id of the response of a revisit, as a string."""
    raw = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.withColumns({"__raw": raw, "__digest": F.sha2(raw, 256), "__rank": F.struct(F.col(f"`{page}`").isNull().alias("none"), F.col(f"`{page}`").alias("id"), F.col("__row").alias("row"))}).drop("__row")
    first = rows.filter(F.octet_length("__raw") >= least).groupBy("__digest").agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    first = cut(first, small=True)  # apart from the pages' own exchange, so that a payload with very many copies can be split
    both = rows.join(first.withColumnRenamed("__digest", "__d"), F.col("__digest") == F.col("__d"), "left").drop("__d")
    again = F.col("__first").isNotNull() & (F.col("__rank") != F.col("__first"))
    return both.withColumn("__original", F.when(again, F.coalesce(F.col("__first.id").cast("string"), F.lit("")))).drop("__rank", "__first")


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Writes the packages and returns a row for each: path, records. The rows are final, whatever is lost later."""
    rows = with_originals(numbered(pages.select(*[F.col(f"`{c}`") for c in (page, url, payload)]), "__row"), page, payload, least).select(F.col(f"`{page}`").alias("page"), F.col(f"`{url}`").alias("url"), "__raw", "__digest", "__original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, package = TaskContext.get(), 0, None
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close() -> pa.RecordBatch:
            stream, zipped, member, path, index, _ = package
            member.close()
            with zipped.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
                f.write("".join(INDEX_LINE.format(a, n) for a, n in index).encode())
            zipped.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(index)], pa.int64())})

        for batch in batches:
            for k in range(batch.num_rows):
                number, link, raw, digest, original = (batch[c][k].as_py() for c in range(5))
                if package is None:
                    path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{part}.wacz"
                    stream = store.open_output_stream(fs.FileSystem.from_uri(path)[1], compression=None)
                    zipped = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    member = zipped.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
                    package, part = [stream, zipped, member, path, [], 0], part + 1
                data = gzip.compress(record(number, link, raw, digest, original), 6, mtime=0)
                package[2].write(data)
                package[4].append((package[5], len(data)))
                package[5] += len(data)
                if package[5] >= PACKAGE_BYTES:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    return cut(rows.mapInArrow(run, "path string, records long"))


def read(packages: DataFrame, page_type: str = "long") -> DataFrame:
    """A row for each record of the packages (path, records): page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload.

    The payload of a revisit is null; that of a response must fit its digest.
    """
    chunks = packages.filter("records > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(CHUNK_RECORDS).cast("long"))).alias("first"))
    records = packages.agg(F.sum("records")).first()[0]
    chunks = chunks.repartition(tasks_for(records, CHUNK_RECORDS))  # adaptive execution would put these short rows into one task
    names = ["page", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
                store, own = fs.FileSystem.from_uri(path)
                with store.open_input_file(own) as file:
                    package = Package(file, file.size())
                    at, size = package.place(INDEX)
                    a, b = first * INDEX_BYTES, min(size, (first + CHUNK_RECORDS) * INDEX_BYTES)
                    index = [tuple(map(int, x.split(b"\t"))) for x in package.read(at + a, b - a).splitlines()]
                    at, size = package.place(ARCHIVE)
                    rows, held = [], 0
                    for offset, length in index:
                        if offset + length > size:
                            raise ValueError("the index points beyond its archive")
                        x = parse(gzip.decompress(package.read(at + offset, length)))
                        digest = x["warc-payload-digest"].removeprefix("sha256:")
                        fresh = x["warc-type"] == "response"
                        if fresh and hashlib.sha256(x["payload"]).hexdigest() != digest:
                            raise ValueError("a payload does not fit its digest")
                        whose = lambda name: x[name][1:-1].removeprefix(NAMES) if name in x else None
                        rows.append((whose("warc-record-id"), x["warc-type"], len(x["payload"]) if fresh else int(x["x-payload-length"]), digest, whose("warc-refers-to"), x["warc-target-uri"], x["payload"] if fresh else None))
                        held += len(x["payload"])
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    out = chunks.mapInArrow(run, "page string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary")
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(page_type)
    return out.select(number("page").alias("page_id"), "record_type", "payload_bytes", "payload_digest", number("refers_to").alias("refers_to"), "url", "payload")


def round_trip(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages to packages in a new folder below the shared one and reads them back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, page, url, payload, least), pages.schema[page].dataType.simpleString())
