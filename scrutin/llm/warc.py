"""WARC records in ZIP packages: written, located and range-read.

A package is a ZIP archive whose members are stored, not deflated:
``archive/data.warc.gz`` (each record a gzip member of its own) and
``indexes/index.cdxj`` (offset and length of each record). A reader takes the
end of the file, follows the end-of-directory records (ZIP64 ones included) to
the central directory, computes where the stored members begin, and reads the
records by byte ranges; nothing is extracted.

Tasks write to names of their own and report them; only reported packages are
read, so a task that is lost or repeated leaves no half record behind. Files
go through ``pyarrow.fs``, by the URI of the shared checkpoint folder (``file``,
``hdfs`` with the cluster's client library, object stores).

Edge cases: null html is an empty payload; null url has no target line, line
breaks in a url are percent-encoded; a null id is a record without one; rows
that share an id and payload are all the response if the id is the smallest;
equal payloads only under null ids are all responses; an empty table writes no
package and reads no row.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import table, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task begins another package, and bytes of records read at once.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Smallest payload that may be stored as a revisit of an equal one.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response, or a revisit that keeps its headers."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _zipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Package:
    """A package being written; members are streamed, sizes may pass 4 GiB."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.size, self.count, self.index = uri, 0, 0, io.BytesIO()
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, page_id, url, data: bytes) -> None:
        data = _zipped(data)
        self.member.write(data)
        entry = {"url": url, "offset": str(self.size), "length": str(len(data))}
        self.index.write(f"{'' if page_id is None else page_id} {DATE} {json.dumps(entry)}\n".encode())
        self.size += len(data)
        self.count += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write(self.index.getvalue())
        self.zip.close()
        self.out.close()
        return self.uri, self.count, self.size


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """``name -> (first byte, length)`` of the stored members of a ZIP archive,
    from range reads of its directories."""
    def at(offset, n):
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive, or cut short")
    count, length, start = struct.unpack("<10xHII", tail[end:end + 20])
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":  # ZIP64 locator
        where, = struct.unpack("<8xQ", tail[end - 20:end - 4])
        zip64 = at(where, 56)
        if zip64[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end of central directory")
        count, length, start = struct.unpack("<32xQQQ", zip64)
    directory, pos, found = at(start, length), 0, {}
    for _ in range(count):
        if directory[pos:pos + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, packed, plain, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", directory[pos:pos + 46])
        name = directory[pos + 46:pos + 46 + n_name].decode()
        extra = directory[pos + 46 + n_name:pos + 46 + n_name + n_extra]
        while len(extra) >= 4:  # sizes and place that did not fit 32 bits
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n:]
        pos += 46 + n_name + n_extra + n_note
        if method == 0:
            n_name, n_extra = struct.unpack("<26xHH", at(local, 30))
            found[name] = local + 30 + n_name + n_extra, packed
    return found


def ranges(uri: str) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole records, about ``RANGE_BYTES`` each. A package
    without an index is one range per archive member."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        found = members(f, f.size())
        for name, (start, size) in found.items():
            if not name.startswith("archive/"):
                continue
            if INDEX not in found or name != DATA:
                yield start, size
                continue
            f.seek(found[INDEX][0])
            first = last = 0
            for line in io.BytesIO(f.read(found[INDEX][1])):
                entry = json.loads(line[line.index(b"{"):])
                last = int(entry["offset"]) + int(entry["length"])
                if last - first >= RANGE_BYTES:
                    yield start + first, last - first
                    first = last
            if last > first:
                yield start + first, last - first


def records(uri: str, start: int, size: int) -> Iterator[bytes]:
    """The records of a byte range, unpacked one at a time."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        rest, buffer = size, b""
        while rest or buffer:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not buffer:
                    buffer = f.read(min(rest, _BLOCK))
                    rest -= len(buffer)
                    if not buffer:
                        raise ValueError(f"{uri}: a record ends after its range")
                parts.append(z.decompress(buffer))
                buffer = z.unused_data
            yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of a WARC record; the digest of a response is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[:int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = field["warc-payload-digest"].removeprefix("sha1:"), field["warc-type"]

    def page(urn):
        n = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(n) if n else None

    if kind == "response":
        size = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"{field['warc-record-id']}: payload differs from its digest")
    else:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"page_id": page(field["warc-record-id"]), "url": field.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind,
            "refers_to": page(field["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record per row to packages under ``folder`` (a URI all
    executors share); returns the manifest ``(uri, records, bytes)``."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    first = (rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null"))
    # both sides come from files, so AQE may split the rows of one common payload
    rows = rows.join(written(first.select("digest", "first")), "digest", "left").drop("digest")

    def run(batches):
        package = None
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, target, payload, first_id = (batch.column(c)[r].as_py() for c in ("id", "url", "payload", "first"))
                revisit = first_id is not None and page_id != first_id
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(page_id, target, record(page_id, target, payload, first_id, revisit))
                if package.size >= package_bytes:
                    yield done(package)
                    package = None
        if package:
            yield done(package)

    def done(package):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in package.close()], ["uri", "records", "bytes"])

    return written(rows.select("id", "url", "payload", "first").mapInArrow(run, "uri string, records bigint, bytes bigint"))


FIELDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, payload binary")


def read_packages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the packages named in ``manifest.uri``, read by ranges;
    ``payload=False`` checks payloads against their digests but leaves them out."""
    def locate(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                found = list(ranges(uri))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()),
                     pa.array([x for _, x in found], pa.int64())], ["uri", "start", "size"])

    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    if not payload:
        del types["payload"]

    def read(batches):
        for batch in batches:
            for uri, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for data in records(uri, start, size):
                    rows.append(parse(data))
                    held += len(data)
                    if held >= RANGE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()],
                                                         names=list(types))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()],
                                                     names=list(types))

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = manifest.select("uri").repartition(spread).mapInArrow(locate, "uri string, start bigint, size bigint")
    return where.repartition(spread).mapInArrow(read, FIELDS if payload else FIELDS.removesuffix(", payload binary"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to packages and read back."""
    folder = scratch_path(spark, "warc", uuid.uuid4().hex)
    manifest = write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_packages(manifest, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL: dict[str, str] = {}
