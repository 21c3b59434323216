"""A1/A2: evidence records — (json metadata, content bytes) pairs.

The dump format is a plain sequence of records: 8-byte little-endian JSON
size, the JSON, 8-byte little-endian content size, the content; no header or
footer. Only the sizes tell where the next record begins, so a dump is read in
two steps: a task per file walks the headers, skips what they announce and
cuts the file into ranges of whole records; then every range is a task of its
own that reads its bytes as Arrow batches. A file that ends inside a record is
an error of the walk. Files are listed through Hadoop's file system and opened
in the tasks through Arrow's (local folders, ``hdfs``, ``s3``, ``gs``, ``abfs``).

``records_view`` derives a record table from the driver's ``documents`` so
every record operator runs over generated data: the metadata carries path,
name, size and times of the evidence view; every tenth document declares a
size 200 bytes short of its content, which leaves a slack tail.
"""

from __future__ import annotations

import io
import itertools
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize
from .tables import evidence_view

RECORD_SCHEMA = "file string, idx long, metadata string, content binary"
#: Bytes of a range, of a header read, and of a batch of records.
RANGE_BYTES, HEADER_BYTES, BATCH_BYTES = 64 << 20, 1 << 16, 8 << 20


def records_view(documents: DataFrame, *more) -> DataFrame:
    """(seq, metadata, content) — one record per document, with ``more``
    columns of the document."""
    ev = evidence_view(documents, *more).withColumn("doc_id", F.col("ID").cast("long") / 2)
    content = F.encode(F.col("body"), "UTF-8")
    total = F.octet_length(content)
    size = F.when((F.col("doc_id") % 10 == 0) & (total > 200), total - 200).otherwise(total)
    meta = F.to_json(F.struct(
        F.col("path"), F.struct(F.col("name").alias("name")).alias("name"),
        F.struct(size.alias("size"), F.col("modified").alias("mtime"), F.col("created").alias("crtime"),
                 F.col("accessed").alias("atime")).alias("meta")))
    return ev.select(F.col("doc_id").cast("long").alias("seq"), meta.alias("metadata"), content.alias("content"),
                     *[c for c in ev.columns if c.startswith("_")])


def described_records(documents: DataFrame) -> DataFrame:
    """:func:`records_view` whose metadata has further keys, nested ones and
    lists among them: origin, tags, the time of acquisition as text, counts
    and a checksum, as a forensic tool writes them."""
    seq = F.col("doc_id")
    acquired = F.date_format(F.timestamp_seconds(F.lit(1300000000) + seq * 7200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    more = F.to_json(F.struct(
        F.struct("lang", F.col("source").alias("corpus")).alias("origin"), F.array("lang", "source").alias("tags"),
        acquired.alias("acquired"), F.struct(F.col("n_chars").alias("chars"), (F.col("n_chars") / 4).alias("words")).alias("count"),
        F.struct(F.array(F.struct(F.md5("text").alias("md5"))).alias("sums")).alias("hash"), (seq % 3 == 0).alias("deleted")))
    both = F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(","), F.expr("substring(_more, 2)"))
    documents = documents.where(seq.isNotNull())
    # a number that several documents share is described by each of them; they
    # alone are joined, other contents stay where they are
    again = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return records_view(documents, more.alias("_more")).select("seq", both.alias("metadata"), "content")
    again = bounded_broadcast(again)
    once, shared = documents.join(again, "doc_id", "left_anti"), documents.join(again, "doc_id", "left_semi")
    joined = records_view(shared).join(shared.select(seq.alias("seq"), more.alias("_more")), "seq")
    return records_view(once, more.alias("_more")).unionByName(joined).select("seq", both.alias("metadata"), "content")


# ------------------------------------------------------------------ A1 source

def filesystem(path: str):
    """Arrow's file system of a path, and the path inside it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def dump_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and lengths of the dump files at a path (a file or a folder)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath(), s.getLen()) for s in fs.listStatus(p) if s.isFile()]
    return sorted((f.toString(), n) for f, n in found if not f.getName().startswith((".", "_")))


def walk(fh, length: int, range_bytes: int = RANGE_BYTES):
    """``(first record, begin, end, records)`` of the ranges of whole records
    in a dump of ``length`` bytes; reads headers only."""
    held, at = b"", 0

    def number(pos: int) -> int:
        nonlocal held, at
        if not at <= pos <= at + len(held) - 8:
            fh.seek(pos)
            held, at = fh.read(HEADER_BYTES), pos
        if len(held) - (pos - at) < 8:
            raise ValueError("evidence dump ends inside a record header")
        (n,) = struct.unpack_from("<q", held, pos - at)
        if n < 0:
            raise ValueError("evidence dump holds a negative size")
        return n

    pos = begin = first = idx = 0
    while pos < length:
        content = pos + 8 + number(pos)
        if content + 8 > length:
            raise ValueError("evidence dump ends inside a record")
        pos = content + 8 + number(content)
        if pos > length:
            raise ValueError("evidence dump ends inside record content")
        idx += 1
        if pos - begin >= range_bytes:
            yield first, begin, pos, idx - first
            first, begin = idx, pos
    if pos > begin:
        yield first, begin, pos, idx - first


def dump_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, first, begin, end, records)``: ranges of whole records of about
    ``range_bytes`` (a longer record is a range of its own)."""
    files = dump_files(spark, path)
    schema = "file string, first long, begin long, end long, records long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for file, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, inner = filesystem(file)
                with fs.open_input_file(inner) as fh:
                    rows = [(file, *r) for r in walk(fh, length, range_bytes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), *[pa.int64()] * 4])],
                    names=["file", "first", "begin", "end", "records"])

    return spark.createDataFrame(files, "file string, length long").repartition(len(files)).mapInArrow(run, schema)


def read_dumps(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A1: ``(file, idx, metadata, content)`` of all records at a path, one
    task per range."""
    ranges = materialize(dump_ranges(spark, path, range_bytes))

    def run(batches):
        for b in batches:
            for file, first, begin, n in zip(*(b.column(c).to_pylist() for c in ("file", "first", "begin", "records"))):
                fs, inner = filesystem(file)
                with fs.open_input_file(inner) as fh:
                    fh.seek(begin)
                    rows, size = [], 0
                    buffered = io.BufferedReader(fh, BATCH_BYTES)
                    for idx, (meta, content) in enumerate(itertools.islice(read_records(buffered), n), first):
                        rows.append((file, idx, meta, content))
                        size += len(content) + len(meta)
                        if size >= BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    def batch(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          names=["file", "idx", "metadata", "content"])

    return ranges.repartition(max(1, ranges.count())).mapInArrow(run, RECORD_SCHEMA)


def read_records(fh):
    """Yield (json, bytes) until EOF; EOF inside a record raises."""
    while True:
        head = fh.read(8)
        if not head:
            return
        if len(head) < 8:
            raise ValueError("evidence dump ends inside a record header")
        (jlen,) = struct.unpack("<q", head)
        meta = fh.read(jlen)
        clen_b = fh.read(8)
        if len(meta) < jlen or len(clen_b) < 8:
            raise ValueError("evidence dump ends inside a record")
        (clen,) = struct.unpack("<q", clen_b)
        content = fh.read(clen)
        if len(content) < clen:
            raise ValueError("evidence dump ends inside record content")
        yield meta.decode("utf-8"), content


def encode_record(meta: str, content: bytes) -> bytes:
    m = meta.encode("utf-8")
    return struct.pack("<q", len(m)) + m + struct.pack("<q", len(content)) + bytes(content)


def write_dump(records: DataFrame, directory: str) -> DataFrame:
    """Write one dump file per partition (records in ``seq`` order within
    the file) into ``directory`` on a shared file system; returns the
    (file, records) written."""
    directory = directory.rstrip("/")

    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        fs, inner = filesystem(directory)
        fs.create_dir(inner, recursive=True)
        # deterministic name per partition, written under a temporary name and
        # renamed at the end: a retried task replaces, never duplicates
        path = f"{inner}/part-{ctx.partitionId():05d}.dump"
        tmp = f"{inner}/.part-{ctx.partitionId():05d}-{ctx.attemptNumber()}.tmp"
        n = 0
        with fs.open_output_stream(tmp) as fh:
            for b in batches:
                metas = b.column(b.schema.get_field_index("metadata")).to_pylist()
                contents = b.column(b.schema.get_field_index("content")).to_pylist()
                for m, c in zip(metas, contents):
                    fh.write(encode_record(m, c or b""))
                    n += 1
        fs.move(tmp, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())],
                                         names=["file", "records"])

    return records.sortWithinPartitions("seq").select("metadata", "content").mapInArrow(
        run, "file string, records long")


def with_ordinals(recs: DataFrame) -> DataFrame:
    """A2: global record number ``n`` from per-file counts and a prefix sum
    over files (files in name order, records in file order), then document
    ids ``2n`` (file) and ``2n+1`` (slack). Only the per-file count table —
    one row per file — is ranked, never the records themselves."""
    counts = recs.groupBy("file").agg(F.count(F.lit(1)).alias("n_file"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", F.coalesce(F.sum("n_file").over(w), F.lit(0)).alias("base"))
    j = recs.join(bounded_broadcast(offsets), "file")
    n = F.col("base") + F.col("idx")
    return j.select("*", n.alias("n"), (n * 2).cast("string").alias("file_id"),
                    (n * 2 + 1).cast("string").alias("slack_id")).drop("base")
