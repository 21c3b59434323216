"""A4/A5: build, extend and open the index — parquet tables derived from
``docs``, kept as generations (see :mod:`scrutin.plans.generations`).

Tables
- ``docs``        core document fields (body kept; search pages prune it)
- ``sentences``   (ID, s_idx, s_start, s_end, first_pos, sentence)
- ``postings``    (ID, term, pos, s_idx)     files sorted by (term, ID), so a
                                             term filter reads few row groups
- ``doc_terms``   (ID, term, tf, length)     sorted the same way; ``length``
                                             is the document's field length
- ``term_stats``  (term, df, ttf)
- ``grams``       (gram, term), ``deletes`` (key, term): the dictionary by
                                             parts (:mod:`scrutin.operators.patterns`)
- ``doc_stats``   (ID, length, sum_tf2, n_terms)
- ``fields``      (ID, key, string, long, time)  all metadata keys, when the
                                             index is built from records
- ``keys``        (seq, digest)              the records an index holds

Build cost: one shuffle of the text by (ID, chunk); sentences are written
from those partitions, and dealt once more by (ID, block) for their postings;
the postings' terms shuffle by ID (those of long documents by (ID, term)), where
term vectors and field lengths are counted; document and term statistics shuffle
by ID and by term after a map-side partial aggregation. Every sorting task gets a
bounded share of bytes, so that none of them spills however large the input is.
Tables are written under the shared ``spark.checkpoint.dir`` (or a caller's
path) and read back, which also cuts lineage.
"""

from __future__ import annotations

import hashlib
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import docs as D
from ..operators import fields as M
from ..operators import hits as H
from ..operators import patterns as P
from ..session import scratch_path, shuffles_dropped, tasks_for
from ..sources.stoplist import stop_list
from ..sources.tables import evidence_docs
from . import generations as G

#: Bytes of a dictionary whose parts one task sorts.
TASK_TERMS = 4 << 20


@dataclass
class Index:
    spark: SparkSession
    path: str
    docs: DataFrame
    postings: DataFrame
    doc_terms: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    corpus: DataFrame
    sentences: DataFrame
    grams: DataFrame
    deletes: DataFrame
    fields: DataFrame | None = None
    manifest: dict | None = None

    def corpus_row(self):
        """num_docs, num_terms, num_tokens as Python ints (from the manifest)."""
        return tuple(self.manifest[k] for k in ("num_docs", "num_terms", "num_tokens"))

    @property
    def id(self) -> str:
        """A5: index id = lower-case hex MD5 of its path."""
        return hashlib.md5(self.path.encode("utf-8")).hexdigest()

    @property
    def version(self) -> int:
        """Rises with every write."""
        return self.manifest["version"]


def _write_generation(docs: DataFrame, stops: DataFrame, path: str, name: str) -> tuple[dict, dict]:
    """Write the index tables of ``docs`` (a table that was written before)
    as generation ``name``; returns them and its totals. Term vectors are
    aggregated from the written postings, statistics from the written term vectors."""
    spark, done = docs.sparkSession, {"docs": docs}

    def put(df: DataFrame, table: str) -> DataFrame:
        done[table] = G.put(df, path, name, table)
        return done[table]

    # Sentences are dealt to tasks by their size (a file may hold more than a
    # task can sort); each file is sorted by term so row-group min/max
    # statistics prune a term lookup to a few row groups per file.
    sents = put(H.sentence_table(docs), "sentences")
    tokens = H.sentence_tokens(H.dealt_sentences(sents), stops)
    postings = put(tokens.sortWithinPartitions("term", "ID"), "postings")
    # the field length travels with every term-vector row, so ranking needs
    # no per-query join with the document table
    long_docs = docs.where(F.col("body_len") > A.CHUNK_CHARS)
    dterms = put(A.term_vectors(postings, long_docs).sortWithinPartitions("term", "ID"), "doc_terms")
    # postings without an ID have no vectors, but count
    vectors = dterms.select("ID", "term", "tf").unionByName(A.doc_terms(postings.where(F.col("ID").isNull())))

    # jobs that fill each other's gaps
    with ThreadPoolExecutor(3) as pool:
        by_document, num_docs = pool.submit(put, A.doc_stats(vectors), "doc_stats"), pool.submit(docs.count)
        tstats = put(A.term_stats(vectors).sortWithinPartitions("term"), "term_stats")
        # a term has many parts: few terms make a task
        terms = tstats.repartition(tasks_for(tstats, TASK_TERMS), "term")
        parts = [pool.submit(put, P.gram_table(terms).sortWithinPartitions("gram", "term"), "grams"),
                 pool.submit(put, P.delete_table(terms).sortWithinPartitions("key", "term"), "deletes")]
        sums = tstats.agg(F.coalesce(F.sum("ttf"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("terms")).first()
        for job in (by_document, *parts):
            job.result()
    return done, {"num_docs": num_docs.result(), "num_tokens": sums["tokens"], "num_terms": sums["terms"]}


def write_index(docs: DataFrame, stops: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the index of ``docs``. ``mode='append'`` adds the documents that a
    finished index does not hold yet (so a repeated append changes nothing) as
    a further generation: only they are tokenised. A write that fails leaves
    the last committed version as it was; of two writers of one version the
    second raises :class:`generations.Conflict`. A path without a finished
    index cannot be appended to."""
    spark = docs.sparkSession
    manifest, name = G.latest(spark, path), G.new_name()
    if mode == "append":
        if manifest is None or not _built(spark, path):
            raise RuntimeError(f"{path}: no finished index to append to")
        docs = docs.join(G.table(spark, path, manifest, "docs").select("ID").hint("shuffle_hash"), "ID", "left_anti")
    else:
        old = manifest or G.EMPTY
        manifest = {**G.EMPTY, "version": old["version"], "replaced": [g["name"] for g in old["generations"]]}
    # a file of texts may come as one piece, which one task reads: it only deals them
    dealt = docs.repartition(tasks_for(docs), "ID", "body_len")
    with shuffles_dropped(spark):
        docs = G.put(dealt, path, name, "docs")
        if mode == "append" and docs.isEmpty():
            return
        G.add(spark, path, manifest, name, *_write_generation(docs, stops, path, name))
    _touch(spark, f"{path}/_BUILT")


def add_records(records: DataFrame, stops: DataFrame, path: str, classifier=None) -> dict:
    """The record → index job of batch and stream: (seq, metadata, content)
    records that the index at ``path`` does not hold yet become documents,
    metadata fields, postings, term vectors and statistics of one further
    generation; the index is made if there is none. A record is known by its
    ``seq``: landed again, in the same or in another write, it changes nothing
    (also with other content: the first one stays). Only stored records are
    counted (B16). Returns the manifest.

    ``classifier`` (:func:`scrutin.operators.filetype.classes`) gives
    unallocated records their extension.
    """
    with shuffles_dropped(records.sparkSession):
        return _add_records(records, stops, path, classifier)


def _add_records(records: DataFrame, stops: DataFrame, path: str, classifier) -> dict:
    spark = records.sparkSession
    manifest = G.latest(spark, path) or dict(G.EMPTY)
    name = G.new_name()

    def put(df: DataFrame, table: str) -> DataFrame:
        return G.put(df, path, name, table)

    digest = F.xxhash64("metadata", "content")
    landed = records.select("seq", digest.alias("digest")).groupBy("seq").agg(
        F.min("digest").alias("digest"), F.count(F.lit(1)).alias("times"))
    known = G.table(spark, path, manifest, "keys")
    if known is not None:
        # files of keys are sorted: only those of the landed range are read
        span = records.agg(F.min("seq"), F.max("seq")).first()
        if span[0] is not None:
            known = known.where(F.col("seq").between(span[0], span[1]))
        landed = landed.join(known.select("seq"), "seq", "left_anti")
    landed = put(landed.sortWithinPartitions("seq"), "keys")
    got = landed.agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times")).first()
    if not got["n"]:
        _remove(spark, f"{path}/gen/{name}")
        return manifest
    hashed = records.withColumn("digest", digest)
    first = known is None and got["times"] == 1  # each one landed once, and none before

    def new(rows: DataFrame) -> DataFrame:
        """Those of the landed rows that are stored, each number once."""
        if first:
            return rows.where(F.col("seq").isNotNull())
        # keys are hashed, contents are not sorted
        rows = rows.join(landed.select("seq", "digest").hint("shuffle_hash"), ["seq", "digest"], "left_semi")
        return rows.dropDuplicates(["seq"]) if got["times"] > 1 else rows

    fresh = new(hashed)
    if first:  # a landed file may come as one piece, which one task reads: it only deals the records
        fresh = fresh.repartition(tasks_for(records), "seq")
    # B16 counters observed while the documents are written (no extra pass)
    from pyspark.sql import Observation
    obs = Observation()
    observed = fresh.observe(
        obs, F.count(F.lit(1)).alias("files_read"),
        F.sum(F.lit(16) + F.octet_length("metadata") + F.octet_length("content")).alias("bytes_read"),
        F.sum(F.octet_length("content")).alias("file_bytes_read"))
    stop_terms = [r["term"] for r in stops.collect()]  # configuration-sized
    made = D.records_to_docs(observed, stop_terms, classifier=classifier).drop("priority")
    docs = put(made, "docs")
    counters = obs.get
    # fields need the length of a content only: no content is joined for them
    parsed = new(D.parse_metadata(D.with_ids(hashed)).drop("content")).drop("digest")
    def put_fields():
        return put(M.ordered(M.metadata_fields(parsed).join(docs.select("ID"), "ID", "left_semi")), "fields")

    # the fields' jobs fill the gaps of the index's
    with ThreadPoolExecutor(1) as pool:
        fields = pool.submit(put_fields)
        tables, totals = _write_generation(docs, stops, path, name)
        fields = fields.result()
    manifest = G.add(spark, path, manifest, name, {**tables, "fields": fields, "keys": landed},
                     {**totals, **{k: counters.get(k) or 0 for k in counters}})
    _touch(spark, f"{path}/_BUILT")
    return manifest


class IndexNotFound(LookupError):
    """There is no finished index at a path."""


def open_index(spark: SparkSession, path: str) -> Index:
    """A5: the newest version of the index at ``path``. Opening reads the
    manifest; nothing is aggregated."""
    manifest = G.latest(spark, path)
    if manifest is None or not manifest["generations"]:
        raise IndexNotFound(path)
    t = {n: G.table(spark, path, manifest, n) for n in (
        "docs", "sentences", "postings", "doc_terms", "doc_stats", "grams", "deletes", "fields")}
    corpus = spark.read.schema("num_docs long, num_terms long, num_tokens long").json(
        G._name(path, manifest["version"]))
    return Index(spark, path, t["docs"], t["postings"], t["doc_terms"], G.dictionary(spark, path, manifest),
                 t["doc_stats"], corpus, t["sentences"], t["grams"], t["deletes"], t["fields"], manifest)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """A5: one row on the index at a path: (Id, NumDocs, Version, Error). The
    id is that of the path; without a finished index there, Error says so and
    the numbers are null."""
    manifest = G.latest(spark, path)
    found = manifest is not None and bool(manifest["generations"])
    number = lambda k: F.lit(manifest[k] if found else None).cast("long")
    return spark.range(1).select(F.md5(F.lit(path).cast("binary")).alias("Id"), number("num_docs").alias("NumDocs"),
                                 number("version").alias("Version"),
                                 F.lit(None if found else "no finished index").cast("string").alias("Error"))


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _touch(spark: SparkSession, path: str) -> None:
    """Marker file through the Hadoop file system of the path (local, HDFS, S3)."""
    fs, p = _fs_path(spark, path)
    fs.create(p, True).close()


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _files_key(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: another key as soon as
    the table is replaced."""
    fs, p = _fs_path(spark, path)
    files = fs.listStatus(p)
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def _built(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path + "/_BUILT")
    return bool(fs.exists(p))


_BUILD_LOCK = threading.RLock()


def _build(spark: SparkSession, path: str, rebuild: bool, write) -> Index:
    """The index at ``path``, written first if it is not there. Threads of a
    process take turns; of several processes one commits, and the others take
    its version."""
    with _BUILD_LOCK:
        if rebuild or not _built(spark, path):
            try:
                write()
            except G.Conflict:
                if not _built(spark, path):
                    raise
    return open_index(spark, path)


def records_index_for(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the described records of ``sf_dir``, built by the record
    job into the shared folder and reused."""
    from .. import CODE_VERSION as __version__
    from ..sources.records import described_records
    from ..sources.tables import read_table
    files = _files_key(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    key = hashlib.md5(f"records|{sf_dir}|{__version__}|{files}".encode()).hexdigest()[:16]
    path = scratch_path(spark, "index", key)
    recs = described_records(read_table(spark, sf_dir, "documents"))
    return _build(spark, path, False, lambda: add_records(recs, stop_list(spark), path))


def index_for(spark: SparkSession, sf_dir: str, with_slack: bool = False,
              rebuild: bool = False) -> Index:
    """The index of the evidence view of ``sf_dir`` with the default stop
    list, built once into the shared folder and reused."""
    from .. import CODE_VERSION as __version__
    files = _files_key(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    key = hashlib.md5(f"{sf_dir}|{with_slack}|{__version__}|{files}".encode()).hexdigest()[:16]
    path = scratch_path(spark, "index", key)
    return _build(spark, path, rebuild,
                  lambda: write_index(evidence_docs(spark, sf_dir, with_slack), stop_list(spark), path))
