"""Living tables: an index as a manifest of immutable generations.

Every write (a batch build, an append, a micro-batch) makes one generation, a
folder with its own part of every table, and then commits a new version of the
manifest, a file created exclusively through the Hadoop file system. Readers
open the newest complete manifest, so they never see half a write; two writers
of one version cannot both commit. A generation starts at level 0; as soon as
``FANOUT`` generations of a level stand, they are merged into one of the next,
so ``n`` writes leave at most ``(FANOUT - 1) * log(n)`` generations and each
row is rewritten ``log(n)`` times. The manifest carries the corpus totals;
opening reads one small file.

Replaced generations are deleted one merge later, so a reader that opened the
version before can finish.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields as M

#: Generations of one level that are merged; bytes of a merged file, and of one
#: that a task sorts.
FANOUT, FILE_BYTES, SORTED_BYTES = 8, 128 << 20, 16 << 20
#: Compression of the tables: an index is several times as large as its texts.
CODEC = "zstd"
#: Tables of a merge that are written side by side.
MERGED_TOGETHER = 4
#: How the files of a merged table are dealt and sorted; others keep their rows together.
ORDER = {"postings": ("term", "ID"), "doc_terms": ("term", "ID"), "term_stats": ("term",), "keys": ("seq",),
         "grams": ("gram", "term"), "deletes": ("key", "term"), "fields": M.ORDER}
#: Tables that say the same in several generations.
SETS = ("grams", "deletes")
#: Totals that add up over generations.
TOTALS = ("num_docs", "num_tokens", "files_read", "bytes_read", "file_bytes_read")


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict | None:
    """A manifest, or None while it is still being written."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _name(path: str, version: int) -> str:
    return f"{path}/manifest/{version:010d}.json"


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest complete manifest of the tables at ``path``, if any."""
    for v in reversed(versions(spark, path)):
        found = _read(spark, _name(path, v))
        if found is not None:
            return found
    return None


def commit(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Write ``manifest`` as the version after its own."""
    new = {**manifest, "version": manifest["version"] + 1}
    fs, p = _fs(spark, _name(path, new["version"]))
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{path}: version {new['version']} was committed by another writer") from e
        raise
    out.write(bytearray((json.dumps(new) + "\n").encode()))
    out.close()
    return new


EMPTY = {"version": 0, "generations": [], "schemas": {}, "num_terms": 0, "replaced": [], **dict.fromkeys(TOTALS, 0)}


def folder(path: str, generation: dict | str, table: str) -> str:
    name = generation if isinstance(generation, str) else generation["name"]
    return f"{path}/gen/{name}/{table}"


def table(spark: SparkSession, path: str, manifest: dict, name: str) -> DataFrame | None:
    """The rows of a table over all generations that have it. The manifest
    knows the columns, so opening a table reads no file."""
    dirs = [folder(path, g, name) for g in manifest["generations"] if name in g["tables"]]
    return spark.read.schema(manifest["schemas"][name]).parquet(*dirs) if dirs else None


def dictionary(spark: SparkSession, path: str, manifest: dict) -> DataFrame | None:
    """(term, df, ttf) over all generations. A filter on terms reaches the
    files; only its rows are summed."""
    t = table(spark, path, manifest, "term_stats")
    if t is None or len(manifest["generations"]) == 1:
        return t
    return t.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.sum("ttf").cast("long").alias("ttf"))


def new_name() -> str:
    return uuid.uuid4().hex[:16]


def put(df: DataFrame, path: str, name: str, table_: str) -> DataFrame:
    """Write a table of generation ``name`` and read it back."""
    df.write.mode("overwrite").option("compression", CODEC).parquet(folder(path, name, table_))
    return df.sparkSession.read.schema(df.schema).parquet(folder(path, name, table_))


def add(spark: SparkSession, path: str, manifest: dict, name: str, tables: dict[str, DataFrame], totals: dict) -> dict:
    """Commit the written generation ``name``. The number of distinct terms
    grows by the terms that no older generation holds (``num_terms`` of the
    totals if there is none)."""
    old, fresh = table(spark, path, manifest, "term_stats"), totals["num_terms"]
    if old is not None:
        fresh = tables["term_stats"].select("term").join(old.select("term"), "term", "left_anti").count()
    gen = {"name": name, "level": 0, "tables": sorted(tables)}
    sums = {k: manifest[k] + int(totals.get(k, 0)) for k in TOTALS}
    schemas = {**manifest["schemas"], **{t: df._jdf.schema().toDDL() for t, df in tables.items()}}
    new = {**manifest, **sums, "num_terms": manifest["num_terms"] + fresh, "schemas": schemas,
           "generations": [*manifest["generations"], gen]}
    return compact(spark, path, commit(spark, path, new))


def compact(spark: SparkSession, path: str, manifest: dict, fanout: int | None = None) -> dict:
    """Merge levels that are full, the lowest first."""
    fanout = fanout or FANOUT
    while True:
        levels = {}
        for g in manifest["generations"]:
            levels.setdefault(g["level"], []).append(g)
        full = sorted(level for level, gens in levels.items() if len(gens) >= fanout)
        if not full:
            return manifest
        merged, gone = _merge(spark, path, levels[full[0]]), [g["name"] for g in levels[full[0]]]
        rest = [g for g in manifest["generations"] if g["name"] not in gone]
        last = manifest["replaced"]
        manifest = commit(spark, path, {**manifest, "generations": [*rest, merged], "replaced": gone})
        for name in last:  # replaced one merge ago
            fs, p = _fs(spark, f"{path}/gen/{name}")
            fs.delete(p, True)


def in_order(df: DataFrame, table_: str, files: int) -> DataFrame:
    """The rows of several generations as those of one, dealt to ``files`` and
    sorted. Equal keys lie in one range, so that sums and distinct rows are
    made where the rows were dealt to, without a shuffle of their own."""
    df = df.repartitionByRange(files, *ORDER[table_])
    if table_ == "term_stats":
        df = df.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
    if table_ in SETS:
        df = df.distinct()
    return df.sortWithinPartitions(*ORDER[table_])


def _merge(spark: SparkSession, path: str, gens: list[dict]) -> dict:
    name, tables = new_name(), sorted({t for g in gens for t in g["tables"]})

    def one(t: str) -> None:
        dirs = [folder(path, g, t) for g in gens if t in g["tables"]]
        size = 0
        for d in dirs:
            fs, p = _fs(spark, d)
            size += fs.getContentSummary(p).getLength()
        files = max(1, -(-size // (SORTED_BYTES if t in ORDER else FILE_BYTES)))
        df = spark.read.parquet(*dirs)
        df = in_order(df, t, int(files)) if t in ORDER else df.coalesce(int(files))  # no shuffle of bodies
        df.write.mode("overwrite").option("compression", CODEC).parquet(folder(path, name, t))

    with ThreadPoolExecutor(MERGED_TOGETHER) as pool:
        list(pool.map(one, tables))
    return {"name": name, "level": gens[0]["level"] + 1, "tables": tables}
