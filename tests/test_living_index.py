"""Metadata fields and the living index: pushdown, batch and stream alike,
records landed again, merged generations, writers that collide."""

import datetime
import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from scrutin.operators import fields as M
from scrutin.operators import query as Q
from scrutin.operators import rank as R
from scrutin.plans import generations as G
from scrutin.plans.index import IndexNotFound, add_records, open_index, records_index_for
from scrutin.sources.records import described_records
from scrutin.sources.stoplist import stop_list
from scrutin.sources.tables import read_table
from scrutin.streaming.ingest import ingest_counters, process_batch, start_ingest


def _records(spark, below=60):
    return described_records(read_table(spark, SF_SMALL, "documents")).where(F.col("seq") < below)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_any_key_is_pushed_down_and_skips_files(spark, tmp_path):
    ctx = Q.Context(records_index_for(spark, SF_SMALL))
    plan = _plan(Q.FieldEquals("origin-lang", "de").scores(ctx, 1.0))
    assert "EqualTo(key,origin-lang)" in plan and "EqualTo(string,de)" in plan
    plan = _plan(Q.Range("count-words", 10, 20).scores(ctx, 1.0))
    assert "EqualTo(key,count-words)" in plan and "GreaterThanOrEqual(long,10)" in plan
    day = datetime.datetime(2011, 3, 20, tzinfo=datetime.UTC)
    assert "LessThanOrEqual(time,1300579200000000)" in _plan(Q.Range("acquired", None, day).scores(ctx, 1.0))
    assert "GreaterThanOrEqual(modified,1300579200)" in _plan(Q.Range("modified", day).scores(ctx, 1.0))
    # a value's rows stand in few of many files
    M.ordered(ctx.index.fields, files=12).write.parquet(f"{tmp_path}/fields")
    held = 0
    files = glob.glob(f"{tmp_path}/fields/*.parquet")
    for f in files:
        meta = pq.ParquetFile(f).metadata
        key = [c for c in range(meta.num_columns) if meta.schema.column(c).name == "key"][0]
        stats = [meta.row_group(g).column(key).statistics for g in range(meta.num_row_groups)]
        held += any(s.min <= "origin-lang" <= s.max for s in stats)
    assert len(files) >= 10 and held <= 3


@pytest.mark.parametrize("micros", [0, 1])
@pytest.mark.parametrize("closed", [True, False])
def test_date_bounds_on_core_times(spark, micros, closed):
    """Whole seconds against bounds that are whole or between two seconds."""
    ctx = Q.Context(records_index_for(spark, SF_SMALL))
    at = 1300086400 + 3600 * 7
    day = datetime.datetime.fromtimestamp(at, datetime.UTC) + datetime.timedelta(microseconds=micros)
    for lo, hi in ((day, None), (None, day)):
        got = {r["ID"] for r in Q.Range("modified", lo, hi, closed, closed).scores(ctx, 1.0).collect()}
        x = at + micros / 1e6
        keep = (lambda v: v > x or closed and v == x) if lo else (lambda v: v < x or closed and v == x)
        assert got == {r["ID"] for r in ctx.index.docs.select("ID", "modified").collect() if keep(r["modified"])}


def test_field_types(spark):
    js = {"a": [1.9, "x", {"b": None}], "t": "2020-01-02T03:04:05Z", "meta": {"mtime": 10, "size": 7}, "n": 2 ** 60 + 1,
          "flag": True, "name": {"name": "f"}, "ctime": "soon", "Ü ": ""}
    recs = spark.createDataFrame([("2", "3", 5, json.dumps(js)), ("4", "5", 0, "{"), ("6", "7", 0, None), ("8", "9", 0, "{}")],
                                 "file_id string, slack_id string, slack_size long, metadata string")
    got = {(r["ID"], r["key"]): (r["string"], r["long"], r["time"]) for r in M.metadata_fields(recs).collect()}
    t = M.micros(datetime.datetime(2020, 1, 2, 3, 4, 5))
    one = {"a-0": (None, 1, None), "a-1": ("x", None, None), "t": (js["t"], None, t), "n": (None, 2 ** 60 + 1, None),
           "modified": (None, 10, 10_000_000), "ctime": ("soon", None, None), "Ü ": ("", None, None)}
    want = {(i, k): v for i in "23" for k, v in one.items()}
    want |= {("2", "size"): (None, 7, None), ("3", "size"): (None, 5, None),
             ("2", "name"): ("f", None, None), ("3", "name"): ("f:slack", None, None)}
    assert got == want


def test_a_field_needs_an_index_of_records(spark):
    from scrutin.plans.index import index_for
    with pytest.raises(ValueError):
        R.search(Q.Context(index_for(spark, SF_SMALL)), Q.FieldEquals("origin-lang", "de"))


def test_no_index_at_a_path(spark, tmp_path):
    with pytest.raises(IndexNotFound):
        open_index(spark, f"{tmp_path}/nothing")


@pytest.fixture(scope="module")
def batch_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ix") / "batch")
    add_records(_records(spark), stop_list(spark), path)
    return open_index(spark, path)


def _same(a, b):
    assert a.corpus_row() == b.corpus_row() and _rows(a.corpus) == _rows(b.corpus)
    for name in ("docs", "postings", "doc_terms", "term_stats", "doc_stats", "fields"):
        x, y = getattr(a, name), getattr(b, name)
        assert _rows(x) == _rows(y.select(x.columns)), name


def test_many_micro_batches_leave_few_files(spark, tmp_path, batch_index, monkeypatch):
    """Ten micro-batches, each replayed, with merges of three generations: the
    same index as one batch, few generations, no aggregation on opening."""
    monkeypatch.setattr(G, "FANOUT", 3)
    path = f"{tmp_path}/ix"
    run, recs = process_batch(stop_list(spark), path), _records(spark).persist()
    for i in range(10):
        run(recs.where(F.col("seq") % 10 == i), i)
        if i in (0, 4):
            run(recs.where(F.col("seq") % 10 == i), i)
    manifest = G.latest(spark, path)
    levels = [g["level"] for g in manifest["generations"]]
    assert levels.count(0) < 3 and levels.count(1) < 3 and len(levels) <= 4
    # merged generations are gone but for those of the last merge
    assert len(glob.glob(f"{path}/gen/*")) <= len(levels) + 3
    for table in ("docs", "postings", "fields"):
        merged = [g for g in manifest["generations"] if g["level"] > 0]
        assert all(len(glob.glob(f"{G.folder(path, g, table)}/*.parquet")) == 1 for g in merged)
    ix = open_index(spark, path)
    plan = _plan(ix.term_stats.where("term = 'from'"))
    assert "EqualTo(term,from)" in plan  # the filter passes the sum over generations
    assert "Aggregate" not in _plan(ix.corpus)
    _same(ix, batch_index)
    counted = ingest_counters(spark, path).first()
    assert counted["files_read"] == recs.count()
    recs.unpersist()


def test_a_file_landed_twice_changes_nothing(spark, tmp_path, batch_index):
    """The same records in two files of a stream, again in one file, again in a
    further stream, and once with other content."""
    landing, recs = f"{tmp_path}/landing", _records(spark)
    half = F.col("seq") < 30
    recs.where(half).coalesce(1).write.mode("append").parquet(landing)
    recs.unionByName(recs.where(half)).coalesce(1).write.mode("append").parquet(landing)
    start_ingest(spark, landing, f"{tmp_path}/ix", f"{tmp_path}/c1", stop_list(spark)).awaitTermination()
    version = open_index(spark, f"{tmp_path}/ix").version
    start_ingest(spark, landing, f"{tmp_path}/ix", f"{tmp_path}/c2", stop_list(spark)).awaitTermination()
    process_batch(stop_list(spark), f"{tmp_path}/ix")(recs.withColumn("content", F.lit(b"other")), 0)
    ix = open_index(spark, f"{tmp_path}/ix")
    assert ix.version == version
    _same(ix, batch_index)


def test_one_of_two_writers_commits(spark, tmp_path, batch_index):
    """The second writer of a version is refused; what it wrote is not seen."""
    path = batch_index.path
    old = G.latest(spark, path)
    new = G.commit(spark, f"{tmp_path}/m", {**G.EMPTY})
    with pytest.raises(G.Conflict):
        G.commit(spark, f"{tmp_path}/m", {**G.EMPTY})
    assert G.latest(spark, f"{tmp_path}/m") == new
    # a manifest that is still being written is passed over
    with open(f"{tmp_path}/m/manifest/0000000002.json", "w") as f:
        f.write('{"version": 2, "gen')
    assert G.latest(spark, f"{tmp_path}/m") == new
    assert G.latest(spark, path) == old
