"""File typing: vectors, held-out accuracy, saved models, the record job."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from scrutin.functions import constants as K
from scrutin.operators import docs as D
from scrutin.operators import filetype as T
from scrutin.sources.tables import read_table


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_SMALL, "documents").where("lang is not null").select(
        F.col("doc_id").cast("string").alias("ID"), F.encode("text", "UTF-8").alias("content"), F.col("lang").alias("label"))


@pytest.fixture(scope="module")
def model(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "model")
    T.save_classifier(T.train_classifier(docs.where(F.crc32("ID") % 5 != 0)), path)
    return T.load_classifier(path)


def test_vectors_hold_the_counts(spark):
    rows = [("a", bytearray(b"abab")), ("b", bytearray(b"")), ("c", None), ("d", bytearray(b"\xff"))]
    df = spark.createDataFrame(rows, "ID string, content binary")
    got = {r["ID"]: dict(zip(r["features"].indices.tolist(), r["features"].values.tolist()))
           for r in T.byte_vectors(df).collect()}
    counts = {}
    for r in T.byte_ngram_counts(df).collect():
        counts.setdefault(r["ID"], {})[r["feature"]] = pytest.approx(np.log1p(r["count"]))
    assert got == {**{i: {} for i in "bc"}, **counts}


def test_held_out_accuracy_and_row_by_row_model(spark, docs, model):
    held = docs.where(F.crc32("ID") % 5 == 0)
    got = {r["ID"]: r["predicted"] for r in T.predict(model, held).collect()}
    truth = {r["ID"]: r["label"] for r in held.select("ID", "label").collect()}
    assert got.keys() == truth.keys() and sum(got[i] == truth[i] for i in truth) >= 0.9 * len(truth)
    # the library's own transform gives the same classes
    labels = model.stages[0].labels
    own = {r["ID"]: labels[int(r["prediction"])] for r in model.stages[1].transform(T.byte_vectors(held)).collect()}
    assert own == got


def test_empty_content_is_unknown(spark, model):
    df = spark.createDataFrame([("a", bytearray(b"")), ("b", None)], "ID string, content binary")
    assert [(r["class"], r["predicted"]) for r in T.predict(model, df).collect()] == [(0, None)] * 2


def test_record_job_types_unallocated_records(spark, model):
    """Only unallocated files take the extension of their class; slack and
    allocated files do not, and an empty one has none."""
    text = read_table(spark, SF_SMALL, "documents").where("lang = 'en'").first()["text"].encode()
    meta = lambda path, size: json.dumps({"path": path, "name": {"name": "x.dat"}, "meta": {"size": size}})
    rows = [(0, meta("home/", len(text)), bytearray(text)), (1, meta("$Unallocated/", len(text) - 5), bytearray(text)),
            (2, meta("$Unallocated/", 0), bytearray(b""))]
    recs = spark.createDataFrame(rows, "seq long, metadata string, content binary")
    got = {r["ID"]: r["extension"] for r in D.records_to_docs(recs, [], classifier=T.classes(model)).collect()}
    number = {r["ID"]: r["class"] for r in T.predict(model, recs.select(F.lit("1").alias("ID"), "content").limit(1)).collect()}["1"]
    assert got["0"] == "dat" and got["2"] == K.FILE_TYPE_CLASSES[number] and got["3"] == "" and "4" not in got
    plain = {r["ID"]: r["extension"] for r in D.records_to_docs(recs, []).collect()}
    assert plain == {"0": "dat", "2": "dat", "3": ""}


def test_batch_and_stream_type_alike(spark, model, tmp_path):
    from scrutin.catalog import _records
    from scrutin.plans.index import add_records, open_index
    from scrutin.sources.stoplist import stop_list
    from scrutin.streaming.ingest import process_batch
    recs, stops = _records(spark, SF_SMALL).where("seq < 40"), stop_list(spark)
    add_records(recs, stops, f"{tmp_path}/batch", T.classes(model))
    run = process_batch(stops, f"{tmp_path}/stream", T.classes(model))
    for i in (0, 1):
        run(recs.where(F.col("seq") % 2 == i), i)
    rows = [sorted((r["ID"], r["extension"]) for r in open_index(spark, f"{tmp_path}/{n}").docs.collect()) for n in ("batch", "stream")]
    assert rows[0] == rows[1]
    # unallocated files were typed, whatever their names say
    named = {r["ID"]: r["extension"] for r in D.records_to_docs(recs, []).where("is_unallocated and not is_slack").collect()}
    typed = dict(rows[0])
    assert any(typed[i] != e for i, e in named.items() if i in typed)
