"""Hand-worked cases (FIXTURES.md section 2)."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def _records(spark, rows):
    return spark.createDataFrame(rows, "seq long, metadata string, content binary")


META = {"path": "docs/", "name": {"name": "a.TXT"},
        "meta": {"size": 5, "mtime": 1300000000, "crtime": 1299990000, "atime": 1300000500}}


def test_record_sizes_slack_and_ids(spark):
    from scrutin.operators import docs as D
    from scrutin.operators.docs import records_to_docs
    m2 = dict(META, meta=dict(META["meta"], size=20))
    recs = _records(spark, [(0, json.dumps(META), bytearray(b"abcdefgh")),
                            (1, json.dumps(m2), bytearray(b"abcdefgh"))])
    p = {r["seq"]: r for r in D.parse_metadata(recs).collect()}
    assert (p[0]["file_size"], p[0]["slack_size"]) == (5, 3)
    assert (p[1]["file_size"], p[1]["slack_size"]) == (8, 0)
    docs = {r["ID"]: r for r in records_to_docs(recs, []).collect()}
    assert set(docs) == {"0", "1", "2"}
    assert (docs["0"]["name"], docs["0"]["size"], docs["0"]["extension"]) == ("a.TXT", 5, "txt")
    assert (docs["1"]["name"], docs["1"]["size"], docs["1"]["extension"]) == ("a.TXT:slack", 3, "")
    assert docs["1"]["body"] == "fgh"


@pytest.mark.parametrize("name,ext", [(".bashrc", "bashrc"), ("a.", ""), ("a", ""), ("a.tar.GZ", "gz")])
def test_extension(spark, name, ext):
    from scrutin.functions.text import extension_of
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(extension_of(F.col("name"))).first()[0] == ext


def test_flatten(spark):
    from scrutin.operators.docs import flatten_json
    df = spark.createDataFrame([(1, '{"a":{"b":1.9},"l":[{"x":"p"},"q"],"t":true,"n":null}')], "id int, j string")
    got = {(r["key"], r["value"]) for r in flatten_json(df, "id", "j").collect()}
    assert got == {("a-b", "1"), ("l-0-x", "p"), ("l-1", "q")}


@pytest.mark.parametrize("raw,text", [(b"A\x00B\x00", "AB"), (b"\xff\xfeA", "  A"), (b"a\nb\tc", "abc")])
def test_raw_text(spark, raw, text):
    from scrutin.operators.docs import scrape_text
    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    assert df.select(scrape_text(F.col("c"))).first()[0] == text


def test_hit_boundaries(spark):
    from scrutin.operators.hits import boundaries
    rows = [("d", 0, ["a"], 10, 10), ("d", 1, ["a"], 40, 40), ("d", 2, ["b"], 70, 70),
            ("d", 3, ["a", "b"], 100, 120), ("d", 4, ["a"], 160, 160)]
    p = spark.createDataFrame(rows, "ID string, s_idx int, terms array<string>, first_match int, last_match int")
    out = boundaries(p.withColumn("body_len", F.lit(200)), F.col("body_len")).orderBy("s_idx").collect()
    assert [r["distance"] for r in out] == [60, 30, 30, 30, 40]
    assert [r["next_first"] for r in out] == [70, 70, 100, 160, None]
    assert [r["prev_last"] for r in out] == [None, None, 40, 70, 120]


def test_query_term_weight(spark):
    from scrutin.operators.hits import term_weight
    df = spark.createDataFrame([(3, 2), (1, 1)], "ttf long, df long")
    got = [round(r[0], 6) for r in df.select(term_weight(F.col("ttf"), F.col("df"), 20, 4)).collect()]
    assert got == [0.545767, 2.076483]


def test_date_difference(spark):
    from scrutin.operators.hits import date_difference
    df = spark.createDataFrame([(1300000000,), (1300086400,), (1299913600,)], "t long")
    got = [round(r[0], 9) for r in df.select(date_difference(F.col("t"), 1400000000000)).collect()]
    assert got == [0.071428571, 0.071366857, 0.071490286]


def test_normalise(spark):
    from scrutin.operators.hits import normalize
    h = spark.createDataFrame([(False, -1.0), (False, 0.0), (False, 3.0), (True, 7.0)],
                              "is_unallocated boolean, raw_score double")
    got = sorted((r["is_unallocated"], r["raw_score"], r["score"]) for r in normalize(h).collect())
    assert got == [(False, -1.0, 0.0), (False, 0.0, 2.5), (False, 3.0, 10.0), (True, 7.0, 0.0)]


W4 = np.array([[.9, .1, .2], [.1, .8, .3], [.2, .2, .9], [.5, .5, .5]])


def test_som_distances_and_winners(spark):
    from scrutin.operators import som as S
    cfg = S.SomConfig(width=2, height=2)
    vec = spark.createDataFrame([("0", [0]), ("2", [1, 2]), ("4", [0, 1, 2]), ("6", [])],
                                "ID string, features array<int>")
    b = spark.sparkContext.broadcast(W4)
    d = {(r["ID"], r["cell"]): round(r["distance"], 2) for r in S.cell_distances(vec, b, cfg).collect()}
    assert [d[("0", c)] for c in range(4)] == [0.06, 1.54, 1.49, 0.75]
    assert [d[("2", c)] for c in range(4)] == [2.26, 0.54, 0.69, 0.75]
    assert [d[("4", c)] for c in range(4)] == [1.46, 1.34, 1.29, 0.75]
    a = {r["ID"]: r["cell"] for r in S.assign_cells(vec, b, cfg).collect()}
    assert a == {"0": "0", "2": "1", "4": "3", "6": "-1"}


def _epoch(spark, radius):
    from scrutin.operators import som as S
    cfg = S.SomConfig(width=2, height=2)
    vec = spark.createDataFrame([("0", [0]), ("2", [1, 2]), ("4", [0, 1, 2]), ("6", [])],
                                "ID string, features array<int>")
    counts = S.winner_counts(vec, spark.sparkContext.broadcast(W4), 3)
    return cfg, counts


def test_som_epoch_batch_update(spark):
    from scrutin.operators import som as S
    cfg, counts = _epoch(spark, 1)
    new = S.epoch_update(W4, counts.toArrow(), cfg, 0.1, 1)
    expect = [[.836767, .253567, .326467], [.253567, .763867, .399367],
              [.326467, .326467, .836767], [.545167, .545167, .545167]]
    assert np.allclose(np.round(new, 6), expect)
    new0 = S.epoch_update(W4, counts.toArrow(), cfg, 0.1, 0)
    assert np.allclose(np.round(new0[0], 6), [.91, .09, .18])
    assert np.allclose(new0[2], W4[2])
    # the DataFrame form gives the same weights
    w = S.matrix_frame(spark, W4)
    df_new = S.update_weights(w, S.neighbourhood_sums(counts, cfg, 1), 0.1)
    got = {r["cell"]: r["w"] for r in df_new.collect()}
    assert np.allclose(np.round([got[c] for c in range(4)], 6), expect)


def test_cell_stats(spark):
    from scrutin.operators import som as S
    cfg = S.SomConfig(width=2, height=1)
    a = spark.createDataFrame([("a", "0", 1.0), ("b", "0", 2.0), ("c", "1", 1.0), ("d", "1", 2.0), ("e", "1", 3.0)],
                              "ID string, cell string, som_cell_distance double")
    st = {r["cell"]: r for r in S.cell_stats(a, cfg).collect()}
    assert (st[0]["num"], st[0]["ssd"]) == (2, 5.0) and math.isclose(st[0]["std_dev"], math.sqrt(5))
    assert (st[1]["num"], st[1]["ssd"]) == (3, 14.0) and math.isclose(st[1]["std_dev"], math.sqrt(7))


def test_bookmark_export_rows(spark):
    from scrutin.operators import bookmarks as B
    marks = spark.createDataFrame([("x", "B1", 1, "0"), ("x", "B1", 1, "2"), ("y", "B2", 2, "2"), ("z", "B1", 1, "9")],
                                  "Bookmark string, Comment string, Created long, ID string")
    res = spark.createDataFrame([("0",), ("2",), ("4",)], "ID string")
    got = sorted((r["ID"], r["bookmark_comment"], r["bookmark_created"]) for r in B.with_bookmarks(res, marks).collect())
    assert got == [("0", "B1", 1), ("2", "B1", 1), ("2", "B2", 2), ("4", "", 0)]
    flags = {r["ID"]: r["bookmarked"] for r in B.bookmarked_flag(res, marks).collect()}
    assert flags == {"0": True, "2": True, "4": False}
    over = {(r["Comment"], r["ID"]) for r in B.bookmarks_for_docs(marks, spark.createDataFrame([("0",)], "ID string")).collect()}
    assert over == {("B1", "0"), ("B1", "2")}


def test_create_bookmark_roundtrip(spark, tmp_path):
    from scrutin.operators import bookmarks as B
    path = str(tmp_path / "marks")
    B.create_bookmark(spark, path, "0 2  4", "hello world", created_ms=5)
    got = sorted(r["ID"] for r in B.read_bookmarks(spark, path).collect())
    assert got == ["0", "2", "4"]


def test_stop_list_defaults_and_files(spark, tmp_path):
    from scrutin.sources.stoplist import stop_list
    assert stop_list(spark).count() == 33 + 68 - 1  # "a" is both a word and a character
    lf = tmp_path / "lf.txt"
    lf.write_bytes(b"The\nZebra\n")
    crlf = tmp_path / "crlf.txt"
    crlf.write_bytes(b"the\r\nquokka\r\n")
    got_lf = {r["term"] for r in stop_list(spark, str(lf)).collect()}
    got_crlf = {r["term"] for r in stop_list(spark, str(crlf)).collect()}
    assert {"the", "zebra"} <= got_lf and {"the", "quokka"} <= got_crlf
    assert not any("\r" in t for t in got_crlf)


def test_norm_quantization(spark):
    from scrutin.operators.rank import length_norm
    df = spark.createDataFrame([(1,), (2,), (3,), (100,)], "n long")
    got = [r[0] for r in df.select(length_norm(F.col("n"), quantized=True)).collect()]
    # largest 2^e·{1, 1.25, 1.5, 1.75} not above 1/sqrt(n)
    assert got == [1.0, 0.625, 0.5, 0.09375]


def test_hit_boundaries_across_chunks(spark):
    """The same five passages spread over chunks give the same boundaries."""
    from scrutin.operators.hits import boundaries
    rows = [("d", 0, ["a"], 10, 10), ("d", 1, ["a"], 40, 40), ("d", 2, ["b"], 70, 70),
            ("d", 3, ["a", "b"], 100, 120), ("d", 4, ["a"], 160, 160)]
    p = spark.createDataFrame(rows, "ID string, s_idx int, terms array<string>, first_match int, last_match int")
    for split in ([0, 0, 1, 1, 2], [0, 1, 2, 3, 4], [0, 2, 2, 5, 5]):
        c = spark.createDataFrame(list(enumerate(split)), "s_idx int, chunk int")
        out = boundaries(p.join(c, "s_idx").withColumn("body_len", F.lit(200)), F.col("body_len")) \
            .orderBy("s_idx").collect()
        assert [r["distance"] for r in out] == [60, 30, 30, 30, 40]
        assert [r["next_first"] for r in out] == [70, 70, 100, 160, None]
        assert [r["prev_last"] for r in out] == [None, None, 40, 70, 120]


def test_hit_boundaries_across_chunk_groups(spark, monkeypatch):
    """Chunk summaries are scanned in groups; tiny groups force every carry
    and every chunk-edge neighbour to cross a group."""
    from scrutin.operators import analysis as A
    from scrutin.operators.hits import boundaries
    monkeypatch.setattr(A, "CHUNK_GROUP", 2)
    rows = [("d", 0, ["a"], 10, 10), ("d", 1, ["a"], 40, 40), ("d", 2, ["b"], 70, 70),
            ("d", 3, ["a", "b"], 100, 120), ("d", 4, ["a"], 160, 160)]
    p = spark.createDataFrame(rows, "ID string, s_idx int, terms array<string>, first_match int, last_match int")
    for split in ([0, 1, 2, 3, 4], [0, 3, 3, 7, 9], [1, 1, 2, 5, 8]):
        c = spark.createDataFrame(list(enumerate(split)), "s_idx int, chunk int")
        out = boundaries(p.join(c, "s_idx").withColumn("body_len", F.lit(200)),
                         F.col("body_len")).orderBy("s_idx").collect()
        assert [r["distance"] for r in out] == [60, 30, 30, 30, 40]
        assert [r["next_first"] for r in out] == [70, 70, 100, 160, None]
        assert [r["prev_last"] for r in out] == [None, None, 40, 70, 120]


def test_csv_export_round_trip(spark, tmp_path):
    """Standard CSV with a header; quotes, commas and newlines in
    text survive one round trip (no double escaping)."""
    from scrutin.operators import export as X
    rows = spark.createDataFrame([("1", 'say "hi", then\nleave', 3)], "ID string, Snippet string, Size long")
    X.write_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .csv(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in back] == [("1", 'say "hi", then\nleave', "3")]
