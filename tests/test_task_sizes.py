"""Steps whose tasks get a bounded share of the input, whatever its size."""

import pytest

from scrutin import session
from scrutin.operators import analysis as A
from scrutin.operators import hits as H

SF_SMALL = "/root/testdata/sf0.001"


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_dealt_by_their_size(spark, monkeypatch, tmp_path):
    """A file of sentences may hold more than a task can sort."""
    docs = spark.createDataFrame([(str(i), f"word{i} and text. " * 300) for i in range(50)], "ID string, body string")
    H.sentence_table(docs).coalesce(1).write.parquet(str(tmp_path / "s"))
    sents = spark.read.parquet(str(tmp_path / "s"))
    monkeypatch.setattr(session, "TASK_BYTES", 2_000)
    n = session.tasks_for(sents)
    assert n > session.default_parallelism(spark)
    dealt = H.dealt_sentences(sents)
    assert dealt.rdd.getNumPartitions() == n
    assert _rows(dealt, "ID", "s_idx", "sentence") == _rows(sents, "ID", "s_idx", "sentence")


def test_term_vectors_of_short_and_long_documents(spark):
    toks = spark.createDataFrame(
        [("1", "a", 0), ("1", "b", 1), ("1", "a", 2), ("2", "a", 0), ("2", "c", 1), (None, "a", 0)], "ID string, term string, pos int")
    long_docs = spark.createDataFrame([("2",), ("2",), (None,)], "ID string")
    got = A.term_vectors(toks, long_docs)
    assert got.columns == ["ID", "term", "tf", "length"]
    assert _rows(got, "ID", "term", "tf", "length") == [("1", "a", 2, 3), ("1", "b", 1, 3), ("2", "a", 1, 2), ("2", "c", 1, 2)]
    assert _rows(A.term_vectors(toks, long_docs.limit(0)), "ID", "term", "tf", "length") == _rows(got, "ID", "term", "tf", "length")


def test_hit_sentences_are_not_exploded(spark):
    """pieces of a sentence are no rows, and no window is made of them."""
    hits = spark.createDataFrame([("1", 0, ["cat", "x<y", "dog"], 2.0, 3)], "ID string, s_idx int, terms array<string>, max_hit_tfidf double, max_hit_len int")
    sents = spark.createDataFrame([("1", 0, 10, 30, 0, "A <Cat> & dog, cats, CAT.")], "ID string, s_idx int, s_start long, s_end long, first_pos int, sentence string")
    p = H.passages(hits, sents)
    assert "Generate" not in _plan(p) and "Window" not in _plan(p)
    r = p.first()
    mark = lambda w: f"{H.K.HIGHLIGHT_OPEN}{w}{H.K.HIGHLIGHT_CLOSE}"
    assert (r["first_match"], r["last_match"]) == (13, 31)
    assert r["snippet"] == f"A &lt;{mark('Cat')}&gt; &amp; {mark('dog')}, cats, {mark('CAT')}."
    assert [t for _, t in p.dtypes] == ["string", "int", "bigint", "bigint", "array<string>", "double", "int", "bigint", "bigint", "string"]
    places = p.sparkSession.range(1).select(H.matched_places(
        H.F.array(H.F.lit("a"), H.F.lit("bc"), H.F.lit("d")), H.F.array(H.F.lit(True), H.F.lit(False), H.F.lit(True))).alias("m")).first()
    assert [tuple(x) for x in places["m"]] == [(0, 1), (3, 4)]


def test_features_of_few_rows_are_held_together():
    """F10, F18."""
    import pyarrow as pa
    from scrutin.operators import filetype as T
    b = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    parts = list(T.in_slices([b]))
    assert max(p.num_rows for p in parts) <= T.SLICE_ROWS
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))


def test_described_records_join_only_shared_numbers(spark):
    """contents of documents with numbers of their own are not joined."""
    from scrutin.sources.records import described_records
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = spark.createDataFrame([(1, "one", "en", "s1", 3), (2, None, None, "s2", None), (None, "x", "en", "s1", 1)], schema)
    assert "Join" not in _plan(described_records(one))
    got = {r["seq"]: r["metadata"] for r in described_records(one).collect()}
    assert set(got) == {1, 2} and '"origin":{"lang":"en","corpus":"s1"}' in got[1]
    both = one.unionByName(spark.createDataFrame([(1, "other", "de", "s3", 5)], schema))
    rows = described_records(both).collect()
    assert sorted(r["seq"] for r in rows) == [1, 1, 1, 1, 2]
    assert got[2] in [r["metadata"] for r in rows] and got[1] in [r["metadata"] for r in rows]


@pytest.mark.parametrize("times", [1, 2])
def test_records_of_a_first_write_are_stored_once(spark, tmp_path, times):
    from scrutin.plans.index import add_records, open_index
    from scrutin.sources.stoplist import stop_list
    recs = spark.createDataFrame([(i, f'{{"path": "p/", "name": {{"name": "f{i}"}}}}', b"some plain words") for i in range(3)],
                                 "seq long, metadata string, content binary")
    landed = recs if times == 1 else recs.unionByName(recs)
    landed = landed.unionByName(spark.createDataFrame([(None, "{}", b"nothing")], recs.schema))
    add_records(landed, stop_list(spark), str(tmp_path / "ix"))
    assert sorted(r["ID"] for r in open_index(spark, str(tmp_path / "ix")).docs.select("ID").collect()) == ["0", "2", "4"]


def test_merged_tables_that_are_sorted_have_small_files(spark, tmp_path, monkeypatch):
    """a task of a merge sorts a bounded share."""
    from scrutin.plans import generations as G
    path = str(tmp_path / "t")
    for name in "ab":
        rows = [(str(i), f"t{i}", i, 0) for i in range(500)]
        G.put(spark.createDataFrame(rows, "ID string, term string, pos int, s_idx int"), path, name, "postings")
    monkeypatch.setattr(G, "SORTED_BYTES", 4_000)
    g = G._merge(spark, path, [{"name": n, "level": 0, "tables": ["postings"]} for n in "ab"])
    got = spark.read.parquet(G.folder(path, g, "postings"))
    assert got.count() == 1000 and len(got.inputFiles()) > 1


def test_texts_are_translated_where_they_were_dealt_to(spark):
    """F8: a file of one row group is read by one task, which leaves the work to the others."""
    from scrutin.catalog import q_c1_mixed_scripts
    lines = _plan(q_c1_mixed_scripts(spark, SF_SMALL)).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    dealt = [i for i, x in enumerate(lines) if "RepartitionByExpression" in x]
    assert dealt and any("translate(" in x for x in lines)
    for i in dealt:
        end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
        assert not any("translate(" in x for x in lines[i:end])


def test_ascii_texts_take_the_short_pattern(spark):
    """The same tokens and pieces, without a look at other scripts."""
    from scrutin.functions import text as T
    from pyspark.sql import functions as F
    texts = ["", " ", "one", " .a. b.c 1.5, don't 'x' y_z. ", "..x..", "naïve Ünï é 书中 x.书 カタ ไทย’a b’c", "KKelvin İx",
             "\n\n", "a.", "'", None, "x" * 300 + " y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select("t", T.tokens_of(t).alias("toks"), F.regexp_extract_all(F.lower(t), F.lit(T.TOKEN_RE), 0).alias("want"),
                     T.pieces_of(t).alias("pieces"), F.regexp_extract_all(t, F.lit(T.TOKEN_OR_GAP_RE), 0).alias("split")).collect()
    for r in rows:
        assert r["toks"] == r["want"] and r["pieces"] == r["split"]
    plan = _plan(df.select(T.tokens_of(t).alias("x")))
    assert T.ASCII_TOKEN_RE in plan


def test_the_documents_of_one_file_are_dealt_before_they_are_indexed(spark, tmp_path):
    """F3, F4, F6, F15, F16."""
    from scrutin.plans.index import open_index, write_index
    from scrutin.sources.stoplist import stop_list
    from scrutin.sources.tables import evidence_view
    rows = [(i, f"plain words of text {i}", "en", "s", 20) for i in range(40)] + [(None, "none", None, None, None)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        str(tmp_path / "documents"))
    docs = evidence_view(spark.read.parquet(str(tmp_path / "documents")))
    write_index(docs, stop_list(spark), str(tmp_path / "ix"))
    got = open_index(spark, str(tmp_path / "ix")).docs
    assert len(got.inputFiles()) > 1
    assert _rows(got, "ID", "body", "created") == _rows(docs, "ID", "body", "created")


def test_a_merge_shuffles_a_table_once(spark):
    """r04 F2: sums and distinct rows are made where the rows were dealt to."""
    from scrutin.plans import generations as G
    stats = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("a", 3, 4), (None, 1, 1), (None, 1, 2)], "term string, df long, ttf long")
    grams = spark.createDataFrame([("ab", "abc"), ("bc", "abc"), ("ab", "abc"), (None, None), (None, None)], "gram string, term string")
    for df, name, want in ((stats, "term_stats", {("a", 4, 6), ("b", 1, 1), (None, 2, 3)}),
                           (grams, "grams", {("ab", "abc"), ("bc", "abc"), (None, None)})):
        got = G.in_order(df, name, 3)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_the_mask_is_looked_for_once_a_chunk(spark):
    """r04 F2, F3: no sentence carries the text of its chunk."""
    from scrutin.functions.text import DOT_MASK
    rows = [("1", "One a.b c. Two! Three"), ("2", f"x{DOT_MASK}y. 1.5 z"), ("3", ""), ("4", None), ("5", "m. " * 50 + f"{DOT_MASK} a.b. n")]
    docs = spark.createDataFrame(rows, "ID string, body string")
    got = H.sentence_table(docs, 40)
    for i, body in rows:
        mine = sorted((r["s_start"], r["s_end"], r["sentence"]) for r in got.where(H.F.col("ID") == i).collect())
        assert "".join(s for _, _, s in mine) == (body or "")
        assert all(body[a:b] == s for a, b, s in mine)
    explodes = [x for x in _plan(H.sentence_table(docs)).splitlines() if "Generate" in x and "pieces" in x]
    assert explodes and not any("text" in x for x in explodes)


def test_landed_records_are_dealt_and_fields_join_no_content(spark, tmp_path, monkeypatch):
    """r04 F2: a landed file may come as one piece, which one task reads."""
    from scrutin.operators import docs as D
    from scrutin.operators import fields as M
    from scrutin.plans.index import add_records, open_index
    from scrutin.sources.stoplist import stop_list
    recs = spark.createDataFrame([(i, f'{{"path": "p/", "name": {{"name": "f{i}"}}, "meta": {{"size": 4}}}}', b"some plain words") for i in range(30)],
                                 "seq long, metadata string, content binary").coalesce(1)
    plans, made = [], D.records_to_docs

    def seen(rows, *a, **k):
        plans.append(_plan(rows))
        return made(rows, *a, **k)

    fields, of = [], M.metadata_fields
    monkeypatch.setattr(D, "records_to_docs", seen)
    monkeypatch.setattr(M, "metadata_fields", lambda df: fields.append(df.columns) or of(df))
    for part in (recs.where("seq < 20"), recs, recs.unionByName(recs)):
        add_records(part.coalesce(1), stop_list(spark), str(tmp_path / "ix"))
    assert len(plans) == 2 and "Repartition" in plans[0]
    assert all("content" not in c for c in fields)
    ix = open_index(spark, str(tmp_path / "ix"))
    assert sorted(int(r["ID"]) for r in ix.docs.collect()) == list(range(60))
    assert ix.fields.where("key = 'size'").count() == 60
    assert sorted(r["long"] for r in ix.fields.where("key = 'size' and ID in ('0', '1')").collect()) == [4, 12]


def test_shuffle_files_go_when_a_statement_has_run(spark):
    """r04 F3."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), session.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


def test_only_sentences_that_hold_a_term_meet_their_postings(spark):
    """r04 F3."""
    sents = spark.createDataFrame([("1", 0, "A Cat."), ("1", 1, "Concatenate!"), ("1", 2, "dog"), ("2", 0, "ÜBER")], "ID string, s_idx int, sentence string")
    none = spark.createDataFrame([], "term string, tfidf double, term_len int")
    stats = lambda present: H.QueryTermStats(none, none, 1, 1.0, 1, present, present)
    assert _rows(H.holding(sents, stats(["cat", "über"])), "ID", "s_idx") == [("1", 0), ("1", 1), ("2", 0)]
    assert H.holding(sents, stats([])).count() == 0
    many = [f"t{i}" for i in range(100)]
    assert H.holding(sents, stats(many)).count() == 4 and H.holding(sents, stats(None)).count() == 4


def test_index_tables_are_compressed_well(spark, tmp_path):
    """r04 F3: an index is several times as large as its texts."""
    import glob
    import pyarrow.parquet as pq
    from scrutin.plans import generations as G
    G.put(spark.createDataFrame([("1", "a")], "ID string, term string").coalesce(1), str(tmp_path), "g", "docs")
    g = G._merge(spark, str(tmp_path), [{"name": "g", "level": 0, "tables": ["docs"]}] * 2)
    for name in ("g", g["name"]):
        (file,) = glob.glob(str(tmp_path / "gen" / name / "docs" / "*.parquet"))
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
