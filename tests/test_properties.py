"""Properties: score ranges, map coverage, valid colouring, streamed = batch,
independence from partitioning."""

import io

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from scrutin.catalog import FLAGSHIP_TERMS, PHRASE_TERMS, REF_DATE_MS, oracle_som
from scrutin.operators import cellmap as C
from scrutin.operators import hits as H
from scrutin.operators import query as Q
from scrutin.operators import rank as R
from scrutin.plans.cluster import cluster_for
from scrutin.plans.index import index_for


def test_hit_scores_span_zero_to_ten_per_class(spark):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    h = H.rank_hits(ctx, Q.Terms(FLAGSHIP_TERMS), REF_DATE_MS)
    for r in h.groupBy("is_unallocated").agg(F.min("score").alias("lo"), F.max("score").alias("hi"),
                                             F.count(F.lit(1)).alias("n")).collect():
        assert r["lo"] == 0.0
        if r["n"] > 1:
            assert abs(r["hi"] - 10.0) < 1e-9


def test_every_non_empty_document_has_a_cell(spark):
    ix = index_for(spark, SF_SMALL)
    cr = cluster_for(ix, oracle_som())
    j = cr.vectors.join(cr.assignments, "ID")
    bad = j.where((F.size("features") > 0) & ((F.col("cell").cast("int") < 0)
                                              | (F.col("cell").cast("int") >= cr.cfg.cells)))
    assert bad.count() == 0
    assert j.where((F.size("features") == 0) & (F.col("cell") != "-1")).count() == 0


def test_region_colouring_is_valid(spark):
    ix = index_for(spark, SF_SMALL)
    cr = cluster_for(ix, oracle_som())
    adj = cr.adjacency()
    n = cr.regions().select("region").distinct().count()
    colors = C.region_colors(adj, n)
    for r in adj.collect():
        assert colors[r["region"]] != colors[r["other"]]


def test_streamed_tables_equal_batch_tables(spark):
    from scrutin.catalog import q_i1_streaming_ingest
    from scrutin.operators import analysis as A
    from scrutin.sources.stoplist import stop_list
    from scrutin.operators.docs import records_to_docs
    from scrutin.catalog import _records
    from scrutin.sources.stoplist import default_stop_terms
    streamed = q_i1_streaming_ingest(spark, SF_SMALL)
    docs = records_to_docs(_records(spark, SF_SMALL), default_stop_terms())
    batch = A.term_stats(A.doc_terms(A.tokens(A.by_document(docs), stop_list(spark))))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_streamed_index_searches_like_a_batch_index_and_replays(spark, tmp_path):
    """Records in three micro-batches, one replayed: the opened index gives
    the same search and hits as an index written in one go."""
    from scrutin.catalog import _records
    from scrutin.operators.docs import records_to_docs
    from scrutin.plans.index import open_index, write_index
    from scrutin.sources.stoplist import default_stop_terms, stop_list
    from scrutin.streaming.ingest import process_batch
    recs = _records(spark, SF_SMALL)
    run = process_batch(stop_list(spark), f"{tmp_path}/streamed")
    for i in (0, 1, 2, 1):
        run(recs.where(F.col("seq") % 3 == i), i)
    docs = records_to_docs(recs, default_stop_terms()).drop("priority")
    write_index(docs, stop_list(spark), f"{tmp_path}/batch")
    a, b = (Q.Context(open_index(spark, f"{tmp_path}/{n}")) for n in ("streamed", "batch"))
    assert a.index.corpus_row() == b.index.corpus_row()
    q = Q.Bool(must=[Q.Or(Q.Term("From"), Q.Term("des"))], must_not=[Q.Term("tion")])
    score = lambda c: {r["ID"]: round(r["score"], 9) for r in R.search(c, q).collect()}
    assert score(a) == score(b) and score(a)
    hit = lambda c: sorted((r["ID"], r["s_idx"], round(r["score"], 9))
                           for r in H.rank_hits(c, Q.Terms(["from"]), REF_DATE_MS).collect())
    assert hit(a) == hit(b)


def test_repeated_append_changes_nothing(spark, tmp_path):
    from scrutin.catalog import _docs, _stops
    from scrutin.plans.index import _remove, open_index, write_index
    docs, path = _docs(spark, SF_SMALL).where(F.col("ID").cast("long") < 80), f"{tmp_path}/ix"
    first, more = docs.where(F.col("ID").cast("long") < 40), docs.where(F.col("ID").cast("long") >= 30)
    write_index(first, _stops(spark), path)
    for _ in range(2):
        write_index(more, _stops(spark), path, mode="append")
    ix = open_index(spark, path)
    assert ix.docs.count() == docs.count() == ix.corpus_row()[0]
    assert ix.doc_terms.count() == ix.doc_terms.select("ID", "term").distinct().count()
    _remove(spark, f"{path}/_BUILT")
    with pytest.raises(RuntimeError):
        write_index(more, _stops(spark), path, mode="append")


@pytest.mark.parametrize("text, kept", [("Example", ["example"]), ("EXAMPLE for you", ["example"]), ("the", []),
                                        ("e\u0301te\u0301 1.5", ["e\u0301te\u0301", "1.5"])])
def test_query_text_is_analysed_like_bodies(spark, text, kept):
    from scrutin.sources.stoplist import default_stop_terms
    from scrutin.operators import analysis as A
    from scrutin.sources.stoplist import stop_list
    got = Q.analyze(text, frozenset(default_stop_terms()))
    body = spark.createDataFrame([("1", text)], "ID string, body string")
    assert got == [(r["term"], r["pos"]) for r in A.tokens(A.by_document(body), stop_list(spark)).orderBy("pos").collect()]
    assert [t for t in kept if t in dict(got)] == kept


MIXED = [("他在北京图书馆读书", "他 在 北 京 图 书 馆 读 书"), ("東京タワーへ行く", "東 京 タワー へ 行 く"), ("iPhone手机3号", "iphone 手 机 3 号"),
         ("สวัสดีครับ ไทย ๑๒", "สวัสดีครับ ไทย ๑๒"), ("한국어 문장", "한국어 문장"), ("か\u3099 〇〆々", "か\u3099 〇 〆 々"), ("ﾊﾝｶｸ・カナ", "ﾊﾝｶｸ カナ"),
         ("𠮷野家 a.b", "𠮷 野 家 a.b"), ("don’t 1.5 x_y 他.你", "don’t 1.5 x_y 他 你"), ("ភាសាខ្មែរ ພາສາລາວ မြန်မာ", "ភាសាខ្មែរ ພາສາລາວ မြန်မာ"),
         ("y" * 255 + " " + "z" * 256 + " e", "y" * 255 + " e")]


def test_scripts_without_spaces(spark):
    """Bodies, postings with offsets and query text by the same rules; a Chinese
    word is found as the phrase of its characters."""
    from scrutin.operators import analysis as A
    from scrutin.plans.index import open_index, write_index
    from scrutin.sources.stoplist import stop_list
    body = spark.createDataFrame([(str(2 * i), t, len(t)) for i, (t, _) in enumerate(MIXED)], "ID string, body string, body_len long")
    toks, offsets = {}, {}
    for r in A.raw_tokens(A.by_document(body)).collect():
        toks.setdefault(r["ID"], []).append((r["pos"], r["term"]))
    for r in A.postings_with_offsets(A.by_document(body), stop_list(spark)).collect():
        offsets[r["ID"], r["pos"]] = (r["term"], r["start"], r["end"])
    for i, (text, want) in enumerate(MIXED):
        found = sorted(toks[str(2 * i)])
        assert [t for _, t in found] == want.split() and [(t, p) for p, t in found] == Q.analyze(text)
        for p, t in found:
            at = offsets.get((str(2 * i), p))
            assert at is None or (at[0] == t and text[at[1]:at[2]].lower() == t)
    path = f"{__import__('tempfile').mkdtemp(prefix='run-')}/ix"
    write_index(body, stop_list(spark), path)
    ctx = Q.Context(open_index(spark, path))
    ids = lambda q: {r["ID"] for r in R.search(ctx, q).collect()}
    assert ids(Q.Term("图书馆")) == {"0"} and ids(Q.Term("书图")) == set() and ids(Q.Term("タワー")) == {"2"}
    assert ids(Q.Term("手机")) == {"4"} and ids(Q.Term("z" * 256)) == set()


def test_nothing_is_cut_at_a_size(spark):
    """Long tokens, long sentences, deep metadata, dotted tokens, and the
    filename feature on both sides of the literal limit."""
    import json
    from scrutin.operators import analysis as A
    from scrutin.operators import docs as D
    body = spark.createDataFrame([("1", "x" * 70_000 + " ab.c d.e.f! tail " + "y" * 70_000),
                                  ("2", "s" * 100_000 + ". Next mail3.example.com end.  \ue000 a.b x")], "ID string, body string")
    toks = sorted((r["ID"], r["pos"], len(r["term"])) for r in A.raw_tokens(A.by_document(body)).collect())
    # the analyser's length limit: an overlong token is no term, but holds its place
    assert toks == [("1", 1, 4), ("1", 2, 5), ("1", 3, 4), ("2", 1, 4), ("2", 2, 17), ("2", 3, 3), ("2", 4, 3), ("2", 5, 1)]
    for size in (100, 1 << 16):
        sents = H.sentences(H.sentence_chunks(body, size)).collect()
        assert sorted((r["ID"], r["s_idx"], r["s_end"] - r["s_start"], len(r["sentence"])) for r in sents) == [
            ("1", 0, 70_012, 70_012), ("1", 1, 70_006, 70_006), ("2", 0, 100_001, 100_001), ("2", 1, 28, 28), ("2", 2, 9, 9)]
    deep = leaf = {}
    for i in range(12):
        leaf["k"] = leaf = {}
    leaf["k"] = [1.9, {"z": "end"}, None, True]
    flat = D.flatten_json(spark.createDataFrame([(1, json.dumps(deep)), (2, "[]"), (3, None)], "id int, js string"), "id", "js")
    assert sorted((r["key"], r["value"]) for r in flat.collect()) == [
        ("-".join("k" * 13) + "-0", "1"), ("-".join("k" * 13) + "-1-z", "end")]


def test_filename_feature_is_the_same_for_any_number_of_terms(spark, monkeypatch):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    q = Q.Terms(["from", "rom/", "zzz", "doc1"])
    few = lambda: sorted((r["ID"], r["f_filename_indirect"]) for r in H.doc_features(
        ctx.index.docs, ctx.index.doc_stats, H.query_term_stats(ctx, Q.query_terms(ctx, q)), REF_DATE_MS).collect())
    small = few()
    monkeypatch.setattr(H, "LITERAL_TERMS_MAX", 1)
    assert few() == small and {v for _, v in small} == {0.0, 1.0}


def test_postings_of_sentences_are_those_of_bodies(spark):
    """Positions and sentences, in whole documents and in tiny chunks."""
    from scrutin.catalog import _docs, _stops
    from scrutin.operators import analysis as A
    from scrutin.operators import hits as H
    docs = _docs(spark, SF_SMALL)
    want = sorted(map(tuple, A.tokens(A.by_document(docs), _stops(spark)).select("ID", "term", "pos").collect()))
    for size in (60, 1 << 16):
        sents = H.sentence_table(docs, size)
        toks = H.sentence_tokens(sents, _stops(spark))
        assert sorted(map(tuple, toks.select("ID", "term", "pos").collect())) == want
    lost = toks.join(sents, ["ID", "s_idx"]).where(~F.contains(F.lower("sentence"), F.col("term")))
    assert lost.count() == 0


TREE = Q.Bool(must=[Q.Or(Q.Term("from"), Q.Term("des"), Q.Boost(Q.Terms(["tion", "anea"]), 2.0))],
              should=[Q.Phrase(PHRASE_TERMS, slop=3), Q.Bool(must=[Q.Term("ed"), Q.FieldEquals("extension", "pdf")]),
                      Q.Wildcard(pattern="*dble"), Q.Range("size", 100, 4000)],
              must_not=[Q.Bool(must=[Q.Term("on")], must_not=[Q.Term("tion")]), Q.Bool(must_not=[Q.Term("from")])])


def test_a_tree_costs_one_scan_of_the_term_vectors(spark):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    q = Q.Bool(must=[Q.Or(*[Q.Term(t) for t in ("from", "des", "tion", "anea", "ed", "on")])],
               must_not=[Q.Bool(must=[Q.Term("eriner"), Q.Term("des")])])
    plan = Q.evaluate(ctx, q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_a_tree_against_brute_force(spark):
    """Matches and scores of a nested tree from its leaves' own results."""
    ctx = Q.Context(index_for(spark, SF_SMALL))
    leaf = lambda c, q=1.0: {r["ID"]: r["score"] for r in c.analyzed(ctx).scores(ctx, q).collect()}

    def score(c, q):
        if isinstance(c, Q.Boost):
            return score(c.inner, q * c.boost)
        if not isinstance(c, Q.Bool):
            return leaf(c, q)
        parts = [score(x, q * c.boost) for x in c.must + c.should]
        out = {}
        for i in set().union(*parts) if parts else ():
            if all(i in p for p in parts[:len(c.must)]) and not any(i in score(n, 1.0) for n in c.must_not):
                held = [p[i] for p in parts if i in p]
                out[i] = sum(held) * len(held) / len(parts)
        return out

    tree = TREE.analyzed(ctx)
    want = score(TREE, 1.0 / tree.sum_sq(ctx) ** 0.5)
    got = {r["ID"]: r["score"] for r in Q.evaluate(ctx, TREE).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_scores_are_the_same_to_the_last_bit(spark, monkeypatch):
    """Whatever the partitions and the order of rows; so a cursor of one run
    pages through another."""
    import dataclasses
    ix = index_for(spark, SF_SMALL)
    runs = []
    for n, seed in ((1, 1), (3, 2), (7, 3)):
        shuffled = {t: getattr(ix, t).orderBy(F.rand(seed)).repartition(n) for t in ("doc_terms", "postings")}
        ctx = Q.Context(dataclasses.replace(ix, **shuffled))
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        runs.append([(r["ID"], r["score"]) for q in (TREE, Q.Terms(FLAGSHIP_TERMS), Q.Phrase(PHRASE_TERMS, slop=4))
                     for r in R.ranked(R.search(ctx, q)).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1] == runs[2]
    res = [R.search(Q.Context(dataclasses.replace(ix, doc_terms=ix.doc_terms.repartition(n, "term"))), TREE) for n in (2, 5)]
    every = [r["ID"] for r in R.ranked(res[0]).collect()]
    at, paged = None, []
    while True:
        rows = (R.page(res[0], 0, 7) if at is None else R.page_after(res[len(paged) % 2], at[0], at[1], 7)).collect()
        if not rows:
            break
        paged += [r["ID"] for r in rows]
        at = (rows[-1]["score"], rows[-1]["ID"])
    assert paged == every
    # more terms than get columns
    many = Q.Terms([r["term"] for r in ix.term_stats.orderBy("term").limit(90).collect()] + FLAGSHIP_TERMS, analyze=False)
    a = {r["ID"]: r["score"] for r in R.search(Q.Context(ix), many).collect()}
    monkeypatch.setattr(Q, "PLAIN_TERMS", 500)
    b = {r["ID"]: r["score"] for r in R.search(Q.Context(ix), many).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)


def test_hit_boundaries_do_not_depend_on_chunks(spark, monkeypatch):
    """Chunks of a few sentences, in whole ranking runs."""
    ctx = Q.Context(index_for(spark, SF_SMALL))
    cols = ["ID", "s_idx", "next_first", "prev_last", "distance", "max_hit_tf", "dot", "raw_score"]
    rows = lambda: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in H.rank_hits(
        ctx, Q.Terms(FLAGSHIP_TERMS), REF_DATE_MS).select(*cols).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(H, "CHUNK_SENTENCES", 3)
    assert rows() == want and any(r[2] for r in want)


def test_matches_agree_with_the_index(spark):
    """The number of matches of a term in a document is its tf in the index."""
    from scrutin.catalog import _stops
    ctx = Q.Context(index_for(spark, SF_SMALL))
    q = Q.Bool(should=[Q.Terms(["from", "example"]), Q.Regexp(regex=r".*\.[a-z0-9]+")])
    sents = H.sentence_table(ctx.index.docs, 5000)
    m = H.matches(H.sentence_tokens(sents, _stops(spark)), H.query_term_stats(ctx, Q.query_terms(ctx, q)))
    got = m.groupBy("ID", "term").agg(F.count(F.lit(1)).alias("tf"))
    want = ctx.index.doc_terms.join(Q.query_terms(ctx, q), "term", "left_semi").select("ID", "term", F.col("tf").cast("long").alias("tf"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 20


def test_results_do_not_depend_on_partitioning(spark):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    q = Q.Or(Q.Terms(FLAGSHIP_TERMS), Q.Phrase(["anea", "eriner"], slop=1))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    a = {(r["ID"], round(r["score"], 9)) for r in R.search(ctx, q).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = {(r["ID"], round(r["score"], 9)) for r in R.search(ctx, q).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and a


def test_dump_source_round_trip_and_truncation(spark, tmp_path):
    import io

    import pytest

    from scrutin.sources.records import encode_record, read_records
    data = encode_record('{"a":1}', b"xyz") + encode_record("{}", b"")
    assert list(read_records(io.BytesIO(data))) == [('{"a":1}', b"xyz"), ("{}", b"")]
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(data[:-3])))


def test_one_dump_is_read_by_many_tasks(spark, tmp_path):
    """Ranges of whole records, records longer than a range and than a header
    read, empty ones, URIs; a file that is cut anywhere raises."""
    from scrutin.sources import records as S
    recs = [(f'{{"n": {i}}}', bytes([i]) * (200_000 if i in (3, 4) else i % 5)) for i in range(40)]
    data = b"".join(S.encode_record(*r) for r in recs)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.dump").write_bytes(data)
    (tmp_path / "d" / "two.dump").write_bytes(S.encode_record("{}", b"\n"))
    (tmp_path / "d" / "none.dump").write_bytes(b"")
    (tmp_path / "d" / "_DONE").write_bytes(b"x")
    for path in (str(tmp_path / "d"), f"file://{tmp_path}/d"):
        df = S.read_dumps(spark, path, range_bytes=100)
        assert df.rdd.getNumPartitions() >= 8
        got = sorted((r["file"].rsplit("/", 1)[1], r["idx"], r["metadata"], bytes(r["content"])) for r in df.collect())
        assert got == [("one.dump", i, *r) for i, r in enumerate(recs)] + [("two.dump", 0, "{}", b"\n")]
    parts = [list(S.walk(io.BytesIO(data), len(data), n)) for n in (1, 1000, 1 << 30)]
    for p in parts:
        assert [x for r in p for x in range(r[0], r[0] + r[3])] == list(range(40))
        assert p[0][1] == 0 and p[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(p, p[1:]))
    assert [len(p) for p in parts] == [40, 3, 1]
    whole = {r[2] for r in parts[0]} | {0}
    for cut in {*range(60), *range(len(data) - 60, len(data))} - whole:
        with pytest.raises(ValueError):
            list(S.walk(io.BytesIO(data[:cut]), cut))
    (tmp_path / "d" / "two.dump").write_bytes(data[:-3])
    with pytest.raises(Exception, match="ends inside"):
        S.read_dumps(spark, str(tmp_path / "d")).collect()


def test_chunked_tokenising_equals_whole_documents(spark):
    """Huge documents are cut into chunks; positions and offsets must not
    change. A tiny chunk size forces many chunks per document."""
    from scrutin.operators import analysis as A
    from scrutin.sources.stoplist import stop_list
    from scrutin.sources.tables import evidence_docs
    docs = evidence_docs(spark, SF_SMALL)
    whole = A.raw_tokens(A.by_document(docs, chunk_chars=1 << 20))
    tiny = A.raw_tokens(A.by_document(docs, chunk_chars=40))
    assert tiny.exceptAll(whole).count() == 0 and whole.exceptAll(tiny).count() == 0
    pw = A.postings_with_offsets(A.by_document(docs, chunk_chars=1 << 20), stop_list(spark))
    pt = A.postings_with_offsets(A.by_document(docs, chunk_chars=40), stop_list(spark))
    assert pt.exceptAll(pw).count() == 0 and pw.exceptAll(pt).count() == 0
    # offsets point at the term in the body
    b = docs.select("ID", "body")
    bad = pt.join(b, "ID").where(F.lower(F.expr("substring(body, start + 1, `end` - start)")) != F.col("term"))
    assert bad.count() == 0


def test_chunked_hit_ranking_equals_whole_documents(spark):
    """Matching documents are cut into sentence-aligned chunks; with chunks
    longer than any sentence but shorter than most documents the hits must
    not change."""
    from scrutin.functions.text import SENTENCE_RE
    from scrutin.operators.hits import sentence_chunks, sentences
    from scrutin.sources.tables import evidence_docs
    docs = evidence_docs(spark, SF_SMALL).select("ID", "body")
    longest = docs.select(F.explode(F.regexp_extract_all("body", F.lit(SENTENCE_RE), 0)).alias("s")) \
        .agg(F.max(F.length("s"))).first()[0]
    size = longest + 1
    whole = sentences(sentence_chunks(docs, 1 << 24)).drop("chunk")
    parts = sentences(sentence_chunks(docs, size)).drop("chunk")
    assert sentence_chunks(docs, size).where("chunk > 0").count() > 0
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
    ctx = Q.Context(index_for(spark, SF_SMALL))
    cols = ["ID", "s_idx", "s_start", "s_end", "distance", "snippet", "raw_score", "score"]
    a = H.rank_hits(ctx, Q.Terms(FLAGSHIP_TERMS), REF_DATE_MS).select(*cols)
    b = H.rank_hits(ctx, Q.Terms(FLAGSHIP_TERMS), REF_DATE_MS, chunk_chars=size).select(*cols)
    ra = {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect()}
    rb = {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect()}
    assert ra == rb and ra


def test_som_is_independent_of_partitioning_and_error_does_not_rise(spark):
    """Only counts are aggregated, so the trained map must not depend on how
    the vectors are partitioned; on a corpus the quantization error (mean
    distance to the winner) must not rise from the first to the last epoch."""
    import numpy as np

    from scrutin.operators import som as S
    ix = index_for(spark, SF_SMALL)
    cfg = S.SomConfig(width=3, height=3, max_vector_features=30, max_radius=1, min_radius=0,
                      max_alpha=0.5, min_alpha=0.1, iterations=3, top_terms=3)
    feats = S.feature_terms(ix.term_stats, ix.corpus_row()[0], cfg)
    vec = S.doc_vectors(ix.docs, ix.doc_terms, feats)
    dims = feats.count()
    a = S.weight_matrix(S.train(vec.repartition(1), cfg, dims).weights, cfg, dims)
    b = S.weight_matrix(S.train(vec.repartition(7), cfg, dims).weights, cfg, dims)
    assert np.allclose(a, b, atol=1e-12)

    def qerr(mat):
        bm = spark.sparkContext.broadcast(mat)
        d = S.assign_cells(vec, bm, cfg).where("cell != '-1'").agg(F.avg("som_cell_distance")).first()[0]
        return d

    first = S.train(vec, S.SomConfig(**{**cfg.__dict__, "iterations": 1}), dims)
    assert qerr(a) <= qerr(S.weight_matrix(first.weights, cfg, dims)) + 1e-9


def test_chunk_bases_two_levels(spark, monkeypatch):
    from scrutin.operators import analysis as A
    monkeypatch.setattr(A, "CHUNK_GROUP", 3)
    rows = [("d", c, c + 1) for c in range(10)] + [("e", c, 2) for c in range(4)]
    df = spark.createDataFrame(rows, "ID string, chunk int, n int")
    got = {(r["ID"], r["chunk"]): r["base_n"] for r in A.chunk_bases(df, "n").collect()}
    exp = {}
    for d in ("d", "e"):
        acc = 0
        for _, c, n in [r for r in rows if r[0] == d]:
            exp[(d, c)] = acc
            acc += n
    assert got == exp


def test_streaming_ingest_counters_match_batch(spark, tmp_path):
    from scrutin.catalog import _records
    from scrutin.operators.docs import ingest_counters as batch_counters
    from scrutin.sources.stoplist import stop_list
    from scrutin.streaming.ingest import ingest_counters, start_ingest
    run = str(tmp_path)
    _records(spark, SF_SMALL).repartition(3).write.parquet(f"{run}/landing")
    start_ingest(spark, f"{run}/landing", f"{run}/index", f"{run}/ckpt", stop_list(spark)).awaitTermination()
    a = ingest_counters(spark, f"{run}/index").first().asDict()
    b = batch_counters(_records(spark, SF_SMALL)).first().asDict()
    assert a == b


def test_hit_ranking_edge_queries(spark):
    """Match-all and absent terms give no hits (no terms to highlight);
    dictionary clauses contribute their expanded terms."""
    ctx = Q.Context(index_for(spark, SF_SMALL))
    assert H.rank_hits(ctx, None, REF_DATE_MS).count() == 0
    assert H.rank_hits(ctx, Q.Terms(["zzzqqq"]), REF_DATE_MS).count() == 0
    assert H.rank_hits(ctx, Q.Prefix(prefix="eriner"), REF_DATE_MS).count() > 0
    assert R.search(ctx, Q.Terms(["zzzqqq"])).count() == 0


def test_queries_in_threads_share_one_build(spark):
    """Registered queries may run concurrently in one session; cached tables
    are built once and every query sees complete tables."""
    import threading

    import __spark_entry__ as E
    out = {}

    def run(n):
        out[n] = E.queries()[n](spark, SF_SMALL).count()

    names = ["e1_tfidf_or", "c4_doc_terms", "g14_assignments", "a2_record_ids"]
    ts = [threading.Thread(target=run, args=(n,)) for n in names]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert out["c4_doc_terms"] > 0 and out["g14_assignments"] == 200 and out["a2_record_ids"] == 200
    assert out["e1_tfidf_or"] == E.queries()["e1_tfidf_or"](spark, SF_SMALL).count()
