"""The corpus operators against brute force, exact round trips and oracles,
on the smallest tables and on rows of edge cases."""

import base64
import collections
import hashlib
import html as references
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from scrutin import llm
from scrutin.llm import bpe, extract, license, minhash, mixing, quality, topk, toxicity, urlfilter, warc
from scrutin.llm.common import table, written

LONG = "word " * 30_000 + "x" * 200_000


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF_SMALL, "documents").collect()}


def edge_documents(spark, rows):
    """Documents with further columns that clash with what operators add."""
    schema = "doc_id long, text string, lang string, source string, score string, Size int, `odd name` string, taken int"
    return spark.createDataFrame([(i, t, "en", s, "s", 1, "o", 2) for i, t, s in rows], schema)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, LONG, "b"), (5, "one", "b"), (5, "one", "b"),
        (None, "two words", None), (6, "tie tie", "c"), (7, "tie tie", "c"), (8, "nul\x00 and 🙂 é", "")]


# ------------------------------------------------------------------ op 1

def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return sets, {i: find(i) for i in ids}


def test_op1_equals_brute_force(spark, docs):
    got = llm.QUERIES["op1_minhash"](spark, SF_SMALL).collect()
    sets, comp = brute_components({i: r.text for i, r in docs.items()}, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_op1_chain_of_near_copies_and_large_bucket(spark):
    rng = np.random.default_rng(5)
    base = [f"w{n}" for n in rng.integers(0, 500, 120)]
    rows, words = [], list(base)
    for i in range(60):  # each step changes a word: far ends differ, the chain links them
        rows.append((i, " ".join(words)))
        words[int(rng.integers(0, 120))] = f"z{i}"
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    rows += [(200 + i, f"other text number {i} with words of its own {i * 7} and more {i * 3}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, comp = brute_components(dict(rows), 5, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=5, percent=80).collect()}
    assert got == comp


def test_op1_edge_rows(spark):
    got = minhash.near_duplicates(edge_documents(spark, EDGE), k=2).collect()
    assert len(got) == len(EDGE)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[1][:1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[5] == [(1, 5, True)] * 2 and by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)]
    assert by[None] == [(1, None, True)]
    assert minhash.near_duplicates(edge_documents(spark, [])).count() == 0


def test_word_hashes_cut_long_texts_at_white_space(monkeypatch):
    text = " ".join(f"Word{n}" for n in range(5000)).encode()
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "LONG", 1000)
    assert (minhash.word_hashes(text) == whole).all()
    assert len(set(whole.tolist())) == 5000
    assert (minhash.word_hashes(b"ABC def") == minhash.word_hashes(b"abc\tdef")).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    same = minhash.superminhash(a, 256) == minhash.superminhash(b, 256)
    assert abs(same.mean() - 1500 / 2500) < 0.1
    one = minhash.superminhash(pool[:1], 64)  # one element fills registers with a permutation
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(64))


# ------------------------------------------------------------------ op 2

def test_op2_mix_meets_targets(spark, docs):
    got = llm.QUERIES["op2_mix"](spark, SF_SMALL).collect()
    again = llm.QUERIES["op2_mix"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    by = collections.defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split())
        assert 0 <= r.taken <= 3 * r["size"]
        b = by[docs[r.doc_id].source]
        b[0] += r["size"]
        b[1] += r.taken
        b[2] = r.target
        b[3] = max(b[3], r["size"])
        assert b[0] <= r.source_size
    total = sum(b[0] for b in by.values())
    want = {s: 0.0 for s in sorted(by)}  # water filling, step by step
    left, active = float(total), {s: i % 3 + 1 for i, s in enumerate(sorted(by))}
    while active:
        full = [s for s, w in active.items() if left * w / sum(active.values()) > 3 * by[s][0]]
        if not full:
            want |= {s: left * w / sum(active.values()) for s, w in active.items()}
            break
        for s in full:
            want[s] = 3.0 * by[s][0]
        left -= sum(want[s] for s in full)
        active = {s: w for s, w in active.items() if s not in full}
    for s, (_, taken, target, longest) in by.items():
        assert target == pytest.approx(want[s])
        assert abs(taken - target) <= longest
    assert sum(b[1] for b in by.values()) <= total


def test_op2_edge_rows(spark):
    out = mixing.mix(edge_documents(spark, EDGE))
    assert out.count() == len(EDGE) and [c.lower() for c in out.columns].count("size") == 1
    rows = out.collect()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(edge_documents(spark, [])).count() == 0
    assert mixing.mix(edge_documents(spark, [(1, None, "a")])).first().taken == 0


def test_op2_hot_source_is_capped_and_reshared(spark):
    rows = [(i, "w " * 10, "big") for i in range(300)] + [(1000 + i, "w " * 10, "tiny") for i in range(3)]
    got = mixing.mix(edge_documents(spark, rows)).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    assert {r.target for r in got if r.source == "tiny"} == {90.0}  # three times its 30 words
    assert taken["tiny"] == 90 and taken["big"] == 2940


# ------------------------------------------------------------------ op 3

def test_levenshtein_automaton_equals_dynamic_programming():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else _next(row, x, b, i)
        return row

    def _next(row, x, b, i):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abc"), int(rng.integers(1, 7)))) for _ in range(300)}
    terms = {"abcab$": True, "cabba$": True, "bbcacb": True, "aabc": False, "c$": False}
    automaton = toxicity.Automaton(terms)
    for w in words:
        best = None
        for t, near in terms.items():
            whole = t.endswith("$")
            row = distance(t.rstrip("$"), w)
            d = row[-1] if whole else min(row)
            if d <= (1 if near else 0):
                best = d if best is None else min(best, d)
        got = automaton.match(w)
        assert (got[1] if got else None) == best, (w, got, best)


def test_toxicity_learns_terms_and_context(spark):
    rng = np.random.default_rng(0)
    vocab = [f"wort{n}" for n in range(300)]
    rows = []
    for i in range(400):
        words = list(rng.choice(vocab, 40))
        toxic = i % 4 == 0
        if toxic:
            for w in rng.choice(["grobian", "schuftig"], 3):
                words.insert(int(rng.integers(0, 40)), w)
        rows.append((i, " ".join(words), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(toxicity.labelled(d.select("doc_id", "text"), d.select("doc_id", "toxic")))
    assert {"grobian$", "schuftig$"} <= set(model[0]) and len(model[0]) < 6
    probe = [(1, "du grobian und schuftig bist"), (2, "du grobbian bist ein grobiann"), (3, "alles gut hier"), (4, None), (5, "")]
    got = {r.doc_id: r for r in toxicity.score(
        spark.createDataFrame(probe, "doc_id long, text string"), model, hits="hits").collect()}
    assert got[1].score > 0.5 and got[2].score > got[3].score and got[3].score < 0.5
    assert got[4].score == got[5].score == got[3].score
    assert [(h.term, h.distance) for h in got[2].hits] == [("grobian$", 1), ("grobian$", 1)]
    quoted = toxicity.hit_features('er sagte "du grobian" und ging', toxicity.Automaton(model[0]))[0]
    assert quoted[3] > 0 and quoted[0] == 0


def test_op3_held_out_rows(spark, docs):
    got = {r.doc_id: r for r in llm.QUERIES["op3_toxicity"](spark, SF_SMALL).collect()}
    assert set(got) == set(docs)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    clean = [r.doc_id for r in table(spark, SF_SMALL, "labels").filter("toxic = 0").collect()]
    assert sum(got[i].predicted for i in clean if i in got) <= 0.02 * len(clean)


def test_op3_edge_rows(spark):
    none = toxicity.learn(toxicity.labelled(edge_documents(spark, EDGE), spark.createDataFrame([], "doc_id long, toxic int")))
    assert none is None
    out = toxicity.score(edge_documents(spark, EDGE), ({"one$": False}, toxicity.PRIOR))
    assert out.count() == len(EDGE) and dict(out.dtypes)["score"] == "double"
    assert toxicity.score(edge_documents(spark, []), None).count() == 0


# ------------------------------------------------------------------ op 4

def test_op4_equals_the_tokenizers_library(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r for r in llm.QUERIES["op4_bpe"](spark, SF_SMALL).collect()}
    for i, r in docs.items():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def test_op4_odd_texts():
    from tokenizers import Tokenizer
    path = bpe.default_tokenizer()
    t, c = Tokenizer.from_file(path), bpe.Codec(open(path, encoding="utf-8").read())
    rng = np.random.default_rng(2)
    pool = "aaab 's're \t\n\r\x1c\x85\xa0\u2003\u3000\u200b0²٣ßé漢ไ🙂!<|endoftext|>\ua7e2\ua7cb'll"
    texts = ["".join(rng.choice(list(pool), int(rng.integers(0, 30)))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaa" * 50, LONG, ""]
    for s, ids in zip(texts, c.encode(texts)):
        want = t.encode(s, add_special_tokens=False).ids
        assert ids.tolist() == want, s[:50]
        assert c.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_op4_edge_rows(spark):
    path = bpe.default_tokenizer()
    df = edge_documents(spark, EDGE).withColumnRenamed("score", "IDS").withColumnRenamed("taken", "n_tokens")
    out = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(out) == len(EDGE) and all(r.decoded == (r.text or "") for r in out)
    assert bpe.encode(edge_documents(spark, []), path).count() == 0


# ------------------------------------------------------------------ op 5

def test_op5_round_trip(spark):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, SF_SMALL, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
             "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages.items()]
    assert sorted(map(tuple, llm.QUERIES["op5_warc"](spark, SF_SMALL).collect())) == sorted(want)


def test_op5_edge_rows_and_small_packages(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: y", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (4, "u", ""),
            (None, "u", "<p>same</p>"), (None, "u", "lone"), (1, None, "<p>same</p>"), (9, "é", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_packages(df, f"file://{tmp_path}", package_bytes=300)
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes,
                               None if r.payload is None else bytes(r.payload)) for r in warc.read_packages(manifest).collect())
    same = b"<p>same</p>"
    assert got == collections.Counter([
        (1, "response", None, 11, same), (1, "response", None, 11, same), (3, "revisit", 1, 11, None),
        (None, "revisit", 1, 11, None), (2, "response", None, 0, b""), (4, "revisit", 2, 0, None),
        (None, "response", None, 4, b"lone"), (9, "response", None, len(LONG), LONG.encode())])
    empty = warc.write_packages(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_packages(empty).count() == 0


def test_zip64_directories_are_followed(tmp_path):
    import struct
    import zipfile
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for n in range(3):
            with z.open(f"archive/{n}", "w", force_zip64=True) as f:
                f.write(b"abc" * (n + 1))
        z.writestr("deflated", b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
    data = path.read_bytes()
    end = data.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack("<10xHII", data[end:end + 20])
    # the same archive as a writer of huge files would end it
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path.write_bytes(data[:end] + wide + locator + tail)
    with open(path, "rb") as f:
        found = warc.members(f, path.stat().st_size)
        assert sorted(found) == ["archive/0", "archive/1", "archive/2"]
        for n in range(3):
            at, size = found[f"archive/{n}"]
            f.seek(at)
            assert f.read(size) == b"abc" * (n + 1)
    with pytest.raises(ValueError):
        import io
        warc.members(io.BytesIO(data[:end]), end)


# ------------------------------------------------------------------ op 6

def brute_top(vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted(((-int(np.dot(np.array(vectors[q], dtype=object), np.array(v, dtype=object))), i)
                         for i, v in vectors.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def test_op6_equals_brute_force_on_ties_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (6, 8))
    vectors = {i: (centres[i % 6] + rng.integers(-9, 9, 8)).tolist() for i in range(400)}
    vectors |= {400 + i: vectors[0] for i in range(60)}  # one very common vector, asked and found
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, vector array<long>")
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks meet across partitions
    try:
        got = topk.top_products(df, F.col("vec_id") % 10 == 0, k=5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == sorted(brute_top(vectors, [i for i in vectors if i % 10 == 0], 5))


def test_op6_prunes(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (30, 8))
    x = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(0, 2, (3000, 8)))
    s = topk.Search(x[:100], x, np.arange(3000), 5)
    s.walk(topk.cover_tree(s.q, np.arange(100), 0), topk.cover_tree(s.x, np.arange(3000), 0))
    assert s.pruned and s.compared < 0.8 * 100 * 3000
    assert (s.score[:, 0] == (x[:100] @ x.T).max(axis=1)).all()


def test_op6_edge_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, float("nan")]), (2, None), (3, [0.25, None]), (None, [1.0, 1.0]),
            (50, [1.0, 0.5]), (50, [1.0, 0.5]), (5, [0.1, -0.1]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    v = df.withColumn("vector", topk.whole_numbers("embedding"))
    got = sorted(map(tuple, topk.top_products(v, F.col("vec_id") % 50 == 0).collect()))
    a, b = [256, 128], [25, -26]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert got == [(0, 1, 50, dot(a, a)), (0, 2, 5, dot(a, b)), (50, 1, 0, dot(a, a)), (50, 2, 5, dot(a, b))]
    assert topk.top_products(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = np.array([[2**30, 1]], dtype=np.int64)
    score, ids = topk.block_top(huge, np.array([[2**30, 1], [2**30, 2]]), np.array([1, 2]), 2)
    assert score == [[2**60 + 2, 2**60 + 1]] and ids == [[2, 1]]


# ------------------------------------------------------------------ op 7

def test_op7_keeps_the_articles(spark):
    html = {r.page_id: r.html for r in table(spark, SF_SMALL, "pages").collect()}
    for r in llm.QUERIES["op7_extract"](spark, SF_SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"</?(?:b|br)>", "", b)).split())
                  for b in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="top"><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, a long and tedious notice of
them that is as long as a paragraph of the article itself.</p></div>
<div class="content"><h2>Title &amp; more</h2><p>A first   paragraph with a <a href="x">link</a> that is long enough
to be the main text of this page, more than eighty characters.</p><aside>see also</aside><form><label>Mail</label></form>
<p>Short.</p><!-- <p>hidden</p> --><p>2 &lt; 3 and 1 < 2</p></div>
<ul><li><a href="1">one</a><li><a href="2">two</a></ul><script>var s = "<p>no</p>";</script>
<section class="user-comments"><p>First! This is a comment by a reader, and it is long enough to look like text.</p></section>
<footer>(c) 2020</footer></body></html>"""


def test_op7_page_without_marked_article():
    assert extract.main_text(PAGE) == (
        "Title & more\nA first paragraph with a link that is long enough to be the main text of this page, more than "
        "eighty characters.\nShort.\n2 < 3 and 1 < 2")


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"),
    ("<nav>no end<p>text", "no end\ntext"), ("<article><p>x</article><p>y", "x"), ("<!-- never closed <p>x", ""),
    ("<article><script>never closed <p>x", ""), ("<article><p title='a>b'>q</p></article>", "q"),
    ("<article><div class='ad'>buy</div><p>t&nbsp;u &#233;</p></article>", "t u é"), ("a < b", "a < b"),
    ("<article><header><h1>H</h1></header><p>x</p><div role=complementary>s</div></article>", "H\nx"),
])
def test_op7_edge_pages(page, text):
    assert extract.main_text(page) == text


def test_op7_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "<p>" + LONG, "t"), (None, "<p>x", None)], "page_id long, html string, TEXT string")
    got = extract.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, len(LONG)] and extract.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ op 8

@pytest.mark.parametrize("url, host, path, rule", [
    ("http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/"),
    ("https://a.example.net/de/", "a.example.net", "/de/", "net/"), ("https://a.example.net", "a.example.net", "", None),
    ("x://notexample.net/en/", "notexample.net", "/en/", "net/"), ("http://b.example.com/de/x?y#z", "b.example.com", "/de/x", "example.com/de/"),
    ("http://b.example.com/DE/x", "b.example.com", "/DE/x", None), ("http://o.org/fr/#x", "o.org", "/fr/", "org/fr/"),
    ("http://org?fr/", "org", "", None), (None, "", "", None), ("no scheme/en/", "", "", None),
    ("http://a://b/c", "a:", "//b/c", None), ("http://ÄB.net/", "Äb.net", "/", "net/"), ("", "", "", None),
])
def test_op8_parts_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url, "x")], "url string, HOST string")
    r = urlfilter.judge(df, df.select("url", F.lit(1).alias("good")).limit(0)).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == {"net/": "block", "example.com/de/": "block"}.get(rule, "allow")


def test_op8_bad_hosts_are_blocked_and_shrunk(spark):
    seen = [(f"http://bad.one.test/{i}", 0) for i in range(60)] + [(f"http://h{i % 9}.two.test/{i}", 1) for i in range(200)]
    df = spark.createDataFrame(seen, "url string, good int")
    ask = spark.createDataFrame([("http://bad.one.test/x",), ("http://new.one.test/x",), ("http://h1.two.test/x",),
                                 ("http://never.seen/x",), (None,)], "url string")
    got = {r.url: r for r in urlfilter.judge(ask, df).collect()}
    assert got["http://bad.one.test/x"].verdict == "block" and got["http://h1.two.test/x"].verdict == "allow"
    assert got["http://bad.one.test/x"].bound <= got["http://new.one.test/x"].bound < got["http://h1.two.test/x"].bound
    assert got["http://never.seen/x"].verdict == got[None].verdict == "allow"
    assert urlfilter.judge(ask.limit(0), df).count() == 0


# ------------------------------------------------------------------ op 9

def base_signals(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_op9_signals_and_verdicts(spark, docs):
    got = {r.doc_id: r for r in llm.QUERIES["op9_quality"](spark, SF_SMALL).collect()}
    for i, r in docs.items():
        assert tuple(got[i][c] for c in quality.BASE) == base_signals(r.text)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.THRESHOLD)
    labels = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect()}
    good = [i for i in got if labels.get(i) == 1 and not got[i].base_failed]
    assert sum(got[i].kept for i in good) >= 0.98 * len(good)


def test_op9_edge_rows(spark):
    rows = [*EDGE, (20, "a b c d e f g h " * 20, "x"), (21, "# * $\n\n \n# * $\n# * $", "x"), (22, "q " * 8, "x")]
    df = edge_documents(spark, rows)
    weights = quality.bucket_weights(df, spark.createDataFrame([(4,)], "doc_id long"))
    got = quality.judge(df.withColumnRenamed("Size", "N_WORDS"), weights).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(base_signals(t))
    assert all({tuple(r[c] for c in quality.BASE)} <= texts[r.doc_id] for r in got)
    none = edge_documents(spark, [])
    assert quality.judge(none, quality.bucket_weights(none, spark.createDataFrame([], "doc_id long"))).count() == 0


def test_op7_window_sums_choose_on_pages_with_an_article():
    story = "".join(f"<p>{n} {'a long sentence of the story itself ' * 4}</p>" for n in range(4))
    cards = "".join(f"<article><h3>Other story {n}</h3></article>" for n in range(3))
    got = extract.main_text(f"<body><div>{story}</div><section>{cards}</section></body>")
    assert got.count("story itself") == 16 and "Other story" not in got
    got = extract.main_text(f"<body><article>{story}</article><div>{story.replace('itself', 'goes on')}</div></body>")
    assert got.count("story itself") == 16 and got.count("story goes on") == 16


@pytest.mark.parametrize("tag", ["div class='layout has-sidebar'", "div class='site no-sidebar'", "div id='content-with-sidebar'",
                                 "section class='post ad-free'", "div class='sidebar-layout'"])
def test_op7_layout_wrappers_are_no_side_matter(tag):
    end = tag.split()[0]
    assert extract.main_text(f"<body><{tag}><article><p>x y</p></article><div class=sidebar>z</div></{end}></body>") == "x y"
    assert extract.main_text(f"<body><{tag}><p>x y</p></{end}></body>") == "x y"


# ----------------------------------------------------------------- op 10

def test_op10_inherits_from_the_nearest_directory(spark):
    rows = [("r/LICENSE", "Released under the MIT License."), ("r/a/b/x.txt", "plain text"), ("r/a/COPYING.md", "LICENSED under the Apache license, version 2.0!"),
            ("r/a/y.txt", "intro\nLicensed under CC BY-NC 4.0. And more text that follows the header of this file."), ("r/z.txt", None),
            ("q/LICENSE", "no license of any kind is stated here, at least none that we know of"), ("q/w", ""), (None, "x"), ("top", LONG),
            ("r/a/b/x.txt", "plain text")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("SCORE", F.lit(1))
    got = [tuple(r) for r in license.scan(df).select("path", "license", "origin", "license_path").collect()]
    want = [("r/LICENSE", "MIT", "own", None), ("r/a/COPYING.md", "Apache-2.0", "own", None), ("r/a/y.txt", "CC-BY-NC-4.0", "own", None),
            ("r/a/b/x.txt", "Apache-2.0", "inherited", "r/a/COPYING.md"), ("r/a/b/x.txt", "Apache-2.0", "inherited", "r/a/COPYING.md"),
            ("r/z.txt", "MIT", "inherited", "r/LICENSE"), ("q/LICENSE", None, None, None), ("q/w", None, None, None),
            (None, None, None, None), ("top", None, None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert license.scan(df.limit(0)).count() == 0


def brute_license(text, templates):
    """License and score of the most similar statement; every statement is compared."""
    rows, idf, other = license.template_weights(templates)
    best = (license.SIMILAR, None)
    text = text.lower()
    for s in [*re.split(r"\n|(?<=[.!?;])[ \t]+", text), *[text] * ("\n" in text)]:
        bag = collections.Counter(re.findall(license._WORDS, s))
        x = {w: n * idf.get(w, other) for w, n in bag.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        for i, (name, _) in enumerate(templates):
            c = round(sum(x.get(w, 0) * v for t, w, v in rows if t == i) / norm, 6) if norm else 0
            if c > best[0] or c == best[0] and (best[1] is None or name < best[1]):
                best = (c, name)
    return (best[1], best[0]) if best[1] else (None, None)


def test_op10_compares_statements_without_usual_license_words(spark):
    texts = ["Dedicated to the public domain.", "This file is dedicated to the public domain under Universal 1.0.",
             "This Source Code Form is subject to the terms of the MPL, v. 2.0.",
             "Permission is hereby granted,\nfree of charge, to any person obtaining a copy of this software",
             "the work is under version 3 of this", "subject 1.0b public 2.0dedicated domain", "universal domain, public domain",
             *(" ".join(t.lower().split()[k::2]) for _, t in license.ORACLE_TEMPLATES for k in (0, 1))]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {int(r.path): (r.license, r.score) for r in license.own_licenses(df, templates=license.ORACLE_TEMPLATES).collect()}
    assert [got[i][0] for i in range(4)] == ["CC0-1.0", "CC0-1.0", "MPL-2.0", "MIT"]
    for i, t in enumerate(texts):
        name, score = brute_license(t, license.ORACLE_TEMPLATES)
        assert got[i] == (name, score and pytest.approx(score, abs=2e-6)), t


def test_op10_names_usual_headers_and_license_files(spark):
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public "
           "License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.")
    mit = ("MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction")
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following "
           "conditions are met:")
    third = ("\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products "
             "derived from\n   this software without specific prior written permission.")
    cases = [("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("This work is licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
             ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL"), (gpl, "GPL-3.0"),
             (gpl.replace("version 3", "version 2"), "GPL-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), (mit, "MIT"),
             ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Preamble", "GPL-3.0"),
             (bsd, "BSD"), (bsd + third, "BSD-3-Clause"), ("SPDX-License-Identifier: Foo-9.9", None), ("mit", None), ("Zlib", None),
             ("The library of this town is open to the public on most days.", None)]
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(cases)], "path string, text string")
    got = {int(r.path): r.license for r in license.own_licenses(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(llm.ORACLE_SQL[name])
    cols, want = rel.columns, rel.fetchall()
    got = llm.QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(want, key=repr)


# -------------------------------------------------------------- pipeline

def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "minhash near-dedup", "mixing", "bpe encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF_SMALL))
        assert out.columns == docs.columns
        was, now = {r.doc_id: r for r in docs.collect()}, out.collect()
        assert all(was[r.doc_id] == r for r in now)
        if name == "minhash near-dedup":
            _, comp = brute_components({i: r.text for i, r in was.items()}, 5, 80)
            assert sorted(r.doc_id for r in now) == sorted(i for i, c in comp.items() if i == c)
        if name == "mixing":
            mixed = {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
            assert collections.Counter(r.doc_id for r in now) == {i: c for i, c in mixed.items() if c}
        elif name != "quality rules":
            assert len(now) > 0.8 * len(was)
        docs = out
    last = corpus_pipeline.encode(spark, docs, SF_SMALL).collect()
    assert len(last) == docs.count() and all(r.round_trip for r in last)


def test_pipeline_edge_rows(spark):
    rows = [(i, t, "en", s, 1) for i, t, s in EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF_SMALL)
            assert out.count() <= 3 * len(rows)


def test_op1_large_bucket_in_blocks(spark, monkeypatch):
    """Members outside the largest component are compared in blocks."""
    rng = np.random.default_rng(9)
    base = [f"w{n}" for n in rng.integers(0, 400, 60)]
    rows = []
    for i in range(150):  # copies of a text with up to a third of the words replaced
        words = list(base)
        for j in rng.choice(60, int(rng.integers(0, 18)), replace=False):
            words[j] = f"r{rng.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(minhash, "LISTED", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, comp = brute_components(dict(rows), 2, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=2, percent=80).collect()}
    assert got == comp and 1 < len(set(comp.values())) < 150
