"""Dictionary index: the same terms as a scan, from a small share of it."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL

from scrutin.operators import patterns as P
from scrutin.operators import query as Q
from scrutin.plans.index import index_for

CLAUSES = [Q.Wildcard(pattern="*tion"), Q.Wildcard(pattern="*a?edble*"), Q.Wildcard(pattern="?h*n*"), Q.Wildcard(pattern="*"),
           Q.Wildcard(pattern=""), Q.Wildcard(pattern="de"), Q.Wildcard(pattern="a.b*"), Q.Regexp(regex=".*tion.*ed"),
           Q.Regexp(regex="[a-z]+(ing|ed)st"), Q.Regexp(regex="(th)+at[a-z]*"), Q.Regexp(regex="th?an.*"),
           Q.Regexp(regex="from"), Q.Regexp(regex="(?:the)?re"), Q.Regexp(regex="a{2,}b|the"), Q.Regexp(regex="[^a]*"),
           Q.Regexp(regex=r"\w+\.example\.com"), Q.Prefix(prefix="t"), Q.Prefix(prefix="ti"), Q.Prefix(prefix=""),
           *[Q.Fuzzy(term=t, max_edits=k) for t in ("from", "thatere", "a", "", "tionandly", "zzzz", "aaaaaaaaa") for k in (0, 1, 2)],
           Q.Fuzzy(term="thatere", max_edits=3), Q.Fuzzy(term="thatereandtion", max_edits=4)]


@pytest.mark.parametrize("clause", CLAUSES, ids=str)
def test_looked_up_terms_are_those_of_a_scan(spark, clause):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    want = {r["term"] for r in ctx.index.term_stats.where(clause.predicate()).select("term").collect()}
    rows = [r["term"] for r in clause.expand(ctx).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    ids = {r["ID"] for r in clause.scores(ctx, 1.0).collect()}
    assert ids == {r["ID"] for r in ctx.index.doc_terms.where(clause.predicate()).collect()}


@pytest.mark.parametrize("clause, share", [(Q.Wildcard(pattern="*tion"), .2), (Q.Regexp(regex=".*dble.*"), .2),
                                           (Q.Fuzzy(term="tionandly", max_edits=2), .2)], ids=str)
def test_a_small_share_of_the_dictionary_is_read(spark, clause, share):
    ix = index_for(spark, SF_SMALL)
    found = clause.candidates(ix)
    plan = clause.expand(Q.Context(ix))._jdf.queryExecution().executedPlan().toString()
    assert ("In(gram" in plan or "EqualTo(gram" in plan or "In(key" in plan) and "/term_stats" not in plan
    assert 0 < found.count() <= share * ix.term_stats.count()


WORD = st.text("abc", max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORD, st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.sampled_from("abcd")), max_size=2))
def test_near_words_share_a_key(word, edits):
    other = word
    for kind, at, c in edits:
        at = min(at, len(other))
        other = other[:at] + ("" if kind == 0 else c) + other[at + (kind != 1):]
    assert set(P.delete_keys(word, 2)) & set(P.delete_keys(other, 2))
    assert set(P.delete_keys(word, len(edits))) & set(P.delete_keys(other, 2))


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=14), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 14), st.sampled_from("abc")), max_size=2))
def test_near_words_share_trigrams_or_are_short(word, edits):
    other = word
    for kind, at, c in edits:
        at = min(at, len(other))
        other = other[:at] + ("" if kind == 0 else c) + other[at + (kind != 1):]
    grams = lambda w: {(P.BEGIN + w + P.END)[i:i + 3] for i in range(len(w))}
    left = len(grams(word)) - 3 * len(edits)
    assert len(grams(word) & grams(other)) >= left
    if left < 1 and len(word) <= P.SHORT:
        assert len(other) <= P.SHORT_NEIGHBOUR


def test_keys_of_table_and_query_agree(spark):
    words = ["", "a", "ab", "aba", "abcdefgh", "é🙂x", "abcdefghi"]
    got = {}
    for r in P.delete_table(spark.createDataFrame([(w,) for w in words], "term string")).collect():
        got.setdefault(r["term"], []).append(r["key"])
    assert {w: sorted(k) for w, k in got.items()} == {w: P.delete_keys(w, P.EDITS) for w in words[:-1]}
    grams = {(r["gram"], r["term"]) for r in P.gram_table(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    marked = {w: P.BEGIN + w + P.END for w in words if w}
    assert grams == {(m[i:i + 3], w) for w, m in marked.items() for i in range(len(m) - 2)}


def test_literals_of_expressions_hold_in_every_match():
    rng = random.Random(2)
    atoms = ["ab", "c", "(a|b)", "(?:bc)", "[ab]", "a*", "(bc)+", "b{2}", "(?:ab)?", ".", "(a(bc))", "c+?"]
    words = ["".join(w) for n in range(6) for w in itertools.product("abc", repeat=n)]
    for _ in range(300):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 4)))
        prefix, runs = P.regex_parts(pattern)
        for w in words:
            if re.fullmatch(pattern, w):
                assert w.startswith(prefix) and all(r in w for r in runs), (pattern, prefix, runs, w)
    assert P.regex_parts("(?i)abc") == ("", []) and P.regex_parts("[a&&b]cde") == ("", [])
    assert P.regex_parts("abc") == ("abc", ["abc"]) and P.regex_parts("a(") == ("", [])
