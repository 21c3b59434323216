"""Plan checks: pushdown, pruning, broadcast of query-sized sides, no
cartesian products on document-sized inputs."""

from conftest import SF_SMALL

from scrutin.catalog import FLAGSHIP_TERMS, REF_DATE_MS
from scrutin.operators import hits as H
from scrutin.operators import query as Q
from scrutin.operators import rank as R
from scrutin.plans.index import index_for


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_filter_reaches_the_scan(spark):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    plan = _plan(R.search(ctx, Q.Terms(FLAGSHIP_TERMS)))
    assert "In(term, [des,from,tion])" in plan and "PushedFilters" in plan
    assert "CartesianProduct" not in plan
    # field lengths travel with the term vectors: no per-query document join
    assert "/doc_stats" not in plan


def test_files_view_does_not_read_bodies(spark):
    ix = index_for(spark, SF_SMALL)
    ctx = Q.Context(ix)
    plan = _plan(R.files_view(R.search(ctx, Q.Terms(FLAGSHIP_TERMS)), ix.docs, None))
    for line in plan.splitlines():
        if "ReadSchema" in line and "/docs" in line:
            assert "body:" not in line


def test_hit_plan_has_no_cartesian_product(spark):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    h = H.rank_hits(ctx, Q.Terms(FLAGSHIP_TERMS), REF_DATE_MS)
    plan = _plan(h)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tokenising_shuffles_text_once_and_never_sorts_tokens_for_joins(spark):
    from scrutin.operators import analysis as A
    from scrutin.sources.stoplist import stop_list
    from scrutin.sources.tables import evidence_docs
    dt = A.doc_terms(A.tokens(A.by_document(evidence_docs(spark, SF_SMALL)), stop_list(spark)))
    plan = _plan(dt)
    # the text moves by (ID, chunk): single- and multi-chunk documents take
    # disjoint branches; the multi-chunk summary reuses its branch's exchange
    assert plan.count("REPARTITION_BY_NUM") == 2
    # term vectors: one (ID, term) exchange after partial aggregation
    assert plan.count("Exchange hashpartitioning(ID") >= 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_prefix_and_wildcard_prefix_reach_the_scan(spark):
    ctx = Q.Context(index_for(spark, SF_SMALL))
    assert "StringStartsWith(term,tion)" in _plan(R.search(ctx, Q.Prefix(prefix="tion")))
    assert "StringStartsWith(term,an)" in _plan(R.search(ctx, Q.Wildcard(pattern="an?a*")))
