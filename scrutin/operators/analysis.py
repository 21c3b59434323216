"""Tokens, postings, term vectors and corpus statistics.

Partitioning. Bodies are cut into chunks of about ``CHUNK_CHARS``
characters that end at whitespace (no token is cut, however long), and the chunks —
not whole documents — are hash-partitioned by (ID, chunk). One enormous
document (an unallocated-space blob may hold a third of all text) is
therefore tokenised by many tasks. Global token positions and character
offsets are the chunk's base (a running sum over the small per-chunk
summary table: one row per chunk) plus the position inside the chunk.
Term vectors aggregate map-side before their (ID, term) shuffle; term
statistics aggregate map-side before their term shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN_START_RE, is_term, pieces_of, tokens_of
from ..session import BROADCAST_MAX_ROWS, bounded_broadcast, tasks_for

CHUNK_CHARS = 1 << 16
#: Bytes of a postings table that one task counts; of texts whose pieces, gaps
#: too, one task sorts.
TASK_POSTINGS, TASK_PIECES = 8 << 20, 4 << 20


def chunk_pattern(chunk_chars: int = CHUNK_CHARS) -> str:
    """Lossless cut into pieces of about ``chunk_chars`` characters that end
    after a whitespace, '!' or '?', never inside a token; a longer run without
    any of them is one piece up to its end."""
    return (rf"(?s).{{1,{chunk_chars}}}(?:[\s!?]|\z)"
            rf"|(?s).{{{chunk_chars}}}[^\s!?]*+(?:[\s!?]|\z)|(?s).+")


def chunks_of(body: Column, chunk_chars: int, pattern: str) -> Column:
    """The chunks of a text; one that fits a chunk is taken as it is."""
    cut = F.regexp_extract_all(body, F.lit(pattern), 0)
    return F.when((F.length(body) > 0) & (F.length(body) <= chunk_chars), F.array(body)).otherwise(cut)


def by_document(docs: DataFrame, num_partitions: int | None = None,
                chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(ID, multi, chunk, text) — bodies cut into chunks and spread over
    tasks by (ID, chunk): the only shuffle of the text. ``multi`` marks
    documents longer than one chunk (only those need chunk bases)."""
    n = num_partitions or tasks_for(docs)
    ch = docs.select("ID", (F.length("body") > chunk_chars).alias("multi"), F.posexplode(
        chunks_of(F.col("body"), chunk_chars, chunk_pattern(chunk_chars))).alias("chunk", "text"))
    return ch.repartition(n, "ID", "chunk")


CHUNK_GROUP = 4096


def chunk_bases(summary: DataFrame, *cols: str) -> DataFrame:
    """Exclusive running sums of per-chunk counts within each document:
    (ID, chunk, base_<col>…). Input has one row per chunk of a multi-chunk
    document. Two levels, so even a document with millions of chunks is not
    one task: running sums inside groups of ``CHUNK_GROUP`` chunks, plus the
    running sum of the group totals (one row per group)."""
    g = (F.col("chunk") / CHUNK_GROUP).cast("long")
    s = summary.withColumn("grp", g)
    inner = Window.partitionBy("ID", "grp").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = s.select("ID", "chunk", "grp", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"l_{c}")
                                             for c in cols])
    totals = s.groupBy("ID", "grp").agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    outer = Window.partitionBy("ID").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    gbase = totals.select("ID", "grp", *[F.coalesce(F.sum(f"t_{c}").over(outer), F.lit(0)).alias(f"g_{c}")
                                         for c in cols])
    return local.join(gbase, ["ID", "grp"]).select(
        "ID", "chunk", *[(F.col(f"g_{c}") + F.col(f"l_{c}")).cast("long").alias(f"base_{c}") for c in cols])


def _add_bases(local: DataFrame, summary_aggs: dict, out_cols) -> DataFrame:
    """Rows of multi-chunk documents joined with their chunk bases (the
    exclusive running sums of ``summary_aggs`` per document). The base
    table has one row per chunk; a shuffled hash join keeps the token rows
    in their (ID, chunk) partitions without sorting them."""
    summary = local.groupBy("ID", "chunk").agg(*[e.alias(k) for k, e in summary_aggs.items()])
    bases = chunk_bases(summary, *summary_aggs)
    return local.join(bases.hint("shuffle_hash"), ["ID", "chunk"], "left").select(*out_cols)


def raw_tokens(chunks: DataFrame) -> DataFrame:
    """(ID, pos, term) for every token, stop words included; ``pos`` is
    the position in the whole body. An overlong token holds its position but is
    no term. Documents within one chunk (the usual
    case) need no base; longer ones add their chunk's token base."""
    local = chunks.select("ID", "chunk", "multi", F.posexplode(tokens_of(F.col("text"))).alias("p", "term"))
    single = local.where(~F.col("multi")).select("ID", F.col("p").alias("pos"), "term")
    multi = _add_bases(local.where(F.col("multi")), {"n": F.max("p") + 1}, [
        "ID", (F.coalesce("base_n", F.lit(0)) + F.col("p")).cast("int").alias("pos"), "term"])
    return single.unionByName(multi).where(is_term(F.col("term")))


def remove_stops(tokens: DataFrame, stops: DataFrame) -> DataFrame:
    """Drop stop terms; positions keep their gaps."""
    return tokens.join(bounded_broadcast(stops), "term", "left_anti")


def _literal_terms(spark, terms) -> DataFrame:
    from ..session import literal_frame
    return literal_frame(spark, sorted(terms), "term")


def tokens(docs: DataFrame, stops: DataFrame) -> DataFrame:
    """(ID, term, pos) after stop-word removal."""
    return remove_stops(raw_tokens(docs), stops).select("ID", "term", "pos")


def postings_with_offsets(chunks: DataFrame, stops: DataFrame) -> DataFrame:
    """(ID, term, pos, start, end) with character offsets into ``body``.

    Each chunk is split losslessly into token and gap pieces; a running sum
    of piece lengths inside the chunk (a window over (ID, chunk), which the
    input is partitioned by) gives local offsets. Multi-chunk documents add
    their chunk's base character offset and token count.
    """
    w = Window.partitionBy("ID", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    is_tok = F.col("piece").rlike(TOKEN_START_RE)

    def located(ch):
        pieces = ch.select("ID", "chunk", F.posexplode(pieces_of(F.col("text"))).alias("k", "piece"))
        return pieces.select(
            "ID", "chunk", "piece", is_tok.alias("is_tok"),
            F.sum(F.length("piece")).over(w).alias("end"),
            F.sum(is_tok.cast("int")).over(w).alias("ntok"))

    def out(base_chars, base_toks):
        return ["ID", F.lower("piece").alias("term"),
                (base_toks + F.col("ntok") - 1).cast("int").alias("pos"),
                (base_chars + F.col("end") - F.length("piece")).cast("int").alias("start"),
                (base_chars + F.col("end")).cast("int").alias("end")]

    # filter on the chunks, before the windows, so each text is split once
    single = located(chunks.where(~F.col("multi"))).where("is_tok").select(*out(F.lit(0), F.lit(0)))
    multi = _add_bases(
        located(chunks.where(F.col("multi"))), {"chars": F.max("end"), "toks": F.max("ntok")},
        ["ID", "piece", "is_tok", "end", "ntok", "base_chars", "base_toks"])
    multi = multi.where("is_tok").select(*out(F.coalesce("base_chars", F.lit(0)),
                                              F.coalesce("base_toks", F.lit(0))))
    return remove_stops(single.unionByName(multi).where(is_term(F.col("term"))), stops).select(
        "ID", "term", "pos", "start", "end")


def doc_terms(toks: DataFrame) -> DataFrame:
    """C4: term vector (ID, term, tf)."""
    return toks.groupBy("ID", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_vectors(postings: DataFrame, long_docs: DataFrame) -> DataFrame:
    """(ID, term, tf, length) of the documents with an ID. The postings
    of a document are dealt by ID, so its terms are counted and its length is
    added where they lie; ``long_docs`` (ID) are dealt by (ID, term)."""
    rows, n = postings.select("ID", "term").where(F.col("ID").isNotNull()), tasks_for(postings, TASK_POSTINGS)
    long_docs = long_docs.select("ID").distinct()
    n_long = long_docs.limit(BROADCAST_MAX_ROWS + 1).count()
    few = F.broadcast if n_long <= BROADCAST_MAX_ROWS else (lambda df: df)
    long_docs = few(long_docs)
    lengths = postings.select("ID").groupBy("ID").agg(F.count(F.lit(1)).alias("length")).repartition(n, "ID")
    short = doc_terms(rows.join(long_docs, "ID", "left_anti").repartition(n, "ID")).join(lengths.hint("shuffle_hash"), "ID")
    if not n_long:
        return short
    longer = rows.join(long_docs, "ID", "left_semi")
    theirs = few(longer.groupBy("ID").agg(F.count(F.lit(1)).alias("length")))
    return short.unionByName(doc_terms(longer).join(theirs, "ID"))


def term_stats(dterms: DataFrame) -> DataFrame:
    """(term, df, ttf) — partial aggregation before the term shuffle,
    so a term that fills a third of the corpus costs one row per task."""
    return dterms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def doc_stats(dterms: DataFrame) -> DataFrame:
    """C9 and the term-vector moments hit ranking needs:
    (ID, length = tokens after stops, sum_tf2, n_terms)."""
    return dterms.groupBy("ID").agg(
        F.sum("tf").alias("length"),
        F.sum(F.col("tf") * F.col("tf")).alias("sum_tf2"),
        F.count(F.lit(1)).alias("n_terms"))


def corpus_stats(docs: DataFrame, tstats: DataFrame) -> DataFrame:
    """One row — documents, distinct terms and corpus token count.
    Both inputs are reduced in one aggregation over their union (no join)."""
    d = docs.select(F.lit(1).alias("d"), F.lit(0).alias("t"), F.lit(0).cast("long").alias("n"))
    t = tstats.select(F.lit(0).alias("d"), F.lit(1).alias("t"), F.col("ttf").cast("long").alias("n"))
    return d.unionByName(t).agg(
        F.sum("d").cast("long").alias("num_docs"),
        F.sum("t").cast("long").alias("num_terms"),
        F.sum("n").cast("long").alias("num_tokens"))
