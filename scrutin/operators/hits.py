"""Rank individual sentence hits with the 19-feature linear model.

A hit is one sentence of a matching document that contains at least one query
term. The index knows the sentence of every posting and keeps a table of
sentences, so ranking reads the postings of the query's terms, groups them to
hit sentences and fetches only those sentences' text, for the offsets of the
matches and the snippet; bodies are not read. Hit rows are joined and scanned
by (document, chunk of ``CHUNK_SENTENCES`` sentences), never by document alone:
document values are copied to the chunks, boundaries run within chunks plus
per-chunk carries, so no document — however large — is a single task.

Query-sized values (the query's terms and their statistics) are fetched as a
few rows and used as literals; the per-class score range (two rows, one per
allocation class) is joined back with a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import DOT_MASK, SENTENCE_END, SENTENCE_RE, TOKEN_DOT_RE, TOKEN_OR_GAP_RE
from ..functions.text import html_escape, in_system_dir, is_term, tokens_of
from ..session import bounded_broadcast, tasks_for
from . import query as Q
from .analysis import CHUNK_CHARS, _add_bases, chunks_of, remove_stops

# Above this many query terms the literal forms give way to joins.
LITERAL_TERMS_MAX = 5000
#: Sentences of a document that are joined and scanned together.
CHUNK_SENTENCES = 4096


@dataclass
class QueryTermStats:
    """The query's term set and its statistics.

    ``table`` holds (term, tfidf, term_len) for the query terms found in the
    index; the scalars are one aggregated row. ``terms`` is the literal term
    list, kept only when the set is small enough for literal expressions."""
    table: DataFrame
    all_terms: DataFrame          # (term, term_chars) of all query terms
    n: int                        # |termSet| (all query terms)
    max_tfidf: float              # max of -ln(ttf/tokens)·ln(N/(1+df)), floor 0
    max_len: int                  # longest query term in UTF-8 bytes
    terms: list[str] | None       # all query terms when n <= LITERAL_TERMS_MAX
    present: list[str] | None     # indexed query terms when n <= LITERAL_TERMS_MAX


def term_weight(ttf: Column, df: Column, tokens: int, num_docs: int) -> Column:
    """F8: ``-ln(ttf/tokens) · ln(N/(1+df))``; null for terms not in the index."""
    return F.when(ttf > 0, -F.ln(ttf / F.lit(float(max(tokens, 1))))
                  * F.ln(F.lit(float(num_docs)) / (F.lit(1.0) + df)))


def date_difference(seconds: Column, ref_date_ms: int) -> Column:
    """``|t − ref| / ref`` with t in milliseconds."""
    return F.abs(seconds * 1000 - F.lit(ref_date_ms)) / F.lit(float(ref_date_ms))


def query_term_stats(ctx: Q.Context, qterms: DataFrame) -> QueryTermStats:
    num_docs, _, tokens = ctx.index.corpus_row()
    qterms = qterms.select("term").distinct()
    t = (qterms.join(ctx.index.term_stats, "term", "left")
         .select("term", F.octet_length("term").alias("term_len"),
                 term_weight(F.col("ttf"), F.col("df"), tokens, num_docs).alias("tfidf")))
    rows = t.limit(LITERAL_TERMS_MAX + 1).collect()
    table = t.where(F.col("tfidf").isNotNull())
    every = qterms.select("term", F.length("term").alias("term_chars"))
    if len(rows) <= LITERAL_TERMS_MAX:
        tf = [r["tfidf"] for r in rows if r["tfidf"] is not None]
        return QueryTermStats(
            table, every, len(rows), max([0.0] + tf), max([0] + [int(r["term_len"]) for r in rows]),
            sorted(r["term"] for r in rows), sorted(r["term"] for r in rows if r["tfidf"] is not None))
    agg = t.agg(F.count(F.lit(1)).alias("n"),
                F.greatest(F.lit(0.0), F.coalesce(F.max("tfidf"), F.lit(0.0))).alias("max_tfidf"),
                F.coalesce(F.max("term_len"), F.lit(0)).alias("max_len")).first()
    return QueryTermStats(table, every, int(agg["n"]), float(agg["max_tfidf"]), int(agg["max_len"]), None, None)


def sentence_chunk_pattern(chunk_chars: int) -> str:
    """Lossless cut into pieces of about ``chunk_chars`` characters that end
    where a sentence ends (after a maximal run of terminators), so sentences
    never cross a chunk; a longer run without any end is one piece up to the
    end of its sentence."""
    c, end = chunk_chars, SENTENCE_END + r"(?![.!?\n])"
    return rf"(?s).{{1,{c}}}\z|(?s).{{1,{c}}}{end}|(?s).{{{c}}}.*?{end}|(?s).+"


def sentence_chunks(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(ID, multi, chunk, text) spread over tasks by (ID, chunk)."""
    ch = docs.select("ID", (F.length("body") > chunk_chars).alias("multi"), F.posexplode(
        chunks_of(F.col("body"), chunk_chars, sentence_chunk_pattern(chunk_chars))).alias("chunk", "text"))
    return ch.repartition(tasks_for(docs), "ID", "chunk")


def sentences(chunks: DataFrame) -> DataFrame:
    """(ID, chunk, s_idx, sentence, s_start, s_end, first_pos) — lossless
    sentence pieces with their index and offsets in the whole body, and the
    position of their first token (no token crosses the end of a sentence).
    Running sums inside each chunk give local values; documents longer than
    one chunk add the chunk's bases."""
    w = Window.partitionBy("ID", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)

    def local(ch):
        # the text itself goes along only where it already holds the mask; that
        # is seen once a chunk, before the text is exploded to its sentences
        own = F.when(F.contains(F.col("text"), F.lit(DOT_MASK)), F.col("text"))
        masked = F.regexp_replace("text", TOKEN_DOT_RE, DOT_MASK)
        s = ch.select("ID", "chunk", own.alias("own"), F.regexp_extract_all(masked, F.lit(SENTENCE_RE), 0).alias("pieces"))
        s = s.select("ID", "chunk", "own", F.posexplode("pieces").alias("k", "piece"))
        s = s.withColumn("le", F.sum(F.length("piece")).over(w))
        taken = F.substring("own", F.col("le") - F.length("piece") + 1, F.length("piece"))
        s = s.withColumn("sentence", F.when(F.col("own").isNull(), F.replace("piece", F.lit(DOT_MASK), F.lit(".")))
                         .otherwise(taken)).drop("own", "piece")
        n = F.size(tokens_of(F.col("sentence")))
        return s.withColumn("n_tok", n).withColumn("toks", F.sum("n_tok").over(w))

    def out(base_chars, base_sents, base_toks):
        return ["ID", "chunk", (base_sents + F.col("k")).cast("int").alias("s_idx"), "sentence",
                (base_chars + F.col("le") - F.length("sentence")).cast("long").alias("s_start"),
                (base_chars + F.col("le")).cast("long").alias("s_end"),
                (base_toks + F.col("toks") - F.col("n_tok")).cast("int").alias("first_pos")]

    # the multi-chunk filter is applied to the chunks, before any window,
    # so each document's text is split by exactly one of the branches
    single = local(chunks.where(~F.col("multi"))).select(*out(F.lit(0), F.lit(0), F.lit(0)))
    multi = _add_bases(local(chunks.where(F.col("multi"))),
                       {"chars": F.max("le"), "sents": F.max("k") + 1, "toks": F.max("toks")},
                       ["ID", "chunk", "k", "sentence", "le", "n_tok", "toks", "base_chars", "base_sents", "base_toks"])
    multi = multi.select(*out(*[F.coalesce(f"base_{c}", F.lit(0)) for c in ("chars", "sents", "toks")]))
    return single.unionByName(multi)


def sentence_table(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The index table of sentences: (ID, s_idx, s_start, s_end, first_pos, sentence)."""
    return sentences(sentence_chunks(docs.select("ID", "body"), chunk_chars)).select(
        "ID", "s_idx", "s_start", "s_end", "first_pos", "sentence")


def dealt_sentences(sents: DataFrame) -> DataFrame:
    """Sentences over as many tasks as their size asks for, the sentences of a
    chunk together: what their tokens take to sort stays within a task."""
    return sents.repartition(tasks_for(sents), F.col("ID"), F.floor(F.col("s_idx") / CHUNK_SENTENCES))


def sentence_tokens(sents: DataFrame, stops: DataFrame) -> DataFrame:
    """(ID, term, pos, s_idx): the postings of the sentences, stop words removed."""
    toks = sents.select("ID", "s_idx", "first_pos", F.posexplode(tokens_of(F.col("sentence"))).alias("k", "term"))
    return remove_stops(toks.where(is_term(F.col("term"))), stops).select("ID", "term", (F.col("first_pos") + F.col("k")).alias("pos"), "s_idx")


def matches(postings: DataFrame, stats: QueryTermStats) -> DataFrame:
    """(ID, s_idx, term, tfidf, term_len) per occurrence of an indexed
    query term; a small term set is a filter that reaches the files."""
    if stats.present is not None:
        postings = postings.where(F.col("term").isin(stats.present) if stats.present else F.lit(False))
        return postings.select("ID", "s_idx", "term").join(F.broadcast(stats.table), "term")  # LITERAL_TERMS_MAX rows
    return postings.select("ID", "s_idx", "term").join(bounded_broadcast(stats.table), "term")


def hit_sentences(m: DataFrame) -> DataFrame:
    """F3/F18/F21 per hit sentence: distinct term set, highest tf-idf and byte
    length among its terms. Partial aggregation runs before the shuffle."""
    return m.groupBy("ID", "s_idx").agg(
        F.sort_array(F.collect_set("term")).alias("terms"), F.greatest(F.lit(0.0), F.max("tfidf")).alias("max_hit_tfidf"),
        F.max("term_len").alias("max_hit_len"))


def holding(sents: DataFrame, stats: QueryTermStats) -> DataFrame:
    """The sentences that can be hit: a term of a sentence is a part of its
    lower-cased text. Only they need to meet their postings; tokens decide."""
    if stats.present is None or len(stats.present) > Q.PLAIN_TERMS:
        return sents
    text = F.lower("sentence")
    held = F.lit(False)
    for t in stats.present:
        held = held | F.contains(text, F.lit(t))
    return sents.where(held)


def passages(hits: DataFrame, sents: DataFrame) -> DataFrame:
    """hit sentences with their place, the first and last match and
    the highlighted snippet. A sentence is split in its row: its pieces are an
    array, and no row, sort or window is made of them."""
    n = tasks_for(sents)
    h = hits.repartition(n, "ID", "s_idx").join(sents.drop("first_pos").repartition(n, "ID", "s_idx"), ["ID", "s_idx"])
    per = h.groupBy("ID", "s_idx").agg(
        *[F.first(c).alias(c) for c in ("s_start", "s_end", "sentence", "terms", "max_hit_tfidf", "max_hit_len")],
        F.count(F.lit(1)).alias("copies"))
    split = F.regexp_extract_all("sentence", F.lit(TOKEN_OR_GAP_RE), 0)
    # a sentence of a repeated document is read as often as it comes
    again = F.flatten(F.transform(split, lambda p: F.array_repeat(p, F.col("copies").cast("int"))))
    per = per.withColumn("pieces", F.when(F.col("copies") > 1, again).otherwise(split))
    # every token of the sentence that is a query term is among its terms
    per = per.withColumn("found", F.transform("pieces", lambda p: F.array_contains("terms", F.lower(p))))
    first = F.array_position("found", True)
    last = F.size("found") - F.array_position(F.reverse("found"), True) + 1
    per = per.where(first > 0)

    def before(at):
        return F.length(F.array_join(F.slice("pieces", F.lit(1), (at - 1).cast("int")), "")).cast("long")

    return per.select(
        "ID", "s_idx", "s_start", "s_end", "terms", "max_hit_tfidf", "max_hit_len",
        (F.col("s_start") + before(first)).alias("first_match"), (F.col("s_start") + before(last)).alias("last_match"),
        F.when(F.col("copies") == 1, highlighted(F.col("pieces"), F.col("found")))
        .otherwise(snippet(F.col("sentence"), matched_places(F.col("pieces"), F.col("found")))).alias("snippet"))


def highlighted(pieces: Column, found: Column) -> Column:
    """the pieces of a sentence joined, HTML-escaped, every match wrapped in
    the highlight span."""
    def part(p, hit):
        return F.when(hit, F.concat(F.lit(K.HIGHLIGHT_OPEN), html_escape(p), F.lit(K.HIGHLIGHT_CLOSE))).otherwise(html_escape(p))
    return F.array_join(F.zip_with(pieces, found, part), "")


def matched_places(pieces: Column, found: Column) -> Column:
    """Begins and ends of the found pieces, in the pieces joined."""
    none = F.array().cast("array<struct<rel_start:int,rel_end:int>>")

    def step(acc, x):
        end = acc["at"] + F.length(x["p"])
        place = F.struct(acc["at"].alias("rel_start"), end.alias("rel_end"))
        return F.struct(end.alias("at"), F.when(x["hit"], F.concat(acc["ms"], F.array(place))).otherwise(acc["ms"]).alias("ms"))

    each = F.zip_with(pieces, found, lambda p, hit: F.struct(p.alias("p"), hit.alias("hit")))
    return F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("ms")), step, lambda acc: acc["ms"])


def term_frequencies(doc_terms: DataFrame, stats: QueryTermStats) -> DataFrame:
    """F17 and the query-term parts of F15/F16 per document, from the term
    vectors: dot (Σtf), present, max_doc_tf, and the tf of each query term."""
    if stats.present is not None:
        dt = doc_terms.where(F.col("term").isin(stats.present) if stats.present else F.lit(False))
    else:
        dt = doc_terms.join(bounded_broadcast(stats.table.select("term")), "term", "left_semi")
    return dt.groupBy("ID").agg(
        F.sum("tf").alias("dot"), F.count(F.lit(1)).alias("present"), F.max("tf").alias("max_doc_tf"),
        F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))


def by_chunk(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hit rows with the values of their document, joined by (ID, chunk):
    each document's row is copied to its chunks that have hits, of which there
    is one per ``CHUNK_SENTENCES`` sentences."""
    hits = hits.withColumn("chunk", F.floor(F.col("s_idx") / CHUNK_SENTENCES).cast("int"))
    chunks = hits.select("ID", "chunk").distinct()
    return hits.join(docs.join(chunks, "ID"), ["ID", "chunk"])


def snippet(sentence: Column, ms: Column) -> Column:
    """the sentence with every match wrapped in the highlight span,
    HTML-escaped; built as an array of parts joined once (linear)."""
    def part(mt, i):
        prev_end = F.when(i == 0, F.lit(0)).otherwise(F.element_at(ms, i)["rel_end"])
        gap = F.substring(sentence, prev_end + 1, mt["rel_start"] - prev_end)
        word = F.substring(sentence, mt["rel_start"] + 1, mt["rel_end"] - mt["rel_start"])
        return F.concat(html_escape(gap), F.lit(K.HIGHLIGHT_OPEN), html_escape(word),
                        F.lit(K.HIGHLIGHT_CLOSE))
    tail = F.substring(sentence, F.element_at(ms, -1)["rel_end"] + 1, 1 << 30)
    return F.concat(F.array_join(F.transform(ms, part), ""), html_escape(tail))


def boundaries(p: DataFrame, body_len: Column) -> DataFrame:
    """Nearest term boundary before and after each hit sentence.

    ``b_i``: hit sentences i and i+1 differ in term set or either has more
    than one term. Next boundary = first match of sentence j+1 for the first
    j ≥ i with b_j; previous = last match of the last j < i with b_j. Match
    offsets grow with the sentence index, so both are running min / max.

    Two levels, so a document with a huge number of hit sentences is not one
    task: windows run within (ID, chunk); a summary of one row per chunk is
    scanned by document and supplies the neighbour across a chunk edge and the
    carries from earlier and later chunks.
    """
    if "chunk" not in p.columns:
        p = p.withColumn("chunk", F.lit(0))
    sets = F.struct(F.size("terms").alias("n"), F.array_join("terms", "\u0001").alias("key"), F.col("first_match").alias("first"))
    wc = Window.partitionBy("ID", "chunk").orderBy("s_idx")
    p = p.withColumn("me", sets).withColumn("nxt", F.lead("me").over(wc))

    def differ(a, b):
        return F.coalesce((a["n"] > 1) | (b["n"] > 1) | (a["key"] != b["key"]), F.lit(False))

    # boundaries between sentences of one chunk; the last one's is open
    p = p.withColumn("b", differ(F.col("me"), F.col("nxt")))
    cs = p.groupBy("ID", "chunk").agg(
        F.min_by("me", "s_idx").alias("head"), F.max_by("me", "s_idx").alias("tail"),
        F.max("last_match").alias("tail_match"), F.min(F.when(F.col("b"), F.col("nxt.first"))).alias("in_next"),
        F.max(F.when(F.col("b"), F.col("last_match"))).alias("in_prev"))
    wd = Window.partitionBy("ID").orderBy("chunk")
    cs = cs.withColumn("after", F.lead("head").over(wd))
    cs = cs.withColumn("edge", differ(F.col("tail"), F.col("after")))
    # least and greatest skip nulls
    cs = (cs.withColumn("c_next", F.least("in_next", F.when(F.col("edge"), F.col("after.first"))))
            .withColumn("c_prev", F.greatest("in_prev", F.when(F.col("edge"), F.col("tail_match")))))
    later = Window.partitionBy("ID").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cs = cs.select("ID", "chunk", "edge", F.col("after.first").alias("after_first"), F.min("c_next").over(later).alias("carry_next"),
                   F.max("c_prev").over(wd.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_prev"))
    p = p.join(cs, ["ID", "chunk"], "left")
    last = F.col("nxt").isNull()
    # within the chunk: suffix minimum as a running minimum in descending
    # order, prefix maximum excluding the row — linear frames only
    fwd = Window.partitionBy("ID", "chunk").orderBy(F.col("s_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(last & F.col("edge"), F.col("after_first")).when(F.col("b"), F.col("nxt.first"))
    p = (p.withColumn("next_first", F.coalesce(F.min(opens).over(fwd), F.col("carry_next")))
          .withColumn("prev_last", F.coalesce(F.max(F.when(F.col("b"), F.col("last_match"))).over(
              wc.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry_prev"))))
    dist = F.least(F.coalesce(F.col("first_match") - F.col("prev_last"), body_len),
                   F.coalesce(F.col("next_first") - F.col("first_match"), body_len))
    return p.withColumn("distance", dist).drop("me", "nxt", "b", "edge", "after_first", "carry_next", "carry_prev")


def doc_features(docs: DataFrame, doc_stats: DataFrame, stats: QueryTermStats, ref_date_ms: int) -> DataFrame:
    """F9–F14 per document, with its length and ``sum_tf2`` for F15 (the
    query-term parts of F15–F17 are :func:`term_frequencies`)."""
    d = docs.join(doc_stats.select("ID", "sum_tf2"), "ID")
    alloc = ~F.col("is_unallocated")

    def ddiff(c):
        return F.when(alloc, date_difference(F.col(c), ref_date_ms)).otherwise(F.lit(0.0))

    full_path = F.concat("path", "name")
    if stats.terms is not None:
        indirect = F.exists(F.array(*[F.lit(t) for t in stats.terms]) if stats.terms
                            else F.array().cast("array<string>"),
                            lambda t: F.instr(full_path, t) > 1)
    else:
        # a large expanded term set: the substrings of a path with the length
        # of some term (paths are short) are joined with the terms by equality
        lengths = sorted(r["term_chars"] for r in stats.all_terms.select("term_chars").distinct().collect())
        subs = d.select("ID", F.concat("path", "name").alias("fp")).select(
            "ID", "fp", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where(F.col("n") < F.length("fp"))
        subs = subs.select("ID", F.explode(F.transform(
            F.sequence(F.lit(2), F.length("fp") - F.col("n") + 1), lambda i: F.substring("fp", i, F.col("n")))).alias("term"))
        hit_ids = (subs.join(stats.all_terms, "term", "left_semi").select("ID").distinct()
                   .withColumn("_fi", F.lit(True)))
        d = d.join(hit_ids, "ID", "left")
        indirect = F.coalesce(F.col("_fi"), F.lit(False))
    low = F.lower("extension")
    high = low.isin(*K.HIGH_PRIORITY_TYPES)
    med = low.isin(*K.MED_PRIORITY_TYPES)
    return d.select(
        "ID", "is_unallocated", "sum_tf2", "body_len",
        ddiff("created").alias("f_created"), ddiff("modified").alias("f_modified"),
        ddiff("accessed").alias("f_accessed"),
        F.lit(0.0).alias("f_filename_direct"),
        F.when(alloc & indirect, F.lit(1.0)).otherwise(F.lit(0.0)).alias("f_filename_indirect"),
        F.when(alloc, in_system_dir(F.col("path")).cast("double")).otherwise(F.lit(0.0)).alias("f_system_dir"),
        F.when(high, 1.0).otherwise(0.0).alias("f_high_type"),
        F.when(med, 1.0).otherwise(0.0).alias("f_med_type"),
        F.when(high | med, 0.0).otherwise(1.0).alias("f_low_type"),
    ).withColumn("f_avg_recency", (F.col("f_created") + F.col("f_modified") + F.col("f_accessed")) / 3)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def hit_features(h: DataFrame, stats: QueryTermStats) -> DataFrame:
    """Per-hit features and the raw linear score of hit rows that
    carry their document's features."""
    tfs = F.col("tfs")
    h = h.withColumn("max_hit_tf", F.array_max(F.transform("terms", lambda t: F.element_at(tfs, t)))).drop("tfs")
    blen = F.when(F.col("body_len") == 0, F.lit(1)).otherwise(F.col("body_len")).cast("double")
    nq = float(stats.n) if stats.n else 1.0
    h = h.select(
        "*",
        (F.col("dot") / (F.sqrt("sum_tf2") + F.sqrt("present"))).alias("f_similarity"),
        (F.col("present") / F.lit(nq)).alias("f_term_cardinality"),
        _ratio(F.col("max_hit_tfidf"), F.lit(stats.max_tfidf)).alias("f_term_tfidf"),
        _ratio(F.col("max_hit_tf").cast("double"), F.col("max_doc_tf").cast("double")).alias("f_hit_frequency"),
        (F.col("distance") / blen).alias("f_proximity"),
        _ratio(F.col("max_hit_len").cast("double"), F.lit(float(stats.max_len))).alias("f_term_length"),
        F.lit(0.0).alias("f_term_priority"), F.lit(0.0).alias("f_unused"),
        (F.col("s_start") / blen).alias("f_hit_offset"))
    raw_a = sum(F.col("f_" + f) * F.lit(w) for f, w in zip(K.HIT_FEATURES, K.ALLOCATED_WEIGHTS))
    raw_u = sum(F.col("f_" + f) * F.lit(w) for f, w in zip(K.HIT_FEATURES, K.UNALLOCATED_WEIGHTS))
    return h.withColumn("raw_score", F.when(F.col("is_unallocated"), raw_u).otherwise(raw_a))


def score_ranges(h: DataFrame) -> DataFrame:
    """min, max and range of raw scores per allocation class."""
    return h.groupBy("is_unallocated").agg(
        F.min("raw_score").alias("min_score"), F.max("raw_score").alias("max_score")
    ).withColumn("score_range", F.col("max_score") - F.col("min_score"))


def normalize(h: DataFrame) -> DataFrame:
    """``10·(s − min)/(range or 1)`` within the hit's class. The range
    table has one row per class (two at most), so it is broadcast."""
    rng = F.broadcast(score_ranges(h))
    return h.join(rng, "is_unallocated").withColumn(
        "score", F.lit(10.0) * (F.col("raw_score") - F.col("min_score"))
        / F.when(F.col("score_range") == 0, F.lit(1.0)).otherwise(F.col("score_range")))


def rank_hits(ctx: Q.Context, q: Q.Clause, ref_date_ms: int,
              results: DataFrame | None = None, materialize_raw: bool = True,
              chunk_chars: int | None = None) -> DataFrame:
    """Every hit of the query with its features, raw and normalised score.

    Sentences and postings come from the index; with ``chunk_chars`` they are
    cut anew from the bodies, in chunks of that size. Hit rows with their
    snippets and document values are written to the shared folder once, as the
    boundary scan reads them twice, and the raw-scored hits once more, because
    the per-class range is a second pass.
    """
    from ..session import materialize, shuffles_dropped
    ix = ctx.index

    def keep(df):
        if not materialize_raw:
            return df
        with shuffles_dropped(ix.spark):
            return materialize(df, compression="zstd")

    results = results if results is not None else Q.evaluate(ctx, q)
    stats = query_term_stats(ctx, Q.query_terms(ctx, q))
    # written ids: the planner knows their size and broadcasts them if small
    ids = keep(results.select("ID"))
    docs = ix.docs.join(ids, "ID", "left_semi")
    if chunk_chars is None:
        sents, postings = ix.sentences.join(ids, "ID", "left_semi"), ix.postings
    else:
        from .analysis import _literal_terms
        sents = sentence_table(docs, chunk_chars)
        postings = sentence_tokens(sents, _literal_terms(ix.spark, ctx.stops))
    hits = hit_sentences(matches(postings, stats).join(ids, "ID", "left_semi"))
    dfeat = doc_features(docs.drop("body"), ix.doc_stats, stats, ref_date_ms).join(term_frequencies(ix.doc_terms, stats), "ID")
    p = keep(by_chunk(passages(hits, holding(sents, stats)), dfeat))
    raw = keep(hit_features(boundaries(p, F.col("body_len")), stats))
    return normalize(raw)


def hits_view(hits: DataFrame, docs: DataFrame, assignments: DataFrame | None) -> DataFrame:
    """F27/F28 row shape: ID, score, name, passage, start, end, path,
    extension, size, times (ms), cell, distance."""
    d = docs.select("ID", "name", "path", "extension", "size", "modified", "accessed", "created")
    out = hits.select("ID", "score", F.col("snippet").alias("passage"),
                      F.col("s_start").alias("start"), F.col("s_end").alias("end")).join(d, "ID")
    if assignments is not None:
        out = out.join(assignments.select("ID", "cell", "som_cell_distance"), "ID", "left")
    else:
        out = (out.withColumn("cell", F.lit(None).cast("string"))
               .withColumn("som_cell_distance", F.lit(None).cast("double")))
    return out.select("ID", "score", "name", "passage", "start", "end", "path", "extension", "size",
                      (F.col("modified") * 1000).alias("modified"),
                      (F.col("accessed") * 1000).alias("accessed"),
                      (F.col("created") * 1000).alias("created"), "cell", "som_cell_distance")


def ranked_hits(hits: DataFrame) -> DataFrame:
    """score descending; ties by document and offset."""
    return hits.orderBy(F.col("score").desc(), F.col("ID").cast("long"), F.col("start"))


def docs_with_hits(hits: DataFrame) -> DataFrame:
    """number of documents that produced hits."""
    return hits.agg(F.countDistinct("ID").alias("num_docs"))
