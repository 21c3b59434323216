"""Typed query clauses over the index.

There is no query-string parser: a query is a tree of clause objects. Every
clause evaluates to a DataFrame ``(ID, score)`` of matching documents with a
classic TF-IDF score (see :mod:`scrutin.operators.rank`), and reports the body
terms it contributes to hit ranking (F31).

Scoring follows the vector-space model of the studied tool's library:
``coord · queryNorm · Σ sqrt(tf) · idf² · boost · norm`` with
``idf = 1 + ln(N / (df + 1))`` and ``norm = 1/sqrt(field length)``.
Multi-term clauses (prefix, wildcard, fuzzy, regexp, range) score a constant
``boost · queryNorm``. Statistics of the query's own terms are fetched as a
handful of rows (bounded by the query, not the data).
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_TOKEN_LENGTH
from ..functions.text import QUERY_TOKEN_RE
from . import fields as M
from . import patterns as P
from ..session import bounded_broadcast, literal_frame


# ----------------------------------------------------------------- context

@dataclass
class Context:
    """What clause evaluation needs: the index, an optional SOM assignment
    table (for ``cell`` clauses) and the norm flavour."""
    index: object
    assignments: DataFrame | None = None
    quantized_norm: bool = False
    stops: frozenset | None = None     # default: the default stop list
    _num_docs: int | None = None
    _df_cache: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.stops is None:
            from ..sources.stoplist import default_stop_terms
            self.stops = frozenset(t.lower() for t in default_stop_terms())

    @property
    def num_docs(self) -> int:
        if self._num_docs is None:
            self._num_docs = self.index.corpus_row()[0]
        return self._num_docs

    def doc_freqs(self, terms: list[str]) -> dict[str, int]:
        """df of a few query terms (missing terms: 0). The first lookup also
        fetches the document count, so a query starts with one small job."""
        need = [t for t in set(terms) if t not in self._df_cache]
        if need:
            q = self.index.term_stats.where(F.col("term").isin(need)).select(
                "term", F.col("df").cast("long").alias("df"), F.lit(False).alias("corpus"))
            if self._num_docs is None:
                q = q.unionByName(self.index.corpus.select(
                    F.lit("").alias("term"), F.col("num_docs").cast("long").alias("df"),
                    F.lit(True).alias("corpus")))
            got = {}
            for r in q.collect():
                if r["corpus"]:
                    self._num_docs = int(r["df"])
                else:
                    got[r["term"]] = int(r["df"])
            for t in need:
                self._df_cache[t] = got.get(t, 0)
        return {t: self._df_cache[t] for t in terms}

    def idf(self, df: int) -> float:
        return 1.0 + math.log(self.num_docs / (df + 1.0))

    def norm(self, length: Column) -> Column:
        from .rank import length_norm
        return length_norm(length, self.quantized_norm)


def analyze(text: str, stops: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """Query text analysed the way bodies are: ``(term, position)`` of its
    lower-cased tokens, stop words and overlong tokens left out with their
    positions kept."""
    import regex  # the standard module lacks the classes of the pattern
    found = enumerate(m.group() for m in regex.finditer(QUERY_TOKEN_RE, text.lower()))
    return [(t, i) for i, t in found if t not in stops and len(t) <= MAX_TOKEN_LENGTH]


# ------------------------------------------------------ one pass for a tree

#: Plain terms of a query that get a column each; further ones are leaves.
PLAIN_TERMS = 64


class Leaves:
    """The leaves of a query tree in one row per document: ``t<i>`` is the
    frequency of plain term ``i`` (one scan of the term vectors for all of
    them), ``s<j>`` the score of the ``j``-th other clause, null where it does
    not match. Clauses are conditions and sums over these columns, so a tree
    costs one aggregation however deep it is, and its scores are added in one
    order, whatever the partitions."""

    def __init__(self, ctx: Context):
        self.ctx, self.terms, self.others = ctx, {}, []

    def term(self, term: str) -> Column:
        return F.col(f"t{self.terms.setdefault(term, len(self.terms))}")

    def other(self, scores: DataFrame) -> Column:
        self.others.append(scores)
        return F.col(f"s{len(self.others) - 1}")

    def rows(self) -> DataFrame:
        dt = self.ctx.index.doc_terms.where(F.col("term").isin(list(self.terms)) if self.terms else F.lit(False))
        both = dt.select("ID", "term", "tf", "length", F.lit(None).cast("int").alias("leaf"), F.lit(None).cast("double").alias("score"))
        if not self.terms and self.others:
            both = both.limit(0)
        for j, df in enumerate(self.others):
            both = both.unionByName(df.select("ID", F.lit(j).alias("leaf"), "score"), allowMissingColumns=True)
        return both.groupBy("ID").agg(
            F.max("length").alias("length"),
            *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"t{i}") for t, i in self.terms.items()],
            *[F.max(F.when(F.col("leaf") == j, F.col("score"))).alias(f"s{j}") for j in range(len(self.others))])


def _in_one_pass(clause: Clause, ctx: Context, qnorm: float) -> DataFrame:
    leaves = Leaves(ctx)
    match, score = clause.parts(ctx, qnorm, leaves)
    return leaves.rows().where(match).select("ID", score.alias("score"))


# ----------------------------------------------------------------- clauses

class Clause:
    boost: float = 1.0

    def sum_sq(self, ctx: Context) -> float:  # pragma: no cover - abstract
        raise NotImplementedError

    def scores(self, ctx: Context, qnorm: float) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def parts(self, ctx: Context, qnorm: float, leaves: Leaves) -> tuple[Column, Column]:
        """(matches, score) over the columns of ``leaves``; the score counts
        only where the clause matches."""
        got = leaves.other(self.scores(ctx, qnorm))
        return got.isNotNull(), got

    def body_terms(self, ctx: Context) -> DataFrame | None:
        """(term) rows this clause contributes, or None."""
        return None

    def matches(self, ctx: Context) -> DataFrame:
        return self.scores(ctx, 1.0).select("ID")

    def analyzed(self, ctx: Context) -> Clause:
        """The clause with its text analysed like bodies."""
        return self

    def __or__(self, other):
        return Bool(should=[self, other])

    def __and__(self, other):
        return Bool(must=[self, other])

    def __sub__(self, other):
        return Bool(must=[self], must_not=[other])

    def __pow__(self, boost):
        return Boost(self, boost)


def _plus(columns: list[Column]) -> Column:
    """The sum of some columns, from left to right."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _terms_df(ctx: Context, terms: list[str]) -> DataFrame:
    return literal_frame(ctx.index.spark, dict.fromkeys(terms), "term")


@dataclass
class MatchAll(Clause):
    """Every document, constant score."""
    boost: float = 1.0

    def sum_sq(self, ctx):
        return self.boost ** 2

    def scores(self, ctx, qnorm):
        return ctx.index.docs.select("ID", F.lit(self.boost * qnorm).alias("score"))


@dataclass
class NoMatch(Clause):
    """What query text without any term (stop words only) stands for."""

    def sum_sq(self, ctx):
        return 0.0

    def scores(self, ctx, qnorm):
        return ctx.index.docs.select("ID", F.lit(0.0).alias("score")).where(F.lit(False))


@dataclass
class Term(Clause):
    """A word on ``body``, analysed unless ``analyze=False``; text of
    several words stands for their phrase."""
    term: str
    boost: float = 1.0
    analyze: bool = True

    def analyzed(self, ctx):
        if not self.analyze:
            return self
        got = analyze(self.term, ctx.stops)
        if len(got) == 1:
            return Term(got[0][0], self.boost, analyze=False)
        return _phrase(got, 0, self.boost)

    def sum_sq(self, ctx):
        return (ctx.idf(ctx.doc_freqs([self.term])[self.term]) * self.boost) ** 2

    def parts(self, ctx, qnorm, leaves):
        return Terms([self.term], [self.boost]).parts(ctx, qnorm, leaves)

    def scores(self, ctx, qnorm):
        return _in_one_pass(self, ctx, qnorm)

    def body_terms(self, ctx):
        return _terms_df(ctx, [self.term])


@dataclass
class Terms(Clause):
    """D4 over plain terms: ``t1 OR t2 OR …`` evaluated in one pass over the
    term vectors."""
    terms: list[str]
    boosts: list[float] | None = None
    boost: float = 1.0
    analyze: bool = True

    def analyzed(self, ctx):
        if not self.analyze:
            return self
        parts = [(Term(t, b).analyzed(ctx)) for t, b in zip(self.terms, self.boosts or [1.0] * len(self.terms))]
        parts = [p for p in parts if not isinstance(p, NoMatch)]
        if not parts:
            return NoMatch()
        if all(isinstance(p, Term) for p in parts) and len({p.term for p in parts}) == len(parts):
            return Terms([p.term for p in parts], [p.boost for p in parts], self.boost, analyze=False)
        return Bool(should=parts, boost=self.boost)

    def _weights(self, ctx):
        bs = self.boosts or [1.0] * len(self.terms)
        dfs = ctx.doc_freqs(self.terms)
        return {t: (ctx.idf(dfs[t]), b) for t, b in zip(self.terms, bs)}

    def sum_sq(self, ctx):
        return sum((idf * b) ** 2 for idf, b in self._weights(ctx).values()) * self.boost ** 2

    def parts(self, ctx, qnorm, leaves):
        if len({*leaves.terms, *self.terms}) > PLAIN_TERMS:
            return super().parts(ctx, qnorm, leaves)
        wts = self._weights(ctx)
        tf = [leaves.term(t) for t in wts]
        raw = [F.when(c.isNotNull(), F.sqrt(c) * F.lit(idf * idf * b * self.boost)).otherwise(0.0)
               for c, (idf, b) in zip(tf, wts.values())]
        found = _plus([c.isNotNull().cast("int") for c in tf])
        score = _plus(raw) * ctx.norm(F.col("length")) * F.lit(qnorm)
        return found > 0, score * (found / F.lit(float(len(wts)))) if len(wts) > 1 else score

    def scores(self, ctx, qnorm):
        if len(set(self.terms)) <= PLAIN_TERMS:
            return _in_one_pass(self, ctx, qnorm)
        # many terms: a document's parts are added in the order of the terms
        wts = self._weights(ctx)
        factor = F.create_map(*[x for t, (idf, b) in wts.items() for x in (F.lit(t), F.lit(idf * idf * b * self.boost))])
        per_doc = ctx.index.doc_terms.where(F.col("term").isin(list(wts))).groupBy("ID").agg(
            F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("found"), F.max("length").alias("length"))
        raw = F.aggregate("found", F.lit(0.0), lambda acc, x: acc + F.sqrt(x["tf"]) * factor[x["term"]])
        return per_doc.select("ID", (raw * ctx.norm(F.col("length")) * (F.size("found") / F.lit(float(len(wts))))
                                     * F.lit(qnorm)).alias("score"))

    def body_terms(self, ctx):
        return _terms_df(ctx, self.terms)


def _field_source(ctx: Context, name: str) -> DataFrame | None:
    """The table with a column for a field; None for a metadata key."""
    if name in ("cell", "som_x", "som_y", "som_cell_distance"):
        if ctx.assignments is None:
            raise ValueError("cell clauses need SOM assignments")
        return ctx.assignments
    if name in ctx.index.docs.columns:
        return ctx.index.docs
    if ctx.index.fields is None:
        raise ValueError(f"the index has no field {name!r}: it was not built from records")
    return None


@dataclass
class FieldEquals(Clause):
    """D3: exact value of an untokenised field: ID, name, path, extension,
    cell …, or any metadata key (:mod:`scrutin.operators.fields`). Norms are
    off for such fields; tf is 1."""
    field_name: str
    value: object
    boost: float = 1.0

    def _ids(self, ctx):
        src = _field_source(ctx, self.field_name)
        if src is None:
            return M.equals(ctx.index.fields, self.field_name, self.value)
        return src.where(F.col(self.field_name) == F.lit(self.value)).select("ID")

    def _df(self, ctx):
        key = ("field", self.field_name, type(self.value).__name__, str(self.value))
        if key not in ctx._df_cache:
            ctx._df_cache[key] = self._ids(ctx).count()
        return ctx._df_cache[key]

    def sum_sq(self, ctx):
        return (ctx.idf(self._df(ctx)) * self.boost) ** 2

    def scores(self, ctx, qnorm):
        idf = ctx.idf(self._df(ctx))
        return self._ids(ctx).select("ID", F.lit(idf * idf * self.boost * qnorm).alias("score"))


def Cell(cell) -> FieldEquals:
    """Documents of one SOM cell (``cell:"n"``)."""
    return FieldEquals("cell", str(cell))


def Outliers() -> FieldEquals:
    """Documents without a cell (empty vectors), ``cell == "-1"``."""
    return FieldEquals("cell", "-1")


@dataclass
class Boost(Clause):
    """Multiply a clause's weight by ``boost``."""
    inner: Clause
    boost: float = 1.0

    def analyzed(self, ctx):
        inner = self.inner.analyzed(ctx)
        return inner if isinstance(inner, NoMatch) else Boost(inner, self.boost)

    def sum_sq(self, ctx):
        return self.inner.sum_sq(ctx) * self.boost ** 2

    def parts(self, ctx, qnorm, leaves):
        return self.inner.parts(ctx, qnorm * self.boost, leaves)

    def scores(self, ctx, qnorm):
        return self.inner.scores(ctx, qnorm * self.boost)

    def body_terms(self, ctx):
        return self.inner.body_terms(ctx)


@dataclass
class Bool(Clause):
    """D4 (should), D5 (must), D6 (must_not), D7 (nesting)."""
    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    boost: float = 1.0

    def analyzed(self, ctx):
        """Clauses without any term are left out, as if not written."""
        kept = [[c for c in (x.analyzed(ctx) for x in part) if not isinstance(c, NoMatch)]
                for part in (self.must, self.should, self.must_not)]
        return Bool(*kept, boost=self.boost) if kept[0] or kept[1] else NoMatch()

    def sum_sq(self, ctx):
        return sum(c.sum_sq(ctx) for c in self.must + self.should) * self.boost ** 2

    def parts(self, ctx, qnorm, leaves):
        q = qnorm * self.boost
        must, should = ([c.parts(ctx, q, leaves) for c in part] for part in (self.must, self.should))
        every = must + should
        if not every:
            return F.lit(False), F.lit(0.0)
        # a condition on missing leaves is null: it does not hold
        every = [(F.coalesce(m, F.lit(False)), s) for m, s in every]
        found = _plus([m.cast("int") for m, _ in every])
        match = found > 0
        for m, _ in every[:len(must)]:
            match = match & m
        for c in self.must_not:
            match = match & ~F.coalesce(c.parts(ctx, 1.0, leaves)[0], F.lit(False))
        score = _plus([F.when(m, s).otherwise(0.0) for m, s in every])
        return match, score * (found / F.lit(float(len(every)))) if len(every) > 1 else score

    def scores(self, ctx, qnorm):
        return _in_one_pass(self, ctx, qnorm)

    def body_terms(self, ctx):
        got = [t for t in (c.body_terms(ctx) for c in self.must + self.should) if t is not None]
        if not got:
            return None
        u = got[0]
        for g in got[1:]:
            u = u.unionByName(g)
        return u.distinct()


def Or(*clauses) -> Bool:
    return Bool(should=list(clauses))


def And(*clauses) -> Bool:
    return Bool(must=list(clauses))


def AndNot(q, *prohibited) -> Bool:
    return Bool(must=[q], must_not=list(prohibited))


@dataclass
class Phrase(Clause):
    """Terms at consecutive positions; with ``slop`` > 0 a sloppy
    phrase. ``terms`` are analysed unless ``analyze=False``; stop words drop
    out and leave a gap. ``offsets`` are the terms' places in the phrase
    (0, 1, 2 … by default). Positions are matched by equi-joins on (ID, pos) — a self-join
    of the phrase terms' postings, never a pairing of all positions."""
    terms: list[str]
    slop: int = 0
    boost: float = 1.0
    offsets: list[int] | None = None
    analyze: bool = True

    def analyzed(self, ctx):
        return _phrase(analyze(" ".join(self.terms), ctx.stops), self.slop, self.boost) if self.analyze else self

    def _places(self) -> list[tuple[str, int]]:
        return list(zip(self.terms, self.offsets or range(len(self.terms))))

    def _idf(self, ctx):
        dfs = ctx.doc_freqs(self.terms)
        return sum(ctx.idf(dfs[t]) for t in self.terms)

    def sum_sq(self, ctx):
        return (self._idf(ctx) * self.boost) ** 2

    def occurrences(self, ctx) -> DataFrame:
        """(ID, pos, freq) — one row per phrase occurrence (anchored at the
        first term's position) and its sloppy frequency ``1/(d+1)``."""
        p = ctx.index.postings.select("ID", "term", "pos")
        first = p.where(F.col("term") == self.terms[0]).select("ID", F.col("pos").alias("p0"))
        if self.slop == 0:
            cur = first
            for t, k in self._places()[1:]:
                nxt = p.where(F.col("term") == t).select("ID", (F.col("pos") - k).alias("p0"))
                cur = cur.join(nxt, ["ID", "p0"], "left_semi")
            return cur.select("ID", F.col("p0").alias("pos"), F.lit(1.0).alias("freq"))
        return _sloppy(p, self._places(), self.slop)

    def scores(self, ctx, qnorm):
        idf = self._idf(ctx)
        # few different frequencies per document, added in their order
        occ = self.occurrences(ctx).groupBy("ID", "freq").agg(F.count(F.lit(1)).alias("n"))
        occ = occ.groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("freq", "n"))).alias("f")).select(
            "ID", F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["freq"] * x["n"]).alias("freq"))
        lengths = ctx.index.doc_terms.where(F.col("term") == self.terms[0]).select("ID", "length")
        return (occ.join(lengths, "ID")
                .select("ID", (F.sqrt("freq") * F.lit(idf * idf * self.boost * qnorm)
                               * ctx.norm(F.col("length"))).alias("score")))

    def body_terms(self, ctx):
        return _terms_df(ctx, self.terms)


def _phrase(found: list[tuple[str, int]], slop: int, boost: float) -> Clause:
    """The phrase of analysed ``(term, position)`` pairs."""
    if not found:
        return NoMatch()
    return Phrase([t for t, _ in found], slop, boost, [i - found[0][1] for _, i in found], analyze=False)


def _sloppy(p: DataFrame, places: list[tuple[str, int]], slop: int) -> DataFrame:
    """Sloppy phrase: term ``k`` at position ``pos_k`` has phrase position
    ``pos_k - k``; an occurrence (anchored at a first-term position) matches
    when the phrase positions span at most ``slop`` (so two reversed
    neighbours cost 2), and adds ``1/(span + 1)`` to the frequency.

    The band join is an equi-join on (ID, bin) with bins of width slop+1;
    each candidate is copied to its neighbouring bins (three copies, fixed).
    """
    width = slop + 1
    cur = (p.where(F.col("term") == places[0][0])
           .select("ID", F.col("pos").alias("p0"))
           .withColumn("lo", F.col("p0")).withColumn("hi", F.col("p0")))
    for t, k in places[1:]:
        cand = (p.where(F.col("term") == t)
                .select("ID", (F.col("pos") - k).alias("pk"))
                .withColumn("bin", F.floor(F.col("pk") / width))
                .select("ID", "pk", F.explode(F.array(F.col("bin") - 1, F.col("bin"),
                                                      F.col("bin") + 1)).alias("bin")))
        cur = (cur.withColumn("bin", F.floor(F.col("p0") / width))
               .join(cand, ["ID", "bin"])
               .select("ID", "p0", F.least("lo", "pk").alias("lo"), F.greatest("hi", "pk").alias("hi"))
               .where(F.col("hi") - F.col("lo") <= slop)
               .distinct())  # one row per span: combinations do not multiply from term to term
    best = cur.groupBy("ID", "p0").agg(F.min(F.col("hi") - F.col("lo")).alias("span"))
    return best.select("ID", F.col("p0").alias("pos"), (1.0 / (F.col("span") + 1.0)).alias("freq"))


# ------------------------------------------------ multi-term (dictionary) clauses

#: Terms up to which an expanded pattern is a filter on the term vectors.
FILTER_TERMS = 1000


@dataclass
class _DictClause(Clause):
    boost: float = 1.0

    def predicate(self) -> Column:  # pragma: no cover - abstract
        raise NotImplementedError

    def literal_prefix(self) -> str:
        """A literal prefix every matching term starts with ("" if none)."""
        return ""

    def candidates(self, index) -> DataFrame | None:
        """(term) rows that hold every matching term, looked up in the
        dictionary index; None if the pattern has nothing to look up."""
        return None

    def expand(self, ctx) -> DataFrame:
        """Dictionary terms the clause stands for."""
        pf = self.literal_prefix()
        if not pf:
            found = self.candidates(ctx.index)
            if found is not None:
                return found.where(self.predicate())
        # startswith reaches the parquet scan; files sorted by term then skip
        # every row group outside the prefix range
        terms = ctx.index.term_stats.where(F.col("term").startswith(pf)) if pf else ctx.index.term_stats
        return terms.where(self.predicate()).select("term")

    def sum_sq(self, ctx):
        return self.boost ** 2

    def scores(self, ctx, qnorm):
        pf = self.literal_prefix()
        if pf:
            # pruned scan of the term vectors, exact predicate on the survivors
            hits = ctx.index.doc_terms.where(F.col("term").startswith(pf)).where(self.predicate())
        else:
            # expand the dictionary first: a few terms are a filter that
            # reaches the files, more are a semi-join
            terms = self.expand(ctx)
            few = [r["term"] for r in terms.limit(FILTER_TERMS + 1).collect()]
            if len(few) <= FILTER_TERMS:
                hits = ctx.index.doc_terms.where(F.col("term").isin(few) if few else F.lit(False))
            else:
                hits = ctx.index.doc_terms.join(bounded_broadcast(terms), "term", "left_semi")
        return hits.select("ID").distinct().select("ID", F.lit(self.boost * qnorm).alias("score"))

    def body_terms(self, ctx):
        return self.expand(ctx)


def _by_grams(index, parts: list[str]) -> DataFrame | None:
    wanted = P.grams_of(parts)
    return P.with_grams(index.grams, wanted) if wanted else None


@dataclass
class Prefix(_DictClause):
    """Terms starting with ``prefix``."""
    prefix: str = ""

    def analyzed(self, ctx):
        return Prefix(self.boost, self.prefix.lower())

    def predicate(self):
        return F.col("term").startswith(self.prefix)

    def literal_prefix(self):
        return self.prefix


@dataclass
class Wildcard(_DictClause):
    """``*`` any run, ``?`` one character, whole term."""
    pattern: str = ""

    def analyzed(self, ctx):
        return Wildcard(self.boost, self.pattern.lower())

    def predicate(self):
        return F.col("term").rlike(wildcard_regex(self.pattern))

    def literal_prefix(self):
        return re.split(r"[*?]", self.pattern, maxsplit=1)[0]

    def candidates(self, index):
        return _by_grams(index, P.wildcard_parts(self.pattern))


def wildcard_regex(pattern: str) -> str:
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
    return "^" + "".join(out) + "$"


@dataclass
class Fuzzy(_DictClause):
    """Terms within ``max_edits`` (Levenshtein) of ``term``."""
    term: str = ""
    max_edits: int = 2

    def analyzed(self, ctx):
        return Fuzzy(self.boost, self.term.lower(), self.max_edits)

    def predicate(self):
        # lengths first; the bounded distance is -1 beyond the limit
        return ((F.abs(F.length("term") - F.lit(len(self.term))) <= self.max_edits)
                & (F.levenshtein(F.col("term"), F.lit(self.term), self.max_edits) >= 0))

    def candidates(self, index):
        return P.near(index.grams, index.deletes, self.term, max(self.max_edits, 0))


@dataclass
class Regexp(_DictClause):
    """Terms fully matching a regular expression."""
    regex: str = ""

    def predicate(self):
        return F.col("term").rlike("^(?:" + self.regex + ")$")

    def literal_prefix(self):
        return P.regex_parts(self.regex)[0]

    def candidates(self, index):
        return _by_grams(index, P.regex_parts(self.regex)[1])


@dataclass
class Range(Clause):
    """Typed range on a field or any metadata key: bounds of strings,
    numbers, or dates and times (on the core times, which are seconds, too)."""
    field_name: str
    lo: object = None
    hi: object = None
    include_lo: bool = True
    include_hi: bool = True
    boost: float = 1.0

    def sum_sq(self, ctx):
        return self.boost ** 2

    def _ids(self, ctx):
        src = _field_source(ctx, self.field_name)
        how = (self.lo, self.hi, self.include_lo, self.include_hi)
        if src is None:
            return M.within(ctx.index.fields, self.field_name, *how)
        c = F.col(self.field_name)
        if any(isinstance(x, datetime.date) for x in how) and self.field_name in ("created", "modified", "accessed"):
            # bounds in whole seconds, so the filter reaches the files
            lo, hi = (None if x is None else M.micros(x) for x in how[:2])
            up = lambda x: -(-x // 1_000_000)
            how = (None if lo is None else up(lo) if self.include_lo else lo // 1_000_000,
                   None if hi is None else hi // 1_000_000 if self.include_hi else up(hi), *how[2:])
        return src.where(M.between(c, *how)).select("ID")

    def scores(self, ctx, qnorm):
        return self._ids(ctx).select("ID", F.lit(self.boost * qnorm).alias("score"))


def evaluate(ctx: Context, q: Clause | None) -> DataFrame:
    """Run a query: (ID, score). ``None`` or an empty query matches all."""
    q = MatchAll() if q is None else q.analyzed(ctx)
    ss = q.sum_sq(ctx)
    qnorm = 1.0 / math.sqrt(ss) if ss > 0 else 1.0
    return q.scores(ctx, qnorm)


def query_terms(ctx: Context, q: Clause | None) -> DataFrame:
    """distinct body terms of the non-prohibited clauses."""
    got = q.analyzed(ctx).body_terms(ctx) if q is not None else None
    if got is None:
        return literal_frame(ctx.index.spark, [], "term")
    return got.distinct()
