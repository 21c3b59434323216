"""Document ranking, total hits, top-k, paging and result views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as Q


def _norm_breakpoints():
    """Values ``2^e · {1.75, 1.5, 1.25, 1}`` in descending order, e = 0…-13:
    the one-byte field norm keeps two mantissa bits, so the stored norm is the
    largest of these not above ``1/sqrt(length)``."""
    out = []
    for e in range(0, -14, -1):
        for m in (1.75, 1.5, 1.25, 1.0):
            v = m * 2.0 ** e
            if v <= 1.0:
                out.append(v)
    return out


def length_norm(length: Column, quantized: bool = False) -> Column:
    """Field-length norm ``1/sqrt(length)``; ``quantized`` rounds it down to
    the one-byte encoding with a breakpoint table (exact dyadic values:
    ``v <= 1/sqrt(n)`` ⇔ ``n·v² <= 1``)."""
    n = F.greatest(length.cast("double"), F.lit(1.0))
    if not quantized:
        return 1.0 / F.sqrt(n)
    expr = None
    for v in _norm_breakpoints():
        cond = n * F.lit(v * v) <= F.lit(1.0)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(0.0))


def search(ctx: Q.Context, q: Q.Clause | None) -> DataFrame:
    """(ID, score) for every matching document."""
    return Q.evaluate(ctx, q)


def total_hits(results: DataFrame) -> DataFrame:
    """Number of matching documents."""
    return results.agg(F.count(F.lit(1)).alias("total_hits"))


def ranked(results: DataFrame) -> DataFrame:
    """Rank order: score descending, ties by document number."""
    return results.orderBy(F.col("score").desc(), F.col("ID").cast("long").asc())


def top_k(results: DataFrame, k: int) -> DataFrame:
    """The k best documents (a TakeOrderedAndProject: each task keeps its
    own k best, the driver merges k·tasks rows)."""
    return ranked(results).limit(k)


def page(results: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``[start, end)`` of the ranking; ``end`` is clamped to the
    total by construction, a start past the end gives no rows."""
    start = max(start, 0)
    n = max(end - start, 0)
    return ranked(results).offset(start).limit(n) if start else ranked(results).limit(n)


def page_after(results: DataFrame, last_score: float, last_id: str, n: int) -> DataFrame:
    """E4 keyset form: the ``n`` rows after (score, ID) — no offset scan.
    Scores are added in one order whatever the partitions, so the cursor of
    one run compares equal in another."""
    sid = F.col("ID").cast("long")
    after = (F.col("score") < last_score) | ((F.col("score") == last_score) & (sid > int(last_id)))
    return ranked(results.where(after)).limit(n)


def with_fields(results: DataFrame, docs: DataFrame, assignments: DataFrame | None) -> DataFrame:
    """E5/H9: attach the displayed document fields (no body) and the SOM
    side (left join on ID; cell stays null when no map was trained)."""
    out = results.join(docs.select("ID", "name", "path", "extension", "size", "modified",
                                   "accessed", "created"), "ID")
    if assignments is not None:
        out = out.join(assignments.select("ID", "cell", "som_cell_distance"), "ID", "left")
    else:
        out = (out.withColumn("cell", F.lit(None).cast("string"))
               .withColumn("som_cell_distance", F.lit(None).cast("double")))
    return out


def files_view(results: DataFrame, docs: DataFrame, assignments: DataFrame | None,
               start: int = 0, length: int = 20, bookmarked: DataFrame | None = None) -> DataFrame:
    """One page of the files table — selection flag, ID, score, name,
    path, extension, size, modified/accessed/created (ms), cell, distance.
    Only the page's rows are joined with document fields."""
    pg = page(results, start, start + length)
    out = with_fields(pg, docs, assignments)
    flag = F.lit(False)
    if bookmarked is not None:
        out = out.join(bookmarked.select("ID").distinct().withColumn("_bm", F.lit(True)), "ID", "left")
        flag = F.coalesce(F.col("_bm"), F.lit(False))
    return out.select(
        flag.alias("selected"), "ID", "score", "name", "path", "extension", "size",
        (F.col("modified") * 1000).alias("modified_ms"),
        (F.col("accessed") * 1000).alias("accessed_ms"),
        (F.col("created") * 1000).alias("created_ms"),
        "cell", "som_cell_distance")


def fetch_document(docs: DataFrame, doc_id: str) -> DataFrame:
    """One document with its body (pushed-down ID filter)."""
    return docs.where(F.col("ID") == F.lit(doc_id))
