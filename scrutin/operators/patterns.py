"""Dictionary index for patterns: D11–D13 without a scan of the dictionary.

- ``grams`` (gram, term): the trigrams of every dictionary term between a
  begin and an end mark. A wildcard pattern or regular expression that must
  hold some literal text is looked up by that text's trigrams, and so is a
  fuzzy term: an edit takes at most ``GRAM`` of its trigrams.
- ``deletes`` (key, term), for the short terms of which no trigram need be
  left: what is left of the first ``PREFIX`` characters of a term after at
  most ``EDITS`` deletions. Two terms within that distance share a key: drop
  from both prefixes the characters that an alignment edits or carries over
  the prefix's end, at most one per edit, and the rest is equal.

Both are read by an equality that reaches the sorted files; what they give is
a superset, and the clause's own predicate decides.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a term, characters of a gram, of a prefix; most edits.
BEGIN, END, GRAM, PREFIX, EDITS = "\u0002", "\u0003", 3, 5, 2
#: Longest term of which two edits may leave no trigram, and its longest neighbour.
SHORT = GRAM * EDITS
SHORT_NEIGHBOUR = SHORT + EDITS
#: Grams of a pattern that are looked up; further ones hardly narrow the terms.
LOOKED_UP = 6


def _pieces(text: Column) -> Column:
    n = F.length(text) - (GRAM - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, GRAM)))


def gram_table(terms: DataFrame) -> DataFrame:
    """(gram, term) of the dictionary ``terms``."""
    marked = F.concat(F.lit(BEGIN), "term", F.lit(END))
    return terms.where("term <> ''").select(F.explode(_pieces(marked)).alias("gram"), "term")


def delete_table(terms: DataFrame) -> DataFrame:
    """(key, term) of the short terms of the dictionary ``terms``."""
    terms = terms.where(F.length("term") <= SHORT_NEIGHBOUR)

    def less(s: Column) -> Column:
        n = F.length(s)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
            F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))).otherwise(F.array().cast("array<string>"))

    keys = level = F.array(F.substring("term", 1, PREFIX))
    for _ in range(EDITS):
        level = F.flatten(F.transform(level, less))
        keys = F.concat(keys, level)
    return terms.select(F.explode(F.array_distinct(keys)).alias("key"), "term")


def delete_keys(term: str, edits: int) -> list[str]:
    """The keys under which terms within ``edits`` of ``term`` are found."""
    prefix = term[:PREFIX]
    out = set()
    for n in range(min(edits, len(prefix)) + 1):
        for gone in itertools.combinations(range(len(prefix)), n):
            out.add("".join(c for i, c in enumerate(prefix) if i not in gone))
    return sorted(out)


def wildcard_parts(pattern: str) -> list[str]:
    """The literal parts of a wildcard pattern, with marks at its ends."""
    return [p for p in re.split(r"[*?]", BEGIN + pattern + END) if p not in ("", BEGIN, END)]


def regex_parts(pattern: str) -> tuple[str, list[str]]:
    """Literal text that every full match of a regular expression begins with,
    and runs of literal text that it holds. Nothing is claimed for expressions
    with flags, or ones that are read in another way elsewhere."""
    from re import _constants as C
    from re import _parser as P
    try:
        tree = P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return "", []
    if tree.state.flags & ~re.UNICODE or "(?" in pattern.replace("(?:", "") or "&&" in pattern:
        return "", []
    runs, run = [], []
    seen_other = False
    prefix = ""

    def close():
        nonlocal run, prefix
        if run and not seen_other:
            prefix = "".join(run)
        if run:
            runs.append("".join(run))
        run = []

    def visit(nodes):
        nonlocal seen_other
        for op, arg in nodes:
            if op is C.LITERAL:
                run.append(chr(arg))
                continue
            if op is C.SUBPATTERN:
                visit(arg[3])
                continue
            close()
            if op is not C.AT:
                seen_other = True
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                visit(arg[2])  # once, at least, and then perhaps again
                close()

    visit(tree)
    if run and not seen_other:  # the whole expression is literal
        prefix = "".join(run)
    close()
    return prefix, runs


def grams_of(parts: list[str]) -> list[str]:
    """Trigrams that a term must hold, of the longest parts first."""
    found = dict.fromkeys(p[i:i + GRAM] for p in sorted(parts, key=len, reverse=True)
                          for i in range(len(p) - GRAM + 1))
    return list(found)[:LOOKED_UP]


def with_grams(grams: DataFrame, wanted: list[str], least: int | None = None) -> DataFrame:
    """(term): dictionary terms that hold all (or ``least``) of some trigrams."""
    held = grams.where(F.col("gram").isin(wanted)).groupBy("term").agg(F.count_distinct("gram").alias("n"))
    return held.where(F.col("n") >= (least or len(wanted))).select("term")


def near(grams: DataFrame, deletes: DataFrame, term: str, edits: int) -> DataFrame | None:
    """(term): dictionary terms that may lie within ``edits`` of ``term``;
    None if neither table tells (a long word of few different trigrams)."""
    marked = BEGIN + term + END
    held = sorted({marked[i:i + GRAM] for i in range(len(marked) - GRAM + 1)})
    left = len(held) - GRAM * edits
    if left >= 1:
        return with_grams(grams, held, left)
    if edits <= EDITS and len(term) <= SHORT:
        return deletes.where(F.col("key").isin(delete_keys(term, edits))).select("term").distinct()
    return None
