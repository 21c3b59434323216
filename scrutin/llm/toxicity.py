"""Toxicity scores: misspelled lexicon terms found by a Levenshtein automaton
that walks a lexicon trie, weighed by the window of words around each hit.

The lexicon is learned from labelled texts: whole words and stems (word
beginnings) that toxic texts hold and clean ones hardly ever do. For every
word of a text a Levenshtein automaton (bit-parallel, one edit) is run along
the trie, so a word and all terms near it are compared in one walk. Long
enough terms also match with one edit, if that stays telling on the labelled
texts. A hit's window of words decides whether it stands alone, among other
hits (abuse) or inside quotation marks (report); a logistic model weighs these
counts. Labels, language, source and id are never inputs of a score.

Bounded sample: at most ``TRAIN_ROWS`` labelled rows (smallest hash of the id)
are learned from; scoring covers every whole text.

Edge cases: null and empty texts have no hits and get the score of a text
without hits; without toxic labels there is no lexicon and every score is 0;
repeated rows get equal scores; an empty table stays empty; added columns
replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, table, written

#: Labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
#: Terms considered, terms kept.
CANDIDATES, LEXICON = 20_000, 400
#: Shortest stem, shortest word and stem that may match with an edit.
STEM, NEAR_WORD, NEAR_STEM = 4, 5, 6
LONGEST = 12
#: Words before and after a hit that belong to its context.
WINDOW = 8
#: Words whose matches a Python worker remembers.
CACHE_WORDS = 100_000

_TOKEN = re.compile(r"\w+")
_OPEN, _CLOSE = "\"“«„‘‹", "\"”»“’›"

FEATURES = ("exact", "near", "clustered", "quoted")
#: Weights that the fit is drawn to where the labels say nothing.
PRIOR = np.array([-3.0, 3.0, 1.0, 1.0, -1.0])


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class Automaton:
    """A lexicon trie, walked by the Levenshtein automaton of a word.

    ``terms`` maps a term to whether it may match with one edit; a term that
    ends in ``$`` is a whole word, any other a stem.
    """

    def __init__(self, terms: dict[str, bool]):
        self.root: dict = {}
        self.known: dict[str, tuple[str, int] | None] = {}
        for term, near in terms.items():
            whole, node = term.endswith("$"), self.root
            for c in term.rstrip("$"):
                node = node.setdefault(c, {})
            node.setdefault("", []).append((term, whole, near))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term nearest to ``word`` and its distance (0 or 1), if any."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = self.walk(word)
            return found

    def walk(self, word: str) -> tuple[str, int] | None:
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        end, best = 1 << len(word), None
        # states: bit i is set if i letters of the word are read, without and with an edit
        stack = [(self.root, 1, 3)]
        while stack:
            node, zero, one = stack.pop()
            for c, child in node.items():
                if not c:
                    for term, whole, near in child:
                        if zero & end if whole else zero:
                            return term, 0
                        if near and best is None and (one & end if whole else one):
                            best = term, 1
                    continue
                m = mask.get(c, 0)
                z = (zero & m) << 1
                o = (one & m) << 1 | zero | zero << 1 | z << 1
                if z or o:
                    stack.append((child, z, o))
        return best


def hit_features(text: str | None, automaton: Automaton) -> tuple[list[float], list[tuple[str, int, int, int]]]:
    """Context-window counts of a text's hits, and the hits themselves as
    ``(term, distance, begin, end)``."""
    lower = (text or "").lower()
    if not any(map(automaton.match, set(_TOKEN.findall(lower)))):
        return [0.0] * len(FEATURES), []
    spans = [m.span() for m in _TOKEN.finditer(lower)]
    hits = [(i, *found) for i, (a, b) in enumerate(spans) if (found := automaton.match(lower[a:b]))]
    at = [h[0] for h in hits]
    counts = [0, 0, 0, 0]
    for n, (i, _, distance) in enumerate(hits):
        before = lower[spans[max(0, i - WINDOW)][0]:spans[i][0]]
        after = lower[spans[i][1]:spans[min(len(spans) - 1, i + WINDOW)][1]]
        if _inside_quotes(before, after):
            counts[3] += 1
            continue
        counts[distance] += 1
        if (n and i - at[n - 1] <= WINDOW) or (n + 1 < len(at) and at[n + 1] - i <= WINDOW):
            counts[2] += 1
    return ([math.log1p(c) for c in counts],
            [(term, distance, *spans[i]) for i, term, distance in hits])


def _inside_quotes(before: str, after: str) -> bool:
    opened = max((before.rfind(c) for c in _OPEN), default=-1)
    if opened < 0 or before.count('"') % 2 == 0 and before[opened] == '"':
        return False
    closed = max((before.rfind(c, opened + 1) for c in _CLOSE), default=-1)
    return closed < 0 and any(c in after for c in _CLOSE)


def _prefixes(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in range(STEM, min(len(w), LONGEST) + 1)} | {f"{w}$" for w in words if len(w) > 2}


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, label)`` of the bounded training sample: labelled rows whose
    ``crc32(key as text) % 5`` is not 0, each distinct text once."""
    seen = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()
                         & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    seen = seen.groupBy(key).agg(F.max("toxic").alias("label"))
    sample = seen.orderBy(F.xxhash64(key), key).limit(TRAIN_ROWS)
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(sample), key)
    return written(rows.groupBy(F.sha2("text", 256).alias("h")).agg(
        F.first("text").alias("text"), F.max("label").alias("label")).drop("h"))


def _per_batch(rows: DataFrame, columns: list[str], kernel, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            out = kernel(*[b.column(c).to_pylist() for c in columns])
            if out and out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[
                    p.split(" ")[0] for p in schema.split(", ")])
    return rows.select(*columns).mapInArrow(run, schema)


def learn(rows: DataFrame) -> tuple[dict[str, bool], np.ndarray] | None:
    """Lexicon and weights from ``(text, label)`` rows (a bounded sample).
    None if there are no toxic or no clean rows."""
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return None

    def terms(texts):
        found: Counter = Counter()
        for t in texts:
            found.update(_prefixes(set(words_of(t))))
        return [list(found), list(found.values())]

    least = max(3, math.ceil(0.01 * n_toxic))
    counted = (_per_batch(rows.filter("label = 1"), ["text"], terms, "term string, n bigint")
               .groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
               .orderBy(F.desc("n"), F.desc(F.length("term")), "term").limit(CANDIDATES).collect())
    toxic_df = {r["term"]: r["n"] for r in counted}
    wanted = frozenset(toxic_df)

    def clean_terms(texts):
        found: Counter = Counter()
        for t in texts:
            found.update(wanted & _prefixes(set(words_of(t))))
        return [list(found), list(found.values())]

    clean_df = {r["term"]: r["n"] for r in _per_batch(
        rows.filter("label = 0"), ["text"], clean_terms, "term string, n bigint")
        .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    share = n_toxic / (n_toxic + n_clean)

    def telling(t: int, c: int) -> bool:
        """Far commoner in toxic texts, and by more than chance among all candidates allows."""
        lift = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
        return lift >= 15 and (t - c) * -math.log10(share) >= 4

    pure = [t for t in toxic_df if telling(toxic_df[t], clean_df.get(t, 0))]
    wanted = frozenset(pure)

    def present(texts):
        got = [sorted(wanted & _prefixes(set(words_of(t)))) for t in texts]
        return [list(range(len(got))), got]

    held = [set(r["terms"]) for r in _per_batch(
        rows.filter("label = 1"), ["text"], present, "n bigint, terms array<string>").collect()]
    where: dict[str, set[int]] = {}
    for i, got in enumerate(held):
        for t in got:
            where.setdefault(t, set()).add(i)
    # most common first (clean texts count against a term), of nested ones the longest; then what
    # covers texts without a term yet
    chosen: list[str] = []
    covered: set[int] = set()
    top = max((len(x) for x in where.values()), default=0)
    for t in sorted(where, key=lambda t: (5 * clean_df.get(t, 0) - len(where[t]), -len(t), t)):
        if len(chosen) >= LEXICON:
            break
        if any(t.startswith(s) or (s.startswith(t) and len(where[s]) >= 0.9 * len(where[t])) for s in chosen):
            continue
        if len(where[t]) >= 0.25 * top or len(where[t] - covered) >= 3:
            chosen.append(t)
            covered |= where[t]
    if not chosen:
        return None
    near = {t: len(t) - 1 >= NEAR_WORD if t.endswith("$") else len(t) >= NEAR_STEM for t in chosen}

    def edits(texts, marks):
        automaton = Automaton(near)
        found: Counter = Counter()
        for t, y in zip(texts, marks):
            found.update((m[0], y) for m in {automaton.match(w) for w in set(words_of(t))} if m and m[1])
        return [[k[0] for k in found], [int(k[1]) for k in found], list(found.values())]

    seen = {(r["term"], r["label"]): r["n"] for r in _per_batch(
        rows, ["text", "label"], edits, "term string, label bigint, n bigint")
        .groupBy("term", "label").agg(F.sum("n").alias("n")).collect()}
    for t in chosen:
        t1, t0 = seen.get((t, 1), 0) / n_toxic, seen.get((t, 0), 0) / n_clean
        near[t] = near[t] and t0 <= max(0.2 * t1, 1 / n_clean)

    def features(texts, marks):
        automaton = Automaton(near)
        found = Counter((*map(lambda v: round(v, 6), hit_features(t, automaton)[0]), int(y)) for t, y in zip(texts, marks))
        keys = list(found)
        return [[list(k[:-1]) for k in keys], [k[-1] for k in keys], list(found.values())]

    points = _per_batch(rows, ["text", "label"], features, "x array<double>, label bigint, n bigint").groupBy(
        "x", "label").agg(F.sum("n").alias("n")).orderBy("x", "label").collect()
    return near, fit(np.array([r["x"] for r in points]), np.array([r["label"] for r in points]),
                     np.array([r["n"] for r in points], dtype=float))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic weights (intercept first) by Newton steps, drawn to ``PRIOR``."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (n * (p - y)) + ridge * (w - PRIOR)
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(df: DataFrame, model: tuple[dict[str, bool], np.ndarray] | None, text: str = "text",
          out: str = "score", hits: str | None = None) -> DataFrame:
    """``df`` with the toxicity ``out`` of each whole text and, if ``hits``
    names a column, its hits (term, distance, begin, end)."""
    fields = [T.StructField(out, T.DoubleType())]
    kind = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("distance", T.IntegerType()),
                                     T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    if hits:
        fields.append(T.StructField(hits, kind))
    arrow = pa.list_(pa.struct([("term", pa.string()), ("distance", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
    lexicon, weights = (model[0], model[1].tolist()) if model else ({}, None)
    held: dict[int, Automaton] = {}

    def kernel(cols):
        automaton = held.get(0) or held.setdefault(0, Automaton(lexicon))
        scores, found = [], []
        for t in cols[0].to_pylist():
            x, h = hit_features(t, automaton) if weights else ([], [])
            z = weights[0] + sum(w * v for w, v in zip(weights[1:], x)) if weights else -math.inf
            scores.append(1 / (1 + math.exp(-max(min(z, 30.0), -30.0))) if weights else 0.0)
            found.append([dict(zip(("term", "distance", "begin", "end"), y)) for y in h])
        return [pa.array(scores, pa.float64()), *([pa.array(found, arrow)] if hits else [])]

    return append_arrow(df, fields, [text], kernel)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(labelled(docs, table(spark, sf_dir, "labels")))
    out = score(docs, model).drop("text")
    left = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", left.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
