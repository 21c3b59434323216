"""Quality rules: rule signals of a text, and the log-likelihood ratio of its
hashed n-grams between a trusted target and the raw corpus.

Words and word pairs are hashed to ``BUCKETS`` buckets. The raw multinomial
counts every n-gram of every row; the target multinomial those of a bounded,
reproducible sample of trusted rows. A text's score is the mean over its
n-grams of ``ln p_target - ln p_raw``; a fixed threshold decides. All of it is
DataFrame expressions: n-grams are exploded, joined with the bucket weights (a
table of ``BUCKETS`` rows at most, broadcast) and summed map-side per row, so
no text is shuffled. Weights are whole millionths, so sums do not depend on
their order.

Edge cases: null and empty texts have no words, score 0 and fail the base
rules; texts of under 8 words have no repeated window; repeated rows get one
result each; without trusted rows (or on an empty table) every score is 0;
added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, table, without, written

#: Hash buckets of words and word pairs.
BUCKETS = 1 << 16
#: Trusted rows that the target multinomial is fitted on: those with the smallest hash of their id.
TARGET_ROWS = 10_000
#: Added to a bucket's target count and to the count that the raw corpus lets
#: expect there, so an n-gram too rare to judge weighs next to nothing.
SMOOTHING = 10.0
#: Mean log-likelihood ratio per n-gram below which a text goes.
THRESHOLD = -0.12
_UNIT = 1_000_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def _grams(words: Column, df: DataFrame) -> DataFrame:
    """``df`` with ``__hw`` (hash of each word) and ``__h2`` (of each pair)."""
    df = df.withColumn("__hw", F.transform(words, lambda w: F.xxhash64(w)))
    pair = F.transform("__hw", lambda h, i: F.xxhash64(h, F.get("__hw", i + 1)))
    return df.withColumn("__h2", F.slice(pair, 1, F.greatest(F.size("__hw") - 1, F.lit(0))))


def _buckets() -> Column:
    return F.concat(F.transform("__hw", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")),
                    F.transform("__h2", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))


def bucket_weights(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(bucket, weight)``: the log-likelihood ratio of each n-gram bucket in
    millionths. ``trusted`` holds the ids (column ``key``) of at most
    ``TARGET_ROWS`` rows of the target; it is broadcast under that bound."""
    ids = F.broadcast(trusted.select(F.col(key).alias("__id")).distinct())
    rows = df.select(F.col(key).alias("__key"), _words(text).alias("__words"))
    rows = rows.join(ids, F.col("__key") == F.col("__id"), "left").select(
        "__words", F.col("__id").isNotNull().cast("long").alias("__target"))
    counts = (_grams(F.col("__words"), rows).select("__target", F.explode(_buckets()).alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("__target").alias("target")))
    counts = written(counts)
    total = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    raw, target = total["r"] or 0, total["t"] or 0
    if not target:
        return counts.select("bucket", F.lit(0).cast("long").alias("weight"))
    ratio = F.log((F.col("target") + SMOOTHING) / (F.col("raw") * (target / raw) + SMOOTHING))
    return counts.select("bucket", F.round(ratio * _UNIT).cast("long").alias("weight"))


def rule_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``BASE`` for the whole ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = without(df, *BASE).withColumn("__words", _words(text))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = (out.withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
           .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
           .withColumn("__lines", lines)
           .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
           .drop("__lines"))
    out = _grams(F.col("__words"), out)
    out = out.withColumn("__h4", F.transform("__h2", lambda h, i: F.xxhash64(h, F.get("__h2", i + 2))))
    windows = F.transform("__h4", lambda h, i: F.xxhash64(h, F.get("__h4", i + 4)))
    out = out.withColumn("__win", F.slice(windows, 1, F.greatest(F.size("__words") - 7, F.lit(0)))).drop("__h4")
    # equal windows stand next to each other once sorted by (hash, place)
    placed = F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    out = out.withColumn("__placed", F.when(some, placed)).drop("__win")
    twice = F.filter("__placed", lambda x, i: (F.get("__placed", i - 1)["h"] == x["h"])
                     | (F.get("__placed", i + 1)["h"] == x["h"]))
    out = out.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__placed")
    covered = F.aggregate(
        "__at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + 8 - F.greatest(a["end"] - x, F.lit(0))).alias("n"), (x + 8).alias("end")),
        lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__at")
    return out.withColumn("base_failed", (F.col("n_words") < 20)
                          | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def judge(df: DataFrame, weights: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: its columns but ``text``, those of ``BASE``,
    ``score`` (mean weight per n-gram) and ``kept`` (base rules passed and
    score not below ``threshold``)."""
    signals = rule_signals(without(df, "score", "kept"), text)
    keep = [c for c in signals.columns if not c.startswith("__") and c != text]
    # a row's n-grams are all in its own task: the sum per row is made there
    rows = signals.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`") for c in keep],
                          _buckets().alias("__buckets"))
    grams = rows.select("__row", *[F.col(f"`{c}`") for c in keep], F.explode_outer("__buckets").alias("__b"))
    w = F.broadcast(weights.select(F.col("bucket").alias("__bucket"), F.col("weight").alias("__weight")))
    out = (grams.join(w, F.col("__b") == F.col("__bucket"), "left")
           .groupBy("__row", *[F.col(f"`{c}`") for c in keep])
           .agg(F.coalesce(F.sum("__weight"), F.lit(0)).alias("__sum"), F.count("__b").alias("__n")))
    score = F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n") / _UNIT).otherwise(F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in keep], score.alias("score")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_sample(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the rows labelled of good quality, ``TARGET_ROWS`` at most."""
    good = labels.filter((F.col("quality") == 1) & F.col(key).isNotNull()).select(key).distinct()
    return good.orderBy(F.xxhash64(key), key).limit(TARGET_ROWS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = bucket_weights(docs, trusted_sample(table(spark, sf_dir, "labels")))
    return judge(docs, weights).select("doc_id", *BASE, "score", "kept")


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
