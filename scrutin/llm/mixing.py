"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled order (a hash of their id). Pass
after pass through a source, a document's virtual finish time is the words of
its source up to and including it, divided by the source's target. All copies
are sorted by finish time and the mix is cut where the word budget is full.

Sources get weights 1, 2, 3, repeating, in code-point order (null last) and
share the words of all documents; a target stops at ``MAX_PASSES`` times its
source's size and the excess is shared again by weight.

Running sums are made in two levels, so no source and no sort is one task: a
source of n rows is dealt to about sqrt(n) buckets by hash; sums inside the
buckets get the bucket totals before them as base. The cut is found from sums
per range partition, then inside the one partition that crosses the budget.

Edge cases: null or empty texts have size 0 and take nothing; sources without
words have target 0; repeated rows (also of one id) are rows of their own,
dealt to passes one after another; an empty table gives an empty mix. Added
columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, forget, table, without, written

MAX_PASSES = 3
#: Budget as a share of the words of all documents.
SHARE = 1.0
ADDED = ("size", "source_size", "target", "taken", "copies")


def source_targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """``(source, source_size, n, target)``, one row per source. The table has
    one row per source: its windows never see documents."""
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # an inline one-row window order over the source table
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last()))
    per = per.withColumn("w", ((rank - 1) % 3 + 1).cast("double"))
    full = W.partitionBy(F.lit(1))
    # sources in the order in which they reach MAX_PASSES times their size
    order = W.orderBy(F.col("cap") / F.col("w"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = (per.withColumn("cap", (MAX_PASSES * F.col("source_size")).cast("double"))
           .withColumn("budget", F.sum("source_size").over(full) * F.lit(SHARE))
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("w_left", F.sum("w").over(full) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           # level of water if all sources before this one are full and it is not
           .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
           .withColumn("open", F.col("level") * F.col("w") <= F.col("cap")))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return per.select(source, "source_size", "n", F.least("cap", F.coalesce(
        F.col("w") * level, F.col("cap"))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``df`` less ``text``, with ``size`` (words), ``source_size``,
    ``target`` (its source's), ``copies`` (whole copies the mix takes) and
    ``taken`` (their words)."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = without(df.withColumn("__size", words), text, *ADDED).withColumnRenamed("__size", "size")
    rows = written(rows.withColumn("__h", F.xxhash64(key, "size")))
    targets = written(source_targets(rows, source))
    src = targets.select(F.col(source).alias("__source"), "source_size", "n", "target")
    dealt = rows.join(F.broadcast(src) if _few(targets) else src, F.col(source).eqNullSafe(F.col("__source"))).drop(
        "__source")
    # about sqrt(n) buckets of about sqrt(n) rows for a source of n rows
    dealt = dealt.withColumn("__bucket", F.pmod(F.shiftright("__h", 20), F.ceil(F.sqrt("n"))).cast("long")).drop("n")
    order = ["__h", F.col(key).asc_nulls_last()]
    bucket = W.partitionBy(source, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = dealt.groupBy(source, "__bucket").agg(F.sum("size").alias("__sum"))
    before = W.partitionBy(source).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col(source).alias("__source"), F.col("__bucket").alias("__b"),
                       F.coalesce(F.sum("__sum").over(before), F.lit(0).cast("long")).alias("__base"))
    placed = dealt.withColumn("__within", F.sum("size").over(bucket)).join(
        base, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b"))).drop("__source", "__b")
    placed = written(placed.withColumn("__end", F.col("__base") + F.col("__within")).drop(
        "__bucket", "__within", "__base"))
    cut = _cut(placed)
    finish = [F.when(F.col("size") > 0, (F.col("__end") + p * F.col("source_size")) / F.col("target"))
              for p in range(MAX_PASSES)]
    if cut is None:
        copies = F.lit(0)
    else:
        f, h, d, p_cut = cut
        later = (F.col("__h") < F.lit(h)) | ((F.col("__h") == F.lit(h)) & (
            F.col("__end") <= F.lit(d)))
        copies = sum(F.when((finish[p] < F.lit(f)) | ((finish[p] == F.lit(f)) & (
            (F.lit(p) < F.lit(p_cut)) | ((F.lit(p) == F.lit(p_cut)) & later))), 1).otherwise(0)
            for p in range(MAX_PASSES))
    forget(rows)
    keep = [F.col(f"`{c}`") for c in placed.columns if not c.startswith("__")]
    return placed.select(*keep, copies.cast("int").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def _few(targets: DataFrame) -> bool:
    """Whether the source table is small enough to broadcast (100,000 rows)."""
    return targets.count() <= 100_000


def _cut(placed: DataFrame):
    """The last copy that the budget holds, as ``(finish, hash, end, pass)``:
    copies are range-sorted by finish time, partition sums find the partition
    that crosses the budget, a running sum inside it the copy."""
    spark = placed.sparkSession
    budget = placed.agg(F.sum("size").alias("s")).first()["s"] or 0
    budget = int(budget * SHARE)
    copies = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).select(
        "size", "__h", "__end", "source_size", "target",
        F.explode(F.array(*[F.lit(p) for p in range(MAX_PASSES)])).alias("__pass"))
    copies = copies.select("size", "__h", "__end", "__pass", (
        (F.col("__end") + F.col("__pass") * F.col("source_size")) / F.col("target")).alias("__f"))
    order = ["__f", "__pass", "__h", "__end"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(copies.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("size").alias("s")).orderBy("__part").collect()
    done, crossing = 0, None
    for r in sums:  # one row per range partition
        if done + r["s"] > budget:
            crossing = r["__part"]
            break
        done += r["s"]
    newest = [F.col(c).desc() for c in order]
    row = []
    if crossing is not None:
        run = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        held = ranged.filter(F.col("__part") == crossing).withColumn("__run", F.sum("size").over(run))
        row = held.filter(F.col("__run") <= budget - done).orderBy(*newest).limit(1).collect()
    if not row:  # the cut is the end of the partitions before
        rest = ranged if crossing is None else ranged.filter(F.col("__part") < crossing)
        row = rest.orderBy(*newest).limit(1).collect()
    forget(ranged)
    return (row[0]["__f"], row[0]["__h"], row[0]["__end"], row[0]["__pass"]) if row else None


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mix": op2_mix}
ORACLE_SQL: dict[str, str] = {}
