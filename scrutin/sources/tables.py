"""Input tables and the evidence view over ``documents``.

The evidence view gives every generated document the fields of a file found on
a disk image (name, path, extension, times, allocation state) by pure
arithmetic on ``doc_id``, so the same rows can be produced in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import literal_frame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

REF_DATE_MS = 1400000000000

_EXTS = ["txt", "html", "pdf", "xls", "sqlite", "lnk", "exe", ""]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ext_expr(doc_id):
    m = doc_id % 8
    e = F.when(m == 0, F.lit(_EXTS[0]))
    for i in range(1, 8):
        e = e.when(m == i, F.lit(_EXTS[i]))
    return e


def evidence_view(documents: DataFrame, *more) -> DataFrame:
    """Core ``docs`` schema over the driver's ``documents`` table; ``more``
    columns of a document go along."""
    d = F.col("doc_id")
    ext = _ext_expr(d)
    path = (F.when(d % 5 == 4, F.lit("$Unallocated/"))
            .when(d % 3 == 0, F.lit("WINDOWS/system32/"))
            .when(d % 3 == 1, F.lit("home/from/"))
            .otherwise(F.lit("Users/notes/")))
    return documents.select(
        (d * 2).cast("string").alias("ID"),
        F.concat(F.lit("doc"), d.cast("string"), F.when(ext == "", F.lit("")).otherwise(
            F.concat(F.lit("."), ext))).alias("name"),
        path.alias("path"),
        ext.alias("extension"),
        F.col("n_chars").cast("long").alias("size"),
        (F.lit(1300000000) + d * 3600).cast("long").alias("created"),
        (F.lit(1300086400) + d * 3600).cast("long").alias("modified"),
        (F.lit(1300172800) + d * 3600).cast("long").alias("accessed"),
        F.col("text").alias("body"),
        F.length("text").cast("long").alias("body_len"),
        (d % 5 == 4).alias("is_unallocated"),
        F.lit(False).alias("is_slack"),
        *more,
    )


def slack_rows(documents: DataFrame) -> DataFrame:
    """Slack documents: every tenth document gets a slack twin holding the
    last 200 characters, id ``2n+1``, name + ':slack', no extension."""
    ev = evidence_view(documents.filter(F.col("doc_id") % 10 == 0))
    return ev.select(
        (F.col("ID").cast("long") + 1).cast("string").alias("ID"),
        F.concat(F.col("name"), F.lit(":slack")).alias("name"),
        "path",
        F.lit("").alias("extension"),
        F.least(F.col("body_len"), F.lit(200)).cast("long").alias("size"),
        "created", "modified", "accessed",
        F.expr("substring(body, greatest(length(body) - 199, 1))").alias("body"),
        F.least(F.col("body_len"), F.lit(200)).cast("long").alias("body_len"),
        "is_unallocated",
        F.lit(True).alias("is_slack"),
    )


def evidence_docs(spark: SparkSession, sf_dir: str, with_slack: bool = False) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ev = evidence_view(docs)
    if with_slack:
        ev = ev.unionByName(slack_rows(docs))
    return ev


def derived_bookmarks(docs: DataFrame) -> DataFrame:
    """Bookmarks derived from the evidence view, in long form (one row per
    bookmark and document): for k in (0,1,2,3,4,25) a bookmark ``note k``
    holding the documents with ``doc_id % 25 == k % 25``. Long form keeps a
    bookmark's document list distributed however large it grows."""
    spark = docs.sparkSession
    ks = literal_frame(spark, (0, 1, 2, 3, 4, 25), "k", "int")
    ids = docs.select("ID", ((F.col("ID").cast("long") / 2).cast("long") % 25).alias("m"))
    # six bookmark keys: a fixed-size side, broadcast by construction
    return (ids.join(F.broadcast(ks), ks.k % 25 == ids.m)
            .select(F.concat(F.lit("b"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("Bookmark"),
                    F.concat(F.lit("note "), F.col("k").cast("string")).alias("Comment"),
                    (F.lit(1500000000000) + F.col("k") * 1000).cast("long").alias("Created"),
                    "ID"))
