"""A3: stop list = analyzer defaults + single characters + lines of a file.

Matching is case-insensitive, so every entry is lower-cased. ``spark.read.text``
splits LF, CR and CRLF lines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import literal_frame


def default_stop_terms() -> list[str]:
    return list(K.DEFAULT_STOP_WORDS) + list(K.STOP_CHARS)


def stop_list(spark: SparkSession, path: str | None = None,
              extra: list[str] | None = None) -> DataFrame:
    """(term string) — one row per distinct lower-cased stop term."""
    base = literal_frame(spark, default_stop_terms() + list(extra or []), "term")
    if path:
        lines = spark.read.text(path).select(F.col("value").alias("term"))
        base = base.unionByName(lines)
    return base.select(F.lower("term").alias("term")).where(F.col("term") != "").distinct()
