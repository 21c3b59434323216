"""Evidence records → documents (scan-side projections).

All of it is JVM-side expressions: JSON paths for the metadata, variant
casts for flattening, ``make_valid_utf8`` for the byte scrape, regular
expressions for HTML. The content column is projected away as soon as the
text is extracted, so it never enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension_of, html_to_text, is_term, is_unallocated, strip_control, tokens_of
from ..functions.text import type_priority
from .fields import leaves


META_SCHEMA = ("path string, name struct<name: string>, "
               "meta struct<size: double, mtime: double, crtime: double, atime: double>")


def parse_metadata(records: DataFrame) -> DataFrame:
    """Core fields from the JSON (parsed once per record), file and
    slack sizes. ``size`` = meta.size else the content length (numbers are
    truncated to integers); file = min(total, size), slack = max(total − size, 0)."""
    j = F.from_json(F.col("metadata"), META_SCHEMA)
    total = F.octet_length("content").cast("long")

    def num(c):
        return c.cast("long")

    r = records.select("*", j.alias("_m"))
    size = F.coalesce(num(F.col("_m.meta.size")), total)
    return r.select(
        *records.columns,
        F.coalesce(F.col("_m.path"), F.lit("")).alias("path"),
        F.coalesce(F.col("_m.name.name"), F.lit("")).alias("name"),
        F.coalesce(num(F.col("_m.meta.mtime")), F.lit(0)).cast("long").alias("modified"),
        F.coalesce(num(F.col("_m.meta.crtime")), F.lit(0)).cast("long").alias("created"),
        F.coalesce(num(F.col("_m.meta.atime")), F.lit(0)).cast("long").alias("accessed"),
        total.alias("total_size"),
        F.least(total, size).alias("file_size"),
        F.greatest(total - size, F.lit(0)).cast("long").alias("slack_size"))


def flatten_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """B2: nested JSON as (id, key, value) with keys joined by '-' and list
    places as keys; numbers are truncated to integers, booleans and nulls
    dropped; known keys are renamed (see :func:`scrutin.operators.fields.leaves`)."""
    return leaves(df, id_col, json_col).select(
        id_col, "key", F.coalesce(F.col("long").cast("string"), "string").alias("value"))


def scrape_text(content: Column) -> Column:
    """Decode UTF-8 (each malformed sequence becomes one space) and drop
    every character below 0x20 — ASCII stored as UTF-16LE survives."""
    return strip_control(decoded(content))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; a malformed sequence becomes one space."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.regexp_replace(F.make_valid_utf8(s), "�", " "))


def extract_text(name: Column, content: Column) -> Column:
    """Text by type — HTML loses its markup, everything else is scraped."""
    ext = extension_of(name)
    return F.when(ext.isin("html", "htm"), html_to_text(decoded(content))).otherwise(
        scrape_text(content))


def to_documents(recs: DataFrame) -> DataFrame:
    """File document and, when the record has slack, a
    slack document (``name:slack``, size = slack size, no extension, text
    from the tail bytes). Requires ``file_id``/``slack_id`` (A2) and the
    columns of :func:`parse_metadata`."""
    # a classified record carries the extension of its type
    ext = F.coalesce("extension_override", extension_of(F.col("name"))) if "extension_override" in recs.columns \
        else extension_of(F.col("name"))
    base = recs.select("file_id", "slack_id", "path", "name", "modified", "created", "accessed",
                       "file_size", "slack_size", "content", ext.alias("ext"))
    def doc(id_, name, ext, size, body, slack):
        return F.struct(F.col(id_).alias("ID"), name.alias("name"), "path", ext.alias("extension"),
                        F.col(size).alias("size"), "created", "modified", "accessed", body.alias("body"),
                        F.lit(slack).alias("is_slack"))

    # one scan: a record is exploded to its file and, if it has any, its slack
    file_doc = doc("file_id", F.col("name"), F.col("ext"), "file_size",
                   extract_text(F.col("name"), F.expr("substring(content, 1, file_size)")), False)
    slack_doc = doc("slack_id", F.concat("name", F.lit(":slack")), F.lit(""), "slack_size",
                    scrape_text(F.expr("substring(content, file_size + 1, slack_size)")), True)
    both = F.when(F.col("slack_size") > 0, F.array(file_doc, slack_doc)).otherwise(F.array(file_doc))
    docs = base.select(F.explode(both).alias("d")).select("d.*")
    return docs.select("*", F.length("body").cast("long").alias("body_len"),
                       is_unallocated(F.col("path")).alias("is_unallocated"),
                       type_priority(F.col("extension")).alias("priority"))


def with_ids(records: DataFrame) -> DataFrame:
    """Document ids of (seq, metadata, content) records: 2·seq for the file,
    2·seq + 1 for its slack."""
    return records.select("*", (F.col("seq") * 2).cast("string").alias("file_id"),
                          (F.col("seq") * 2 + 1).cast("string").alias("slack_id"))


def records_to_docs(records: DataFrame, stop_terms: list[str], empty: str = "coded", classifier=None) -> DataFrame:
    """The record → document job of batch and stream: (seq, metadata, content)
    records become file and slack documents, without those that B9 drops.
    ``classifier`` names the type of a record's content; unallocated files
    take its extension (B12–B14)."""
    parsed = parse_metadata(with_ids(records))
    docs = to_documents(parsed if classifier is None else classifier(parsed))
    return drop_empty(docs, stop_terms, empty)


def drop_empty(docs: DataFrame, stop_terms: list[str], mode: str = "coded") -> DataFrame:
    """Drop documents whose body yields no token after stop words.
    ``coded``: only unallocated and slack documents are tested; ``all``:
    every document. The stop list is a bounded literal set."""
    stops = F.array(*[F.lit(t) for t in sorted(set(stop_terms))]).cast("array<string>")
    has_token = F.exists(tokens_of(F.col("body")), lambda t: ~F.array_contains(stops, t) & is_term(t))
    if mode == "all":
        return docs.where(has_token)
    return docs.where(~(F.col("is_unallocated") | F.col("is_slack")) | has_token)  # others are not tokenised


def ingest_counters(records: DataFrame) -> DataFrame:
    """FilesRead, BytesRead (8 + json + 8 + content per record),
    FileBytesRead."""
    return records.agg(
        F.count(F.lit(1)).alias("files_read"),
        F.sum(F.lit(16) + F.octet_length("metadata") + F.octet_length("content")).cast("long").alias("bytes_read"),
        F.sum(F.octet_length("content")).cast("long").alias("file_bytes_read"))


def display_times(docs: DataFrame, zone: str | None = None) -> DataFrame:
    """Seconds → milliseconds and date strings, in ``zone`` (default: the
    session's time zone)."""
    out = docs
    for c in ("modified", "accessed", "created"):
        t = F.timestamp_seconds(c)
        if zone:
            t = F.convert_timezone(F.current_timezone(), F.lit(zone), t.cast("timestamp_ntz"))
        out = out.withColumn(f"{c}_ms", F.col(c) * 1000).withColumn(
            f"{c}_str", F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return out
