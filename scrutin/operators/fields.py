"""Metadata of any shape as a table of typed fields.

Every key of a record's JSON becomes rows ``(ID, key, string, long, time)``:
nested keys and list places are joined by '-', known keys are renamed, strings
go to ``string``, numbers (truncated) to ``long``, booleans and nulls are
dropped. ``time`` holds the moment, in microseconds since 1970, of strings that
begin with a calendar date and of numbers under a key that names a time, read
as seconds (a whole number, as files keep no bounds of their own timestamps). The index keeps the table in
the order of (key, long, string), so that a clause on any key reads the row
groups of that key's values only.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import materialize

COLUMNS = ("ID", "key", "string", "long", "time")
#: Columns by which the files are dealt and sorted; the id divides equal values.
ORDER = ("key", "long", "string", "ID")

_DATE = r"^\d{4}-\d{2}-\d{2}"
_TIME_KEY = r"(?:^|-)(?:[a-z]*time|modified|created|accessed)$"


def leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, key, string, long)`` of every leaf of a JSON text. Every level is
    one lateral explode of the values that are still objects or lists, written
    to the shared folder; levels follow until no object or list is left, so
    the input is read once and nesting may be of any depth. Text that is no
    JSON has no leaves."""
    kind = F.schema_of_variant("v")
    # variant values cannot be written to every file format; their JSON text can
    cur = df.select(F.col(id_col).alias("_id"), F.lit(None).cast("string").alias("key"),
                    F.col(json_col).alias("js"))
    found = None
    while True:
        row = cur.select("_id", "key", F.try_parse_json("js").alias("v")).withColumn("kind", kind)
        obj = F.when(F.col("kind").startswith("OBJECT"), F.map_entries(F.col("v").cast("map<string,variant>")))
        arr = F.when(F.col("kind").startswith("ARRAY"), F.transform(
            F.col("v").cast("array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
        leaf = F.when(~F.col("kind").startswith("OBJECT") & ~F.col("kind").startswith("ARRAY") & F.col("key").isNotNull(),
                      F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value"))))
        each = row.select("_id", "key", F.explode(F.coalesce(obj, arr, leaf)).alias("e"))
        each = each.select("_id", F.when(F.col("e.key").isNull(), F.col("key")).when(
            F.col("key").isNull(), F.col("e.key")).otherwise(F.concat_ws("-", "key", "e.key")).alias("key"),
            F.col("e.value").alias("v")).withColumn("kind", kind)
        is_num = F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | F.col(
            "kind").startswith("DECIMAL")
        deeper = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        whole = F.col("kind").isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        level = materialize(each.where(~F.col("kind").isin("BOOLEAN", "VOID")).select(
            "_id", "key", F.when(deeper, F.to_json("v")).alias("js"), deeper.alias("deeper"),
            F.when(F.col("kind") == "STRING", F.col("v").cast("string")).alias("string"),
            F.when(whole, F.col("v").cast("long")).when(is_num, F.col("v").cast("double").cast("long")).alias("long")))
        done = level.where(~F.col("deeper")).select("_id", "key", "string", "long")
        found = done if found is None else found.unionByName(done)
        cur = level.where("deeper").select("_id", "key", "js")
        if cur.isEmpty():
            break
    ren = F.col("key")
    for old, new in K.FIELD_RENAMES.items():
        ren = F.when(F.col("key") == old, F.lit(new)).otherwise(ren)
    return found.select(F.col("_id").alias(id_col), ren.alias("key"), "string", "long")


def as_time(key: Column, string: Column, long: Column) -> Column:
    """The moment that a field's value names, if it names one."""
    return F.coalesce(F.when(string.rlike(_DATE), F.unix_micros(F.try_to_timestamp(string))),
                      F.when(key.rlike(_TIME_KEY) & (F.abs("long") < 1 << 43), long * 1_000_000))


def micros(moment: datetime.date) -> int:
    """A date (its begin), or a date and time (UTC if it names no zone)."""
    if not isinstance(moment, datetime.datetime):
        moment = datetime.datetime(moment.year, moment.month, moment.day)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=datetime.UTC)
    return (moment - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


def metadata_fields(records: DataFrame) -> DataFrame:
    """Typed fields of records with ``file_id``, ``slack_id``, ``name``,
    ``slack_size`` and ``metadata``: all keys for the file document; the same
    for a slack document, but for its size and its name."""
    ids = F.when(F.col("slack_size") > 0, F.array("file_id", "slack_id")).otherwise(F.array("file_id"))
    owner = F.struct(ids.alias("ids"), F.col("slack_size").alias("slack"))
    f = leaves(records.select(owner.alias("owner"), "metadata"), "owner", "metadata")
    f = f.select(F.posexplode("owner.ids").alias("is_slack", "ID"), F.col("owner.slack").alias("slack"), "key", "string", "long")
    slack = F.col("is_slack") == 1
    f = f.select("ID", "key",
                 F.when(slack & (F.col("key") == "name"), F.concat("string", F.lit(":slack"))).otherwise(F.col("string")).alias("string"),
                 F.when(slack & (F.col("key") == "size"), F.col("slack")).otherwise(F.col("long")).alias("long"))
    return f.select("ID", "key", "string", "long", as_time(F.col("key"), F.col("string"), F.col("long")).alias("time"))


def ordered(fields: DataFrame, files: int | None = None) -> DataFrame:
    """``fields`` dealt to files and sorted by key and value."""
    dealt = fields.repartitionByRange(files, *ORDER) if files else fields.repartitionByRange(*ORDER)
    return dealt.sortWithinPartitions(*ORDER).select(*COLUMNS)


def equals(fields: DataFrame, key: str, value) -> DataFrame:
    """D3 on any key: ids of the documents whose field is exactly ``value``."""
    column = "string" if isinstance(value, str) else "long"
    return fields.where((F.col("key") == key) & (F.col(column) == F.lit(value))).select("ID").distinct()


def within(fields: DataFrame, key: str, lo, hi, include_lo: bool = True, include_hi: bool = True) -> DataFrame:
    """D14 on any key: ids of the documents whose field lies in a range of
    strings, numbers, or dates and times, by the type of the bounds."""
    bound = lo if lo is not None else hi
    column = "string" if isinstance(bound, str) else "time" if isinstance(bound, datetime.date) else "long"
    if column == "time":
        lo, hi = (None if x is None else micros(x) for x in (lo, hi))
    return fields.where((F.col("key") == key) & F.col(column).isNotNull() & between(
        F.col(column), lo, hi, include_lo, include_hi)).select("ID").distinct()


def between(c: Column, lo, hi, include_lo: bool, include_hi: bool) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c >= F.lit(lo)) if include_lo else (c > F.lit(lo)))
    if hi is not None:
        cond = cond & ((c <= F.lit(hi)) if include_hi else (c < F.lit(hi)))
    return cond
