"""Helpers shared by the corpus operators: columns appended by Arrow kernels,
tables written to the shared folder, names of scratch columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, materialize

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: cuts
    lineage, survives lost executors and fixes the rows for later passes."""
    ensure_checkpoint_dir(df.sparkSession)
    return materialize(df, **options)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append_arrow(df: DataFrame, fields: list[T.StructField], inputs: list[str],
                 kernel: Callable[[list[pa.Array]], list[pa.Array]],
                 max_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with the columns ``fields`` that ``kernel`` computes from the
    Arrow arrays of ``inputs``. A batch is cut to slices of about ``max_bytes``
    so a task holds a bounded share of its rows (a single longer row is one
    slice). Columns of ``df`` named like a new field are replaced."""
    base = without(df, *[f.name for f in fields])
    # inputs that are replaced are carried beside the row under own names
    carried = base.select("*", *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)]) \
        if set(inputs) <= set(base.columns) else df.select(
            *[F.col(f"`{c}`") for c in base.columns],
            *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*base.schema.fields, *fields])
    width, n_in, names = len(base.columns), len(inputs), [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            start, n = 0, batch.num_rows
            step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
            while start < n:
                part = batch.slice(start, min(step, n - start))
                start += part.num_rows
                cols = part.columns
                new = kernel(cols[width:width + n_in])
                yield pa.RecordBatch.from_arrays([*cols[:width], *new], names=names)

    return carried.mapInArrow(run, schema)
