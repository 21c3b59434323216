"""Incremental ingest — records landing as parquet files join the index by
the same job as a batch of records (:func:`scrutin.plans.index.add_records`),
so a streamed index opens and searches like a batch one.

Each micro-batch is one generation and one version of the manifest. Full
levels of generations are merged as part of the write, so the number of files
stays bounded however many micro-batches there were, and opening the index
aggregates nothing. ``foreachBatch`` is at-least-once: a replayed micro-batch,
like a file landed twice, holds only records whose keys the index already has,
and changes nothing. The stream's progress lives in a checkpoint under the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import generations as G
from ..plans.index import add_records, open_index

RECORD_SCHEMA = "seq long, metadata string, content binary"


def process_batch(stops: DataFrame, index_path: str, classifier=None):
    def run(batch: DataFrame, batch_id: int) -> None:
        add_records(batch, stops, index_path, classifier)
    return run


def start_ingest(spark: SparkSession, landing_dir: str, index_path: str, checkpoint: str,
                 stops: DataFrame, files_per_trigger: int = 1, available_now: bool = True):
    """Start the stream; with ``available_now`` it processes what has landed
    and stops."""
    src = (spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(landing_dir))
    w = src.writeStream.foreachBatch(process_batch(stops, index_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def ingest_counters(spark: SparkSession, index_path: str) -> DataFrame:
    """B16 totals over all records that the index holds."""
    names = ("files_read", "bytes_read", "file_bytes_read")
    manifest = G.latest(spark, index_path) or G.EMPTY
    return spark.range(1).select(*[F.lit(manifest[k]).cast("long").alias(k) for k in names])


def streamed_term_stats(spark: SparkSession, index_path: str) -> DataFrame:
    """(term, df, ttf) summed over the appended batches."""
    return open_index(spark, index_path).term_stats
