"""Readers and writers: driver tables, the evidence view, evidence records,
stop lists and the parquet index tables."""
