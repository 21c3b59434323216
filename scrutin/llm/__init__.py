"""Operators of a large-scale training-data pipeline, each with its registered
query. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from . import (bpe, decontaminate, extract, license, minhash, mixing, negatives, quality, repair, topk,
               toxicity, urlfilter, warc)

MODULES = (minhash, mixing, toxicity, bpe, warc, topk, extract, urlfilter, quality, license,
           decontaminate, negatives, repair)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
