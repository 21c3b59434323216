"""Cluster job: feature terms → document vectors → SOM epochs → assignment →
map analytics. Vectors, weights and assignments are written to the shared
folder (A6, A7) and reused by every later step."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from ..operators import cellmap as C
from ..operators import som as S
from ..session import scratch_path
from .index import Index, _built, _remove, _touch


@dataclass
class ClusterResult:
    cfg: S.SomConfig
    features: DataFrame       # (term, df, idx)
    vectors: DataFrame        # (ID, features)
    weights: DataFrame        # (cell, w)
    epochs: DataFrame         # (epoch, alpha, radius, docs, matched)
    assignments: DataFrame    # (ID, cell, som_x, som_y, som_cell_distance)
    dims: int

    def stats(self) -> DataFrame:
        return S.cell_stats(self.assignments, self.cfg)

    def tops(self) -> DataFrame:
        return C.top_terms(self.weights, self.features, self.cfg.top_terms)

    def regions(self) -> DataFrame:
        return C.regions(self.tops())

    def adjacency(self) -> DataFrame:
        return C.region_adjacency(self.regions(), self.cfg)

    def diffs(self) -> DataFrame:
        return C.term_differences(self.weights, self.features, self.cfg)


def run_cluster(ix: Index, cfg: S.SomConfig, path: str) -> ClusterResult:
    """Vectors, map and assignments at ``path``. A run that was stopped while
    it trained is resumed behind its last whole epoch; a finished one is made
    anew. The path belongs to one version of the index and one configuration."""
    spark = ix.spark
    if _built(spark, path):
        _remove(spark, f"{path}/_BUILT")  # a failed run must not look like a finished one
        _remove(spark, f"{path}/training")
    num_docs = ix.corpus_row()[0]
    feats = S.feature_terms(ix.term_stats, num_docs, cfg)
    feats.write.mode("overwrite").parquet(f"{path}/features")
    feats = spark.read.parquet(f"{path}/features")
    dims = feats.count()
    S.doc_vectors(ix.docs, ix.doc_terms, feats).write.mode("overwrite").parquet(f"{path}/doc_vectors")
    vec = spark.read.parquet(f"{path}/doc_vectors")
    trained = S.train(vec, cfg, dims, path=f"{path}/training")
    trained.weights.write.mode("overwrite").parquet(f"{path}/som_weights")
    trained.epochs.write.mode("overwrite").parquet(f"{path}/epochs")
    S.assign(vec, trained).write.mode("overwrite").parquet(
        f"{path}/assignments")
    _touch(spark, f"{path}/_BUILT")
    _remove(spark, f"{path}/training")
    return open_cluster(ix, cfg, path)


def open_cluster(ix: Index, cfg: S.SomConfig, path: str) -> ClusterResult:
    r = ix.spark.read
    feats = r.parquet(f"{path}/features")
    return ClusterResult(cfg, feats, r.parquet(f"{path}/doc_vectors"), r.parquet(f"{path}/som_weights"),
                         r.parquet(f"{path}/epochs"), r.parquet(f"{path}/assignments"), feats.count())


def cluster_for(ix: Index, cfg: S.SomConfig, rebuild: bool = False) -> ClusterResult:
    from .. import CODE_VERSION as __version__
    key = hashlib.md5(f"{ix.path}|{ix.version}|{sorted(asdict(cfg).items())}|{__version__}".encode()).hexdigest()[:16]
    path = scratch_path(ix.spark, "som", key)
    from .index import _BUILD_LOCK
    with _BUILD_LOCK:
        if rebuild or not _built(ix.spark, path):
            return run_cluster(ix, cfg, path)
    return open_cluster(ix, cfg, path)
