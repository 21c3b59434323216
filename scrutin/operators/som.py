"""Feature selection, document vectors and the self-organizing map.

Training is the batch form of the sequential rule ``w ← (1−α)w + αx``: with the
winners of an epoch fixed, a cell whose neighbourhood received ``n`` documents,
``m_t`` of which contain term ``t``, becomes
``w'_t = (1−α)^n · w_t + (1 − (1−α)^n) · m_t / n`` (unchanged when n = 0).

The weights live in a table of blocks, (cell block, feature block, numbers),
and never on the driver. Per epoch
1. documents, dealt to groups of bounded size, meet each block of cells (all
   its features); a task finds the nearest cell of the block with one matrix
   product per thousand documents. With one block of cells the task counts its
   winners at once, documents per cell and terms per (cell, feature); with
   more, the nearest of all blocks is taken first;
2. a ``groupBy`` finishes the counts, so a hot cell costs one row per task;
3. each block of features (all its cells) takes its counts, sums them over the
   square neighbourhoods by two-dimensional prefix sums, and updates its part
   of the weights;
4. the new blocks are written to the training folder. A job that starts again
   with the same folder goes on behind the last epoch that was written whole.
The same neighbourhood sums and update also exist as DataFrame operators
(:func:`neighbourhood_sums`, :func:`update_weights`), checked against SQL.
Only counts are aggregated, so results do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import bounded_broadcast, default_parallelism, scratch_path, spread


#: A matrix that is collected for inspection may not exceed this many bytes.
MAX_MATRIX_BYTES = 2 << 30
#: Bytes of a block of weights; documents that meet it at once.
BLOCK_BYTES, GROUP_DOCS = 16 << 20, 1 << 16


@dataclass(frozen=True)
class SomConfig:
    width: int = K.SOM_DEFAULTS["som_width"]
    height: int = K.SOM_DEFAULTS["som_height"]
    max_vector_features: int = K.SOM_DEFAULTS["max_vector_features"]
    doc_freq_low: float = K.SOM_DEFAULTS["doc_freq_threshold_low"]
    doc_freq_high: float = K.SOM_DEFAULTS["doc_freq_threshold_high"]
    min_term_length: int = K.SOM_DEFAULTS["min_som_term_length"]
    max_radius: int = K.SOM_DEFAULTS["max_neighbor_radius"]
    min_radius: int = K.SOM_DEFAULTS["min_neighbor_radius"]
    max_alpha: float = K.SOM_DEFAULTS["max_alpha"]
    min_alpha: float = K.SOM_DEFAULTS["min_alpha"]
    iterations: int = K.SOM_DEFAULTS["num_som_iterations"]
    top_terms: int = K.SOM_DEFAULTS["num_top_cell_terms"]
    seed: int = K.SOM_DEFAULTS["random_seed"]

    @property
    def cells(self) -> int:
        return self.width * self.height

    def schedule(self) -> list[tuple[float, int]]:
        """(alpha, radius) per epoch — both fall linearly from max to
        min, stepped by repeated subtraction; the radius is truncated."""
        n = self.iterations
        a_step = (self.max_alpha - self.min_alpha) / (n - 1) if n > 1 else 0.0
        r_step = (float(self.max_radius) - self.min_radius) / (n - 1) if n > 1 else 0.0
        alpha, radius, out = self.max_alpha, float(self.max_radius), []
        for _ in range(n):
            out.append((alpha, int(radius)))
            radius -= r_step
            alpha -= a_step
        return out


SHIPPED = SomConfig(width=30, height=30, max_vector_features=1000, max_radius=15, min_radius=1,
                    max_alpha=0.005, min_alpha=0.001, iterations=4, top_terms=10)


# ------------------------------------------------------------ G1–G5

def feature_terms(term_stats: DataFrame, num_docs: int, cfg: SomConfig) -> DataFrame:
    """(term, df, idx) — terms whose document ratio lies in
    [low, high] and whose length is at least the minimum, the ``k`` most
    frequent (ties by term); idx 0 is the most frequent. ``k`` is a
    configuration bound, so the ranked set is small."""
    r = F.col("df") / F.lit(float(num_docs))
    cand = term_stats.where((r >= cfg.doc_freq_low) & (r <= cfg.doc_freq_high)
                            & (F.length("term") >= cfg.min_term_length))
    top = cand.orderBy(F.col("df").desc(), F.col("term")).limit(cfg.max_vector_features)
    w = Window.orderBy(F.col("df").desc(), F.col("term"))
    return top.select("term", "df", (F.row_number().over(w) - 1).cast("int").alias("idx"))


def doc_vectors(docs: DataFrame, doc_terms: DataFrame, features: DataFrame) -> DataFrame:
    """(ID, features array<int>) sorted indices of a document's feature
    terms; documents without any keep an empty vector (G4 outliers)."""
    f = bounded_broadcast(features.select("term", "idx"))
    v = (doc_terms.select("ID", "term").join(f, "term")
         .groupBy("ID").agg(F.sort_array(F.collect_list("idx")).alias("features")))
    return (docs.select("ID").join(v, "ID", "left")
            .select("ID", F.coalesce("features", F.array().cast("array<int>")).alias("features")))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Documents written, outliers, max and average terms (non-outliers)."""
    n = F.size("features")
    return vectors.agg(
        F.count(F.lit(1)).alias("num_docs"),
        F.count_if(n == 0).alias("num_outliers"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_doc_terms"),
        F.avg(F.when(n > 0, n)).alias("avg_doc_terms"))


# ------------------------------------------------------------ G6–G7

def initial_weights(spark: SparkSession, cfg: SomConfig, dims: int) -> DataFrame:
    """(cell, w array<double>) — a reproducible integer-hash uniform in
    [0, 1) per (cell, idx, seed)."""
    cells = spark.range(cfg.cells).select(F.col("id").cast("int").alias("cell"))
    idx = F.sequence(F.lit(0), F.lit(dims - 1)) if dims > 0 else F.array().cast("array<int>")
    w = F.transform(idx, lambda i: ((F.col("cell").cast("long") * 7919 + i.cast("long") * 104729
                                     + F.lit(cfg.seed * 31)) % 1000003) / F.lit(1000003.0))
    return cells.select("cell", w.alias("w"))


def squared_norms(weights: DataFrame) -> DataFrame:
    """(cell, s2 = Σ w²)."""
    return weights.select("cell", F.aggregate("w", F.lit(0.0), lambda acc, v: acc + v * v).alias("s2"))


def weight_matrix(weights: DataFrame, cfg: SomConfig, dims: int) -> np.ndarray:
    """The (cells × dims) matrix as numpy, to inspect small maps: 8 bytes ×
    features × height × width. Training and assignment do without it."""
    if 8 * cfg.cells * max(dims, 1) > MAX_MATRIX_BYTES:
        raise ValueError("the weight matrix is too large to collect")
    tbl = weights.select("cell", "w").toArrow()
    mat = np.zeros((cfg.cells, dims), dtype=np.float64)
    cells = tbl.column("cell").to_numpy()
    if dims:
        flat = tbl.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        mat[cells] = flat.reshape(len(cells), dims)
    return mat


# ------------------------------------------------------------ G8–G9 batch kernels

def _nearest(mat: np.ndarray, s2: np.ndarray, offsets: np.ndarray, flat: np.ndarray,
             chunk_docs: int = 1024, clip: bool = True):
    """Winner (lowest id on ties) and squared distance
    ``|x| + Σw² − 2·Σ_{t∈x} w_t`` for each non-empty document: the binary
    document vectors of a chunk are laid out densely and multiplied with the
    weight matrix (one BLAS call per chunk)."""
    cells, dims = mat.shape
    wt = np.ascontiguousarray(mat.T)
    n = len(offsets) - 1
    win = np.empty(n, dtype=np.int32)
    dist = np.empty(n, dtype=np.float64)
    for i in range(0, n, chunk_docs):
        j = min(i + chunk_docs, n)
        lo, hi = offsets[i], offsets[j]
        rows = np.repeat(np.arange(j - i), np.diff(offsets[i:j + 1]))
        x = np.zeros((j - i, dims), dtype=np.float64)
        x[rows, flat[lo:hi]] = 1.0
        k = np.diff(offsets[i:j + 1]).astype(np.float64)
        d = k[:, None] + s2[None, :] - 2.0 * (x @ wt)
        a = np.argmin(d, axis=1)
        win[i:j] = a
        dist[i:j] = d[np.arange(j - i), a]
    return win, np.maximum(dist, 0.0) if clip else dist


def _vectors_of(batch: pa.RecordBatch):
    col = batch.column(batch.schema.get_field_index("features"))
    offsets = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets - offsets[0], flat[offsets[0]:offsets[-1]] if len(flat) else flat


def assign_cells(vectors: DataFrame, bmat, cfg: SomConfig) -> DataFrame:
    """(ID, cell string, som_x, som_y, som_cell_distance); empty
    vectors are outliers with cell "-1" and null coordinates."""
    width = cfg.width

    def run(batches):
        mat = bmat.value
        s2 = (mat * mat).sum(axis=1)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ID"))
            offsets, flat = _vectors_of(b)
            sizes = np.diff(offsets)
            keep = np.nonzero(sizes > 0)[0]
            cell = np.full(len(sizes), -1, dtype=np.int64)
            dist = np.full(len(sizes), np.nan)
            if len(keep):
                sub_off = np.concatenate([[0], np.cumsum(sizes[keep])])
                sub_flat = np.concatenate([flat[offsets[k]:offsets[k + 1]] for k in keep])
                w, d = _nearest(mat, s2, sub_off, sub_flat)
                cell[keep], dist[keep] = w, d
            has = cell >= 0
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(cell.astype(str)),
                pa.array(np.where(has, cell % width, 0).astype(np.int32), mask=~has),
                pa.array(np.where(has, cell // width, 0).astype(np.int32), mask=~has),
                pa.array(dist, mask=~has)],
                names=["ID", "cell", "som_x", "som_y", "som_cell_distance"])

    return spread(vectors.select("ID", "features")).mapInArrow(
        run, "ID string, cell string, som_x int, som_y int, som_cell_distance double")


def cell_distances(vectors: DataFrame, bmat, cfg: SomConfig) -> DataFrame:
    """(ID, cell, distance) for every non-empty document and every cell —
    an inspection operator for small maps."""
    def run(batches):
        mat = bmat.value
        s2 = (mat * mat).sum(axis=1)
        cells = mat.shape[0]
        for b in batches:
            ids = b.column(b.schema.get_field_index("ID")).to_pylist()
            offsets, flat = _vectors_of(b)
            for r, doc in enumerate(ids):
                x = flat[offsets[r]:offsets[r + 1]]
                if not len(x):
                    continue
                d = np.maximum(len(x) + s2 - 2.0 * mat[:, x].sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * cells), pa.array(np.arange(cells, dtype=np.int32)), pa.array(d)],
                    names=["ID", "cell", "distance"])

    return vectors.select("ID", "features").mapInArrow(run, "ID string, cell int, distance double")


def winner_counts(vectors: DataFrame, bmat, dims: int) -> DataFrame:
    """Per-task partial counts for one epoch: (winner, idx, cnt) where
    idx = -1 carries the number of documents won by the cell."""
    def run(batches):
        mat = bmat.value
        s2 = (mat * mat).sum(axis=1)
        acc: dict[int, int] = {}
        for b in batches:
            offsets, flat = _vectors_of(b)
            sizes = np.diff(offsets)
            if not len(sizes) or sizes.min() == 0:
                keep = np.nonzero(sizes > 0)[0]
                if not len(keep):
                    continue
                flat = np.concatenate([flat[offsets[k]:offsets[k + 1]] for k in keep])
                sizes = sizes[keep]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
            win, _ = _nearest(mat, s2, offsets, flat)
            keys = np.concatenate([np.repeat(win.astype(np.int64), sizes) * (dims + 1) + flat + 1,
                                   win.astype(np.int64) * (dims + 1)])
            u, c = np.unique(keys, return_counts=True)
            for k_, c_ in zip(u.tolist(), c.tolist()):
                acc[k_] = acc.get(k_, 0) + c_
        if acc:
            keys = np.fromiter(acc.keys(), dtype=np.int64, count=len(acc))
            cnt = np.fromiter(acc.values(), dtype=np.int64, count=len(acc))
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys // (dims + 1)).astype(np.int32)),
                 pa.array((keys % (dims + 1) - 1).astype(np.int32)), pa.array(cnt)],
                names=["winner", "idx", "cnt"])

    return (vectors.where(F.size("features") > 0).select("features")
            .mapInArrow(run, "winner int, idx int, cnt long")
            .groupBy("winner", "idx").agg(F.sum("cnt").alias("cnt")))


# ------------------------------------------------------------ G10–G12

def _offsets(spark: SparkSession, n: int, radius: int, a: str, b: str) -> DataFrame:
    """Pairs (a, b) of coordinates in [0, n) with |a − b| <= radius: at most
    n·(2r+1) rows, fixed by the map configuration."""
    r = max(radius, 0)
    base = spark.range(n).select(F.col("id").cast("int").alias(a))
    return base.select(a, F.explode(F.sequence(F.greatest(F.col(a) - r, F.lit(0)),
                                               F.least(F.col(a) + r, F.lit(n - 1)))).alias(b))


def neighbourhood_sums(counts: DataFrame, cfg: SomConfig, radius: int) -> DataFrame:
    """G10 applied to counts: for every cell c, Σ cnt over winners within the
    clipped square of ``radius`` around c, per idx. Separable: x, then y."""
    spark = counts.sparkSession
    c = counts.select((F.col("winner") % cfg.width).alias("wx"),
                      (F.col("winner") / cfg.width).cast("int").alias("wy"), "idx", "cnt")
    xs = F.broadcast(_offsets(spark, cfg.width, radius, "wx", "cx"))
    ys = F.broadcast(_offsets(spark, cfg.height, radius, "wy", "cy"))
    sx = c.join(xs, "wx").groupBy("cx", "wy", "idx").agg(F.sum("cnt").alias("cnt"))
    sy = sx.join(ys, "wy").groupBy("cx", "cy", "idx").agg(F.sum("cnt").alias("cnt"))
    return sy.select((F.col("cy") * cfg.width + F.col("cx")).cast("int").alias("cell"), "idx", "cnt")


def update_weights(weights: DataFrame, sums: DataFrame, alpha: float) -> DataFrame:
    """G11 (batch form): ``w' = (1−α)^n w + (1 − (1−α)^n) m / n``."""
    n = sums.where(F.col("idx") == -1).select("cell", F.col("cnt").alias("n"))
    m = (sums.where(F.col("idx") >= 0).groupBy("cell")
         .agg(F.map_from_arrays(F.collect_list("idx"), F.collect_list("cnt")).alias("m")))
    j = weights.join(n, "cell", "left").join(m, "cell", "left")
    keep = F.pow(F.lit(1.0 - alpha), F.coalesce(F.col("n"), F.lit(0)).cast("double"))
    new_w = F.transform("w", lambda v, i: F.when(
        F.coalesce(F.col("n"), F.lit(0)) > 0,
        keep * v + (F.lit(1.0) - keep)
        * F.coalesce(F.element_at(F.col("m"), i), F.lit(0)).cast("double") / F.col("n")
    ).otherwise(v))
    return j.select("cell", new_w.alias("w"))


@dataclass
class TrainedMap:
    cfg: SomConfig
    dims: int
    weights: DataFrame          # (cell, w)
    epochs: DataFrame           # G13: (epoch, alpha, radius, docs, matched)
    blocks: DataFrame | None = None  # (cblock, fblock, w)


def initial_matrix(cfg: SomConfig, dims: int) -> np.ndarray:
    """G6 as a matrix — the same integer hash as :func:`initial_weights`."""
    cell = np.arange(cfg.cells, dtype=np.int64)[:, None]
    idx = np.arange(dims, dtype=np.int64)[None, :]
    return ((cell * 7919 + idx * 104729 + cfg.seed * 31) % 1000003) / 1000003.0


def _box_sum(grid: np.ndarray, r: int) -> np.ndarray:
    """Sum over the clipped square of radius r around every (y, x) of a
    (H, W, …) array, via prefix sums (separable)."""
    out = grid
    for axis in (0, 1):
        n = out.shape[axis]
        c = np.cumsum(out, axis=axis)
        zero = np.zeros_like(np.take(c, [0], axis=axis))
        c = np.concatenate([zero, c], axis=axis)
        hi = np.minimum(np.arange(n) + r + 1, n)
        lo = np.maximum(np.arange(n) - r, 0)
        out = np.take(c, hi, axis=axis) - np.take(c, lo, axis=axis)
    return out


def epoch_update(mat: np.ndarray, counts, cfg: SomConfig, alpha: float, radius: int) -> np.ndarray:
    """G10/G11 on the map-sized count table (≤ cells × (features + 1) rows):
    neighbourhood sums by prefix sums, then the closed-form batch update."""
    cells, dims = mat.shape
    win = counts.column("winner").to_numpy()
    idx = counts.column("idx").to_numpy()
    cnt = counts.column("cnt").to_numpy().astype(np.float64)
    n = np.zeros(cells)
    m = np.zeros((cells, dims))
    doc = idx < 0
    np.add.at(n, win[doc], cnt[doc])
    np.add.at(m, (win[~doc], idx[~doc]), cnt[~doc])
    n = _box_sum(n.reshape(cfg.height, cfg.width), radius).reshape(cells)
    m = _box_sum(m.reshape(cfg.height, cfg.width, dims), radius).reshape(cells, dims)
    keep = np.power(1.0 - alpha, n)
    safe = np.where(n > 0, n, 1.0)
    new = keep[:, None] * mat + (1.0 - keep)[:, None] * m / safe[:, None]
    return np.where((n > 0)[:, None], new, mat)


def matrix_frame(spark: SparkSession, mat: np.ndarray) -> DataFrame:
    """(cell, w array<double>) from the matrix (map-sized)."""
    tbl = pa.table({"cell": pa.array(np.arange(mat.shape[0], dtype=np.int32)),
                    "w": pa.array(list(mat), type=pa.list_(pa.float64()))})
    return spark.createDataFrame(tbl)


# ------------------------------------------------------------ blocked training

@dataclass(frozen=True)
class Blocks:
    """How a map is cut: blocks of ``cells`` whole cells for the search,
    blocks of ``features`` (64 blocks, or more) for the update; both hold
    ``BLOCK_BYTES`` at most. Only the map decides, so a job that resumes on
    another cluster reads the blocks that it finds."""
    cfg: SomConfig
    dims: int
    cells: int
    features: int

    @classmethod
    def of(cls, cfg: SomConfig, dims: int) -> Blocks:
        cells = max(1, min(cfg.cells, BLOCK_BYTES // (8 * dims)))
        features = max(1, min(-(-dims // 64), BLOCK_BYTES // (8 * cfg.cells)))
        return cls(cfg, dims, cells, features)

    @property
    def cblocks(self) -> int:
        return -(-self.cfg.cells // self.cells)

    @property
    def fblocks(self) -> int:
        return -(-self.dims // self.features)

    def cell_range(self, c: int) -> tuple[int, int]:
        return c * self.cells, min((c + 1) * self.cells, self.cfg.cells)

    def feature_range(self, f: int) -> tuple[int, int]:
        return f * self.features, min((f + 1) * self.features, self.dims)

    def rows(self, f: int, part: np.ndarray) -> pa.Table:
        """Table rows of one feature block, given for all cells."""
        cut = [self.cell_range(c) for c in range(self.cblocks)]
        return pa.table({"cblock": pa.array(range(self.cblocks), pa.int32()),
                         "fblock": pa.array([f] * self.cblocks, pa.int32()),
                         "w": pa.array([np.ascontiguousarray(part[x:y]).tobytes() for x, y in cut], pa.binary())})

    def cells_of(self, rows: pa.Table) -> np.ndarray:
        """The (cells × features) matrix of one cell block from its rows."""
        got = sorted(zip(rows.column("fblock").to_pylist(), rows.column("w").to_pylist()))
        parts = []
        for f, w in got:
            x, y = self.feature_range(f)
            parts.append(np.frombuffer(w, dtype=np.float64).reshape(-1, y - x))
        return np.hstack(parts)


_BLOCK = "cblock int, fblock int, w binary"


def initial_blocks(spark: SparkSession, b: Blocks) -> DataFrame:
    """G6 as blocks — the integer hash of :func:`initial_weights`."""
    seed, cells = b.cfg.seed * 31, b.cfg.cells

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                idx = np.arange(*b.feature_range(f), dtype=np.int64)[None, :]
                cell = np.arange(cells, dtype=np.int64)[:, None]
                yield from b.rows(f, ((cell * 7919 + idx * 104729 + seed) % 1000003) / 1000003.0).to_batches()

    return spark.range(0, b.fblocks, 1, min(b.fblocks, default_parallelism(spark))).mapInArrow(run, _BLOCK)


def blocks_from(weights: DataFrame, b: Blocks) -> DataFrame:
    """(cell, w) rows as blocks: every block is one group of its numbers."""
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("cell").to_numpy())
        lists = rows.column("part").combine_chunks()
        part = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)[order]
        return pa.table({"cblock": pa.array([rows.column("cblock")[0].as_py()], pa.int32()),
                         "fblock": pa.array([rows.column("fblock")[0].as_py()], pa.int32()),
                         "w": pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())})

    cut = F.transform(F.sequence(F.lit(0), F.lit(b.fblocks - 1)),
                      lambda f: F.struct(f.alias("f"), F.slice("w", f * b.features + 1, b.features).alias("part")))
    rows = weights.select("cell", (F.col("cell") / b.cells).cast("int").alias("cblock"), F.explode(cut).alias("x"))
    return rows.select("cell", "cblock", F.col("x.f").alias("fblock"), F.col("x.part").alias("part")).groupBy(
        "cblock", "fblock").applyInArrow(run, _BLOCK)


def cell_rows(blocks: DataFrame, b: Blocks) -> DataFrame:
    """(cell, w array<double>) from blocks."""
    def run(rows: pa.Table) -> pa.Table:
        mat = b.cells_of(rows)
        first = b.cell_range(rows.column("cblock")[0].as_py())[0]
        return pa.table({"cell": pa.array(np.arange(first, first + len(mat), dtype=np.int32)),
                         "w": pa.ListArray.from_arrays(np.arange(0, mat.size + 1, mat.shape[1], dtype=np.int32),
                                                       np.ascontiguousarray(mat).ravel())})

    return blocks.groupBy("cblock").applyInArrow(run, "cell int, w array<double>")


def grouped(vectors: DataFrame, num_docs: int) -> tuple[DataFrame, int]:
    """Non-empty vectors with their group, and the number of groups: about
    ``GROUP_DOCS`` documents each, by hash of the id."""
    groups = max(default_parallelism(vectors.sparkSession), -(-num_docs // GROUP_DOCS))
    g = F.pmod(F.xxhash64("ID"), F.lit(groups)).cast("int")
    return vectors.where(F.size("features") > 0).select("ID", "features", g.alias("grp")), groups


def _meet(docs: DataFrame, groups: int, blocks: DataFrame, b: Blocks, kernel, schema: str) -> DataFrame:
    """``kernel(vectors, matrix, first cell)`` for every group of documents and
    every block of cells."""
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # with one block of cells the documents stay where they were dealt to
    keys = ["grp", "cblock"] if b.cblocks > 1 else ["grp"]
    left = docs.select("ID", "features", "grp", every(b.cblocks, "cblock")) if b.cblocks > 1 else docs
    right = blocks.select("cblock", "fblock", "w", every(groups, "grp"))

    def run(key, vec: pa.Table, rows: pa.Table) -> pa.Table:
        mat = b.cells_of(rows) if len(vec) else None
        return kernel(vec, mat, b.cell_range(key[1].as_py() if len(key) > 1 else 0)[0])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _table(schema: list, columns: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _lists(vec: pa.Table):
    col = vec.column("features").combine_chunks()
    offsets = col.offsets.to_numpy()
    return offsets - offsets[0], col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def nearest_cells(docs: DataFrame, groups: int, blocks: DataFrame, b: Blocks) -> DataFrame:
    """G9 over blocks: (ID, cell, distance) of the nearest cell, the lowest of
    equals."""
    schema = [("ID", pa.string()), ("cell", pa.int32()), ("distance", pa.float64())]

    def kernel(vec, mat, first):
        if not len(vec):
            return _table(schema, [[], [], []])
        win, dist = _nearest(mat, (mat * mat).sum(axis=1), *_lists(vec), clip=False)
        return _table(schema, [vec.column("ID").to_pylist(), win + first, dist])

    found = _meet(docs, groups, blocks, b, kernel, "ID string, cell int, distance double")
    if b.cblocks > 1:
        found = found.groupBy("ID").agg(F.min(F.struct("distance", "cell")).alias("m")).select("ID", "m.cell", "m.distance")
    return found.select("ID", "cell", F.greatest("distance", F.lit(0.0)).alias("distance"))


def nearest_k(docs: DataFrame, groups: int, blocks: DataFrame, b: Blocks, k: int) -> DataFrame:
    """(ID, rank, cell, distance) of the ``k`` nearest cells, equals by
    cell. Cells are tried in parts, by norm; a part is skipped when
    ``(|x| − |w|)²``, which no distance is below, exceeds the kth best of every
    document of the batch (documents are taken by their norm, too)."""
    schema = [("ID", pa.string()), ("cell", pa.int32()), ("distance", pa.float64())]
    part, many = 128, 1024

    def kernel(vec, mat, first):
        if not len(vec):
            return _table(schema, [[], [], []])
        offsets, flat = _lists(vec)
        sizes, ids = np.diff(offsets), np.asarray(vec.column("ID").to_pylist(), dtype=object)
        s2 = (mat * mat).sum(axis=1)
        by_norm, by_size = np.argsort(s2, kind="stable"), np.argsort(sizes, kind="stable")
        out_id, out_cell, out_dist = [], [], []
        for i in range(0, len(by_size), many):
            rows = by_size[i:i + many]
            x = np.zeros((len(rows), mat.shape[1]))
            for r, doc in enumerate(rows):
                x[r, flat[offsets[doc]:offsets[doc + 1]]] = 1.0
            n = sizes[rows].astype(float)
            dist = np.full((len(rows), k), np.inf)
            cell = np.full((len(rows), k), np.iinfo(np.int32).max, dtype=np.int64)
            # parts nearest in norm come first
            parts = [by_norm[j:j + part] for j in range(0, len(by_norm), part)]
            middle = np.sqrt(n).mean()
            for p in sorted(parts, key=lambda p: abs(np.sqrt(s2[p]).mean() - middle)):
                lo, hi = np.sqrt(s2[p]).min(), np.sqrt(s2[p]).max()
                gap = np.maximum(np.maximum(lo - np.sqrt(n), np.sqrt(n) - hi), 0.0)
                if (gap * gap > dist[:, -1] + 1e-9).all():
                    continue
                d = n[:, None] + s2[p][None, :] - 2.0 * (x @ mat[p].T)
                both, cells = np.hstack([dist, d]), np.hstack([cell, np.broadcast_to(p + first, d.shape)])
                order = np.lexsort((cells, both), axis=1)[:, :k]
                dist, cell = np.take_along_axis(both, order, axis=1), np.take_along_axis(cells, order, axis=1)
            held = np.isfinite(dist)
            out_id.append(np.repeat(ids[rows], held.sum(axis=1)))
            out_cell.append(cell[held])
            out_dist.append(dist[held])
        return _table(schema, [np.concatenate(out_id).tolist(), np.concatenate(out_cell).astype(np.int32), np.concatenate(out_dist)])

    found = _meet(docs, groups, blocks, b, kernel, "ID string, cell int, distance double")
    rank = F.row_number().over(Window.partitionBy("ID").orderBy("distance", "cell"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "ID", "rank", "cell", F.greatest("distance", F.lit(0.0)).alias("distance"))


def block_counts(docs: DataFrame, groups: int, blocks: DataFrame, b: Blocks) -> DataFrame:
    """Counts of one epoch, (winner, idx, cnt); idx = -1 counts documents."""
    schema = [("winner", pa.int32()), ("idx", pa.int32()), ("cnt", pa.int64())]
    dims = b.dims

    def kernel(vec, mat, first):
        if not len(vec):
            return _table(schema, [[], [], []])
        offsets, flat = _lists(vec)
        win, _ = _nearest(mat, (mat * mat).sum(axis=1), offsets, flat)
        win = win.astype(np.int64) * (dims + 1)
        key, n = np.unique(np.concatenate([np.repeat(win, np.diff(offsets)) + flat + 1, win]), return_counts=True)
        return _table(schema, [(key // (dims + 1)).astype(np.int32), (key % (dims + 1) - 1).astype(np.int32), n])

    if b.cblocks == 1:  # each task counts its winners
        got = _meet(docs, groups, blocks, b, kernel, "winner int, idx int, cnt long")
        return got.groupBy("winner", "idx").agg(F.sum("cnt").alias("cnt"))
    win = nearest_cells(docs, groups, blocks, b).select("ID", F.col("cell").alias("winner"))
    each = docs.select("ID", "features").join(win, "ID").select(
        "winner", F.explode(F.array_append("features", F.lit(-1))).alias("idx"))
    return each.groupBy("winner", "idx").agg(F.count(F.lit(1)).alias("cnt"))


def updated_blocks(blocks: DataFrame, counts: DataFrame, b: Blocks, alpha: float, radius: int) -> DataFrame:
    """G10/G11 over blocks: each block of features is updated for all cells."""
    cfg = b.cfg
    fblock = F.when(F.col("idx") < 0, F.sequence(F.lit(0), F.lit(b.fblocks - 1))).otherwise(
        F.array((F.col("idx") / b.features).cast("int")))
    dealt = counts.select("winner", "idx", "cnt", F.explode(fblock).alias("fblock"))

    def run(key, old: pa.Table, cnt: pa.Table) -> pa.Table:
        f = key[0].as_py()
        lo, hi = b.feature_range(f)
        got = sorted(zip(old.column("cblock").to_pylist(), old.column("w").to_pylist()))
        mat = np.vstack([np.frombuffer(w, dtype=np.float64).reshape(-1, hi - lo) for _, w in got])
        idx = cnt.column("idx").to_numpy()
        idx = np.where(idx < 0, idx, idx - lo)
        local = pa.table({"winner": cnt.column("winner"), "idx": pa.array(idx), "cnt": cnt.column("cnt")})
        return b.rows(f, epoch_update(mat, local, cfg, alpha, radius))

    return blocks.groupBy("fblock").cogroup(dealt.groupBy("fblock")).applyInArrow(run, _BLOCK)


def _finished(spark: SparkSession, path: str) -> int:
    """The last epoch whose weights were written whole at ``path``, or -1."""
    jvm = spark.sparkContext._jvm
    last = -1
    while True:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/epoch-{last + 1:05d}/_SUCCESS")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return last
        last += 1


def train(vectors: DataFrame, cfg: SomConfig, dims: int, weights: DataFrame | None = None,
          path: str | None = None) -> TrainedMap:
    """Run the epochs. The weights of every epoch are written to ``path``
    (default: a folder of this call under the shared one), and epochs that are
    there already are not run again: call it with the same path to resume."""
    spark = vectors.sparkSession
    stats = vectors.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.size("features") > 0).alias("matched")).first()
    plan = cfg.schedule()
    epochs = spark.createDataFrame(pa.table({
        "epoch": pa.array(range(len(plan)), pa.int32()), "alpha": pa.array([a for a, _ in plan], pa.float64()),
        "radius": pa.array([r for _, r in plan], pa.int32()), "docs": pa.array([stats["docs"]] * len(plan), pa.int64()),
        "matched": pa.array([stats["matched"]] * len(plan), pa.int64())}))
    if dims == 0:  # no feature terms: every document is an outlier
        return TrainedMap(cfg, dims, initial_weights(spark, cfg, 0), epochs)
    path = path or scratch_path(spark, "tables", spark.sparkContext.applicationId, f"som_{uuid.uuid4().hex[:12]}")
    b = Blocks.of(cfg, dims)
    docs, groups = grouped(vectors, stats["matched"])
    from pyspark import StorageLevel
    # dealt once; an epoch finds each group of documents where the last one left it
    docs = docs.repartition(groups, "grp").persist(StorageLevel.MEMORY_AND_DISK)
    done = _finished(spark, path)
    w = spark.read.parquet(f"{path}/epoch-{done:05d}") if done >= 0 else \
        initial_blocks(spark, b) if weights is None else blocks_from(weights, b)
    for e, (alpha, radius) in list(enumerate(plan))[done + 1:]:
        counts = block_counts(docs, groups, w, b)
        updated_blocks(w, counts, b, alpha, radius).write.mode("overwrite").parquet(f"{path}/epoch-{e:05d}")
        w = spark.read.parquet(f"{path}/epoch-{e:05d}")
    docs.unpersist()
    return TrainedMap(cfg, dims, cell_rows(w, b), epochs, w)


def assign(vectors: DataFrame, trained: TrainedMap) -> DataFrame:
    """Final cell of every document (outliers included)."""
    cfg, dims = trained.cfg, trained.dims
    empty = vectors.where(F.size("features") == 0) if dims else vectors
    out = empty.select("ID", F.lit("-1").alias("cell"), *[F.lit(None).cast("int").alias(c) for c in ("som_x", "som_y")],
                       F.lit(None).cast("double").alias("som_cell_distance"))
    if not dims:
        return out
    b = Blocks.of(cfg, dims)
    docs, groups = grouped(vectors, vectors.count())
    blocks = trained.blocks if trained.blocks is not None else blocks_from(trained.weights, b)
    near = nearest_cells(docs, groups, blocks, b)
    return near.select("ID", F.col("cell").cast("string").alias("cell"), (F.col("cell") % cfg.width).alias("som_x"),
                       (F.col("cell") / cfg.width).cast("int").alias("som_y"),
                       F.col("distance").alias("som_cell_distance")).unionByName(out)


def cell_stats(assignments: DataFrame, cfg: SomConfig) -> DataFrame:
    """(cell, num, ssd, std_dev) for every cell of the map; ``ssd`` sums
    the squares of the (already squared) distances."""
    spark = assignments.sparkSession
    cells = spark.range(cfg.cells).select(F.col("id").cast("int").alias("cell"))
    st = (assignments.where(F.col("cell") != "-1")
          .groupBy(F.col("cell").cast("int").alias("cell"))
          .agg(F.count(F.lit(1)).alias("num"),
               F.sum(F.col("som_cell_distance") * F.col("som_cell_distance")).alias("ssd")))
    out = cells.join(st, "cell", "left").select(
        "cell", F.coalesce("num", F.lit(0)).cast("long").alias("num"),
        F.coalesce("ssd", F.lit(0.0)).alias("ssd"))
    return out.withColumn("std_dev", F.sqrt(F.when(F.col("num") > 2, F.col("ssd") / (F.col("num") - 1))
                                           .otherwise(F.col("ssd"))))
