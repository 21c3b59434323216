"""Hard negatives by Strassen multiplication of anchor and candidate tiles.

Anchors are taken in blocks of at most ``ANCHORS`` rows, each broadcast to all
tasks. A task reads its share of the candidates in tiles of ``TILE`` rows and
multiplies blocks of anchors by each tile with Strassen's seven-product
recursion on 64-bit integers; odd sides are padded with zeros. Sums and
differences of the recursion are taken modulo 2**64, where they form a ring,
so a product that fits 64 bits comes out exactly even where a partial sum does
not. Two passes are made per block of anchors: the first keeps, in a heap per
anchor, the best candidates of its own label; the second, which knows the
scores of these positives, keeps a heap per anchor and positive of the
candidates of other labels in the positive's score window. Heaps of tiles are
merged in the task, heaps of tasks by the ranking that follows. Candidates are
never copied and a task holds one tile, one product and the heaps of a block.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; vectors of different length are not compared; an
anchor repeated with the same label and vector is one anchor, and a row with
an anchor's id is never its candidate; ties go to the smaller id; anchors with
fewer positives or negatives get all of them, those without give no row, as
does an empty table; further columns are not carried. Components times 256
and all products must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .topk import whole_numbers

#: Anchors broadcast at once, anchors and candidates of one product.
ANCHORS, ROWS, TILE = 16_384, 512, 4096
#: Sides from which a product is no longer divided.
LEAF = 16
#: Products of a task before its share of the candidates is divided further.
TASK_PRODUCTS = 1 << 32
#: A positive's window of scores, in percent.
LOW, HIGH = 80, 100
_LEAST = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of 64-bit integers by seven products of quarters."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((m, n), dtype=np.int64)
    p = strassen(a11 + a22, b11 + b22)
    out[:i, :l], out[i:, l:] = p, p
    p = strassen(a21 + a22, b11)
    out[i:, :l] = p
    out[i:, l:] -= p
    p = strassen(a11, b12 - b22)
    out[:i, l:] = p
    out[i:, l:] += p
    p = strassen(a22, b21 - b11)
    out[:i, :l] += p
    out[i:, :l] += p
    p = strassen(a11 + a12, b22)
    out[:i, :l] -= p
    out[:i, l:] += p
    out[i:, l:] += strassen(a21 - a11, b11 + b12)
    out[:i, :l] += strassen(a12 - a22, b21 + b22)
    return out


class Heaps:
    """The best ``k`` of several rows: largest score first, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.score = np.full((rows, k), _LEAST, dtype=np.int64)
        self.id = np.full((rows, k), _LAST, dtype=np.int64)
        self.used = np.zeros(rows, dtype=np.int64)
        self.k = k

    def push(self, at: int, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Merge a tile into the heaps ``at, at + 1, ...``: ``score`` has a row
        per heap and a column per id, of which only ``allowed`` ones count."""
        rows = slice(at, at + len(score))
        full = self.used[rows] == self.k
        worst = np.where(full, self.score[rows, -1], _LEAST)
        allowed = allowed & (score >= worst[:, None])
        if score.shape[1] > self.k:  # the kth best of the tile bounds what can enter
            kth = np.partition(np.where(allowed, score, _LEAST), -self.k, axis=1)[:, -self.k]
            allowed &= score >= kth[:, None]
        row, col = np.nonzero(allowed)
        if not len(row):
            return
        touched = np.unique(row)
        old_row, old_col = np.nonzero(np.arange(self.k) < self.used[rows][touched][:, None])
        heap = np.concatenate([row, touched[old_row]])
        value = np.concatenate([score[row, col], self.score[rows][touched[old_row], old_col]])
        key = np.concatenate([ids[col], self.id[rows][touched[old_row], old_col]])
        order = np.lexsort((key, ~value, heap))  # ~value falls as value rises, without overflow
        heap, value, key = heap[order], value[order], key[order]
        place = np.arange(len(heap)) - np.searchsorted(heap, heap)
        keep = place < self.k
        heap, value, key, place = heap[keep], value[keep], key[keep], place[keep]
        self.score[at + heap, place], self.id[at + heap, place] = value, key
        np.maximum.at(self.used, at + heap, place + 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(heap, score, id)`` of all entries."""
        heap, place = np.nonzero(np.arange(self.k) < self.used[:, None])
        return heap, self.score[heap, place], self.id[heap, place]


class Anchors:
    """A block of anchors of one vector length and, for the second pass, the
    positives of each."""

    def __init__(self, rows: list, positives: dict | None, k: int):
        self.number = np.array([r.anchor for r in rows], dtype=np.int64)
        self.id = np.array([r.id for r in rows], dtype=np.int64)
        self.label = np.array([r.label for r in rows], dtype=np.int64)
        self.x = np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0].v))
        if positives is not None:
            self.positive = np.zeros((len(rows), k), dtype=np.int64)
            self.high = np.full((len(rows), k), _LEAST, dtype=np.int64)
            self.wanted = np.zeros((len(rows), k), dtype=bool)
            for i, n in enumerate(self.number.tolist()):
                for j, (score, row) in enumerate(sorted(positives.get(n, ()), key=lambda p: (-p[0], p[1]))):
                    self.positive[i, j], self.high[i, j], self.wanted[i, j] = row, score, True
            # least whole score of which HIGH times is at least LOW times the positive's, without overflow
            whole, rest = np.divmod(self.high, HIGH)
            self.low = whole * LOW - (-rest * LOW) // HIGH


def _search(rows: DataFrame, blocks, k: int) -> DataFrame:
    """``(anchor, slot, id, score)``: each task's best of the broadcast blocks
    of anchors; ``slot`` numbers an anchor's positives in the second pass."""

    def run(batches):
        found = [(a, [Heaps(len(a.id), k) for _ in range(a.positive.shape[1] if hasattr(a, "low") else 1)])
                 for a in blocks.value]
        for batch in batches:
            dims = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for anchors, heaps in found:
                of = np.flatnonzero(dims == anchors.x.shape[1])
                for at in range(0, len(of), TILE):
                    tile = batch.take(pa.array(of[at:at + TILE]))
                    ids, labels = (tile.column(c).to_numpy() for c in (1, 2))
                    x = tile.column(3).flatten().to_numpy().reshape(len(ids), anchors.x.shape[1]).T
                    for r in range(0, len(anchors.id), ROWS):
                        part = slice(r, r + ROWS)
                        score = strassen(anchors.x[part], x)
                        same = anchors.label[part][:, None] == labels
                        if not hasattr(anchors, "low"):
                            heaps[0].push(r, score, ids, same & (anchors.id[part][:, None] != ids))
                            continue
                        other = ~same & (anchors.id[part][:, None] != ids)
                        for j, heap in enumerate(heaps):
                            window = (score >= anchors.low[part, j, None]) & (score <= anchors.high[part, j, None])
                            heap.push(r, score, ids, other & window & anchors.wanted[part, j, None])
        for anchors, heaps in found:
            for j, heap in enumerate(heaps):
                at, score, ids = heap.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.number[at]), pa.array(np.full(len(at), j, dtype=np.int32)), pa.array(ids),
                     pa.array(score)], names=["anchor", "slot", "id", "score"])

    return rows.mapInArrow(run, "anchor bigint, slot int, id bigint, score bigint")


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The heaps of all tasks merged: the first ``k`` per ``keys``, with ``rank``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label",
                   vector: str = "vector", positives: int = 5, negatives: int = 5) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each anchor and each of its best ``positives`` rows
    of the same label, the best ``negatives`` rows of other labels whose score
    lies in the positive's window. ``vector`` is an array of whole numbers."""
    spark = rows.sparkSession
    base = written(rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.coalesce(is_anchor, F.lit(False)).alias("isa"), F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"), F.col(vector).alias("v")))
    # every anchor has a number, its block is the high part of it
    asked = base.filter("isa").select("id", "label", "v").distinct()
    n = asked.count()
    blocks = max(1, -(-n // ANCHORS))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)))
                    .withColumn("anchor", F.monotonically_increasing_id()))
    size = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    tasks = max(1, -(-size.n * min(n, ANCHORS) * max(size.dim or 1, 1) // TASK_PRODUCTS))
    candidates = base.repartition(int(tasks), "id") if tasks > 1 else base
    out = []
    for b in range(blocks):
        block = asked.filter(F.col("block") == b).collect()  # about ANCHORS rows
        dims = {}
        for r in block:
            dims.setdefault(len(r.v), []).append(r)
        first = spark.sparkContext.broadcast([Anchors(d, None, positives) for d in dims.values()])
        best = written(_best(_search(candidates, first, positives), positives, "anchor"))
        known = {}
        for r in best.select("anchor", "score", "id").collect():  # `positives` per anchor of the block
            known.setdefault(r.anchor, []).append((r.score, r.id))
        second = spark.sparkContext.broadcast([Anchors(d, known, positives) for d in dims.values()])
        found = _best(_search(candidates, second, negatives), negatives, "anchor", "slot")
        one = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score"))
        out.append(written(found.join(one, ["anchor", "slot"])))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, every 7th one under the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole_numbers("embedding").alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, e.vec_id AS id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
    FROM e a JOIN e ON e.vec_id <> a.vec_id AND len(e.v) = len(a.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.a AS anchor_id, p.id AS positive_id,
    row_number() OVER (PARTITION BY p.a, p.id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id,
    p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

QUERIES = {"op12_negatives": op12_negatives}
ORACLE_SQL = {"op12_negatives": ORACLE}
