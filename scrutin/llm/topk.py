"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to blocks by hash. For every pair of a block of queries and
a block of data a task builds a cover tree of each and walks them together: a
node's ball (centre, covering radius) bounds the product of any query below
one node with any vector below the other, and a pair of nodes is pruned when
that bound is under the worst kth score of the query node. Leaves are compared
as one matrix product. Each pair of blocks gives its best per query; the best
of those are the answer.

Equal vectors are searched for once: per distinct vector only the ``k + 1``
smallest ids can be among anybody's best, and equal queries share one search
whose ``k + 1`` best hold the ``k`` best of each of them once its own id is
taken out.

Edge cases: vectors that are null or hold a null or non-finite component, and
rows without an id, take no part; vectors of different length are not
compared; ties go to the smaller id; with fewer candidates than k a query gets
all of them; rows that repeat an id count as separate vectors of that id,
but never as candidates of that id; an empty table gives no rows. Components
times 256 must fit 64 bits, as must the products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Vectors in a data block, distinct queries in a query block, points in a leaf.
DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 48


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.norm, self.radius = centre, float(np.sqrt(centre @ centre)), radius
        self.rows, self.children = rows, children


def cover_tree(x: np.ndarray, rows: np.ndarray, centre: int) -> Node:
    """A cover tree of ``x[rows]`` whose root is the point ``centre``: children
    cover half the radius of their parent, their centres (the parent's among
    them) lie further apart than that. Children of few points share a leaf."""
    diff = x[rows] - x[centre]
    dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    radius = float(dist.max()) if len(rows) else 0.0
    if len(rows) <= LEAF or radius == 0.0:
        return Node(x[centre], radius, rows, None)
    half = radius / 2
    groups = [(centre, rows[dist <= half])]
    rest = rows[dist > half]
    while len(rest):
        diff = x[rest] - x[rest[0]]
        near = np.einsum("ij,ij->i", diff, diff) <= half * half
        groups.append((rest[0], rest[near]))
        rest = rest[~near]
    large = [(c, g) for c, g in groups if len(g) > 1]
    few = [g for _, g in groups if len(g) == 1]
    children = [cover_tree(x, g, c) for c, g in large]
    if few:
        scattered = np.concatenate(few)
        for part in np.array_split(scattered, math.ceil(len(scattered) / LEAF)):
            diff = x[part] - x[part[0]]
            children.append(Node(x[part[0]], float(np.sqrt(np.einsum("ij,ij->i", diff, diff).max())), part, None))
    return Node(x[centre], radius, rows, children)


class Search:
    """The best ``k`` products of queries ``q`` with data ``x`` (ids ``ids``)."""

    def __init__(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.x, self.ids, self.k = q, x, ids, k
        self.score = np.full((len(q), k), -np.inf)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
        self.pruned = self.compared = 0

    def bound(self, a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-6  # never below the exact bound

    def walk(self, a: Node, b: Node) -> None:
        stack = [(self.bound(a, b), a, b)]
        while stack:
            top, a, b = stack.pop()
            if top < self.score[a.rows, -1].min():
                self.pruned += 1
                continue
            if a.children is None and b.children is None:
                self.leaves(a.rows, b.rows)
                continue
            if b.children is None or (a.children is not None and a.radius > b.radius):
                pairs = [(self.bound(c, b), c, b) for c in a.children]
            else:
                pairs = [(self.bound(a, c), a, c) for c in b.children]
            stack += sorted(pairs, key=lambda p: p[0])  # the most promising pair is walked first

    def leaves(self, rows: np.ndarray, data: np.ndarray) -> None:
        self.compared += len(rows) * len(data)
        score = np.hstack([self.score[rows], self.q[rows] @ self.x[data].T])
        ids = np.hstack([self.best[rows], np.broadcast_to(self.ids[data], (len(rows), len(data)))])
        order = np.lexsort((ids, -score), axis=1)[:, :self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.best[rows] = np.take_along_axis(ids, order, axis=1)


def block_top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(scores, ids)`` of the best ``k`` of each query; empty places have
    score minus infinity. Whole numbers are exact below 2**53; beyond, the
    products are made with Python's integers."""
    limit = np.abs(q.astype(float)).sum(axis=1).max(initial=0) * np.abs(x.astype(float)).max(initial=0)
    if limit >= 2 ** 53:
        exact = q.astype(object) @ x.astype(object).T
        order = [sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k] for row in exact]
        return [[int(exact[i][j]) for j in o] for i, o in enumerate(order)], [[int(ids[j]) for j in o] for o in order]
    s = Search(q.astype(float), x.astype(float), ids, k)
    s.walk(cover_tree(s.q, np.arange(len(q)), 0), cover_tree(s.x, np.arange(len(x)), 0))
    return s.score, s.best


def top_products(df: DataFrame, is_query, key: str = "vec_id", vector: str = "vector", k: int = 5) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` largest products of each row
    for which the column ``is_query`` holds with all other rows. ``vector`` is
    an array of whole numbers (``array<bigint>``)."""
    base = written(df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("isq")))
    first = W.partitionBy("v").orderBy("id")
    data = (base.select("id", "v").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
            .groupBy("v").agg(F.collect_list("id").alias("ids")))  # k + 1 ids at most
    asked = written(base.filter("isq").groupBy("v").agg(F.min("id").alias("q")))
    data = written(data)
    blocks = max(1, math.ceil(data.count() / DATA_BLOCK))
    groups = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    # the keys of both sides must be of one type: cogroups are not coerced
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    left = asked.select("q", "v", F.size("v").alias("dim"), block("q", groups).alias("g"), every(blocks).alias("b"))
    right = data.select("ids", "v", F.size("v").alias("dim"), block("v", blocks).alias("b"), every(groups).alias("g"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        counts = b["ids"].map(len).to_numpy()
        x = np.repeat(np.stack(b["v"].to_numpy()).reshape(len(b), -1), counts, axis=0)
        score, ids = block_top(np.stack(a["v"].to_numpy()).reshape(len(a), -1), x,
                               np.concatenate(b["ids"].to_numpy()).astype(np.int64), k + 1)
        rows = [(q, int(i), int(s)) for q, ss, ii in zip(a["q"].tolist(), score, ids) for s, i in zip(ss, ii)
                if s != -np.inf]
        return pd.DataFrame(rows, columns=["q", "id", "score"])

    near = left.groupBy("dim", "b", "g").cogroup(right.groupBy("dim", "b", "g")).applyInPandas(
        run, "q bigint, id bigint, score bigint")
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    near = written(near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"))
    # each query of a shared search leaves out itself
    member = written(base.filter("isq").join(asked, "v").select(F.col("id").alias("query_id"), "q").distinct())
    own = member.join(near, "q").filter("id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), "score")


def whole_numbers(vector: str):
    """``floor(256 * x)`` of each component, null if one is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(v, lambda x: F.floor(256 * x)))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest products of every 50th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers("embedding").alias("vector"))
    return top_products(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
    FROM e q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

QUERIES = {"op6_topk": op6_topk}
ORACLE_SQL = {"op6_topk": ORACLE}
