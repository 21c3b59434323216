"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Texts with equal shingle sets are one class, found by a digest of the set and
named by the smallest id. Class representatives get SuperMinHash signatures:
every shingle draws a random permutation of the registers step by step and
offers register ``p[j]`` the value ``j + r``; after step j only registers still
above j can change, so the steps end as soon as all registers are filled (the
early stop). Bands of the signature give buckets; a bucket's members are
candidates of each other.

No bucket is expanded into its pairs. In each round a few members per bucket
(pivots, pseudo-random minima made map-side) are compared with the members of
other components; the links found are merged into components by distributed
union-find (stars drawn to their minima, hooking to smaller roots and pointer
jumping). A pivot has then met all members and leaves its buckets, and buckets
of one component are done. The first pivots are drawn from all components, the
later ones mostly from the largest, so that only members outside it are
compared. What is left across components is compared member by member: pairs of
small buckets one by one, large buckets in blocks of bounded size, where a
block of members outside the largest component meets a block of all members on
their full sets and only links come out. So no link between texts of a common
bucket is lost. A pair is skipped if its sizes cannot reach the similarity, or
if its signatures agree in ``AGREE`` less registers than that (4.6 standard
deviations); all others are confirmed on their full shingle sets.

Tables of ids and buckets are broadcast when a count proves them small, and
joined by shuffles of file-backed sides (which AQE may split) when not.

Edge cases: null and empty texts (no words) have no shingles and link with
nothing; a text of fewer words than a shingle is one shingle; repeated rows
with the same id are one document each and share a class; rows without an id
are their own group (component null) and kept; added columns replace columns
of the same name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast
from .common import append_arrow, forget, table, written

#: Bands and registers in a band: two texts of similarity 0.8 share no bucket
#: once in 14,000 times, (1 - 0.8**5)**24; of similarity 0.85 once in 1.3 million.
BANDS, ROWS = 24, 5
#: Pivots per bucket from all components in the first round and later ones, and from the largest.
PIVOTS, LATER, INNER = 2, 1, 4
#: Pivot rounds at most.
ROUNDS = 2
#: Members of a bucket up to which its open pairs are listed; members in a block of a larger one.
LISTED, BLOCK = 64, 1024
#: Signatures that may be broadcast (24 MB); other tables follow the session's bound.
SMALL = 200_000
#: Share of equal registers, less than the similarity, under which a pair is not looked at.
AGREE = 0.17

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            fill = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
            self.up, self.down = fill(np.uint64(_BASE)), fill(np.uint64(pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
#: Bytes of a text that are hashed at once.
LONG = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word (a run of bytes other than ASCII white space),
    A-Z lower-cased, from one polynomial prefix sum over the text."""
    if len(text) > LONG:  # in parts cut at white space
        cut = _SPACE.search(text, LONG // 2)
        if cut:
            parts, at = [], 0
            while cut:
                parts.append(word_hashes(text[at:cut.start()]))
                at = cut.end()
                cut = _SPACE.search(text, at + LONG // 2)
            return np.concatenate([*parts, word_hashes(text[at:])])
    b = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    inside = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.get(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; with fewer
    words one shingle of them all, without words none."""
    words = word_hashes((text or "").encode())
    if not len(words):
        return words
    k = min(k, len(words))
    h = words[:len(words) - k + 1].copy()
    for j in range(1, k):
        h = mix64(h * _M1 + words[j:len(words) - k + 1 + j])
    return np.unique(h)


def superminhash(shingles: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of ``m`` registers: minima of ``j << 32 | r``
    over the shingles' permutations, all shingles taken one step at a time."""
    sig = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    p = None
    row, salts = np.arange(len(shingles)), np.arange(1, m + 1, dtype=np.uint64) * _GOLD
    for j in range(m):
        u = mix64(shingles + salts[j])
        swap = j + ((u >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if p is None:
            place = swap
            if j == 0:
                first = swap
        else:
            place = p[row, swap].astype(np.int64)
            p[row, swap] = p[:, j]
        np.minimum.at(sig, place, (u & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
        if sig.max() < np.uint64((j + 1) << 32):
            break  # later steps offer larger values only
        if p is None:
            p = np.tile(np.arange(m, dtype=np.uint16), (len(shingles), 1))
            p[row, first] = 0
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * _GOLD
    for i in range(ROWS):
        h = mix64(h * _M1 + rows[:, i])
    return h.view(np.int64)


def sketches(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """``df`` with ``n_shingles``, ``digest`` of the shingle set, ``bands`` and
    ``sig``, a byte of each register (the last three null for empty sets)."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
              T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]

    def kernel(cols):
        n, digest, bands, sigs = [], [], [], []
        for t in cols[0].to_pylist():
            s = shingle_set(t, k)
            sig = superminhash(s, BANDS * ROWS) if len(s) else None
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(band_hashes(sig) if len(s) else None)
            sigs.append(sig.astype(np.uint8).tobytes() if len(s) else None)
        return [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(sigs, pa.binary())]

    return append_arrow(df, fields, [text], kernel)


def _ids(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(np.flatnonzero(keep))
    return pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])


def alike(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures agree in enough registers."""
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    both = pairs.join(bounded_broadcast(left, SMALL), "a").join(bounded_broadcast(right, SMALL), "b")
    least = percent / 100 - AGREE

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                    for c in ("x", "y"))
            yield _ids(batch, (x == y).mean(axis=1) >= least)

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets have ``100 * shared >=
    percent * union``."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield _ids(batch, keep)

    return both.mapInArrow(run, "a bigint, b bigint")


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def union_find(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``links(a, b)``: root is the smallest id
    reachable. All neighbours of an id are first linked to the smallest of
    them; then roots hook to their smallest neighbour root, chains of hooks
    are halved by pointer jumping, and links are taken up to the roots until
    none joins two of them."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    ids = written(least.select(F.col("a").alias("id"), F.least("a", "m").alias("m")))
    near = bounded_broadcast(ids.select(F.col("id").alias("a"), "m"))
    links = written(_ordered(both.join(near, "a").select(F.col("m").alias("a"), "b").unionByName(
        ids.select(F.col("m").alias("a"), F.col("id").alias("b")))))
    roots = ids.select("id", F.col("id").alias("root"))
    while True:
        hooks = written(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")))
        if hooks.isEmpty():
            break
        while True:  # pointer jumping
            far = bounded_broadcast(hooks.select(F.col("id").alias("to"), F.col("to").alias("far")))
            chained = hooks.join(far, "to", "left")
            if chained.filter("far is not null").isEmpty():
                break
            hooks = written(chained.select("id", F.coalesce("far", "to").alias("to")))
        small = bounded_broadcast(hooks)
        roots = written(roots.join(small.withColumnRenamed("id", "root"), "root", "left").select(
            "id", F.coalesce("to", "root").alias("root")))
        ends = links
        for c in ("a", "b"):
            ends = ends.join(small.select(F.col("id").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        links = written(_ordered(ends))
    return roots


def components(reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """``(id, root)`` of the class representatives that are linked, from
    ``reps(id, n_shingles, bands, sig)`` and ``docs(id, text)``. None if no two
    are."""
    least = 1 if percent <= 50 else percent // (100 - percent)  # smaller sets are similar to equal ones only
    large = reps.filter(F.col("n_shingles") >= least)
    rows = large.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket"))
    live = written(rows.join(bounded_broadcast(shared), "bucket").withColumn("comp", F.col("id")))
    if live.isEmpty():
        return None
    ids = written(live.select("id").distinct())
    near_ids = bounded_broadcast(ids)
    sigs = written(large.select("id", "sig").join(near_ids, "id"))

    def set_kernel(cols):
        return [pa.array([shingle_set(t, k).tobytes() for t in cols[0].to_pylist()], pa.binary())]

    sets = written(append_arrow(docs.join(near_ids, "id"), [T.StructField("shingles", T.BinaryType())],
                                ["text"], set_kernel).select("id", "shingles"))
    links, roots = None, None
    for r in range(ROUNDS + 1):
        # per component of a bucket a few pseudo-random members
        inner = INNER if r else 1
        draw = [F.min(F.struct(F.xxhash64(F.lit(r), F.lit(i), "id").alias("h"), F.col("id").alias("p"), F.col("n").alias("pn")))
                for i in range(inner)]
        per = live.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.array(*draw).alias("v"))
        # per bucket some of pseudo-random components, and those of the largest one
        some = [F.min(F.struct(F.xxhash64(F.lit(r), F.lit(i), "comp").alias("x"), F.get("v", 0)["p"].alias("p"),
                               F.get("v", 0)["pn"].alias("pn"), F.col("comp").alias("pc")))
                for i in range(LATER if r else PIVOTS)]
        per = per.groupBy("bucket").agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("comps"), F.array(*some).alias("v"),
            F.max(F.struct("c", "comp", "v")).alias("top")).filter("comps > 1")
        drawn = F.transform("v", lambda x: x.dropFields("x"))
        if r:
            drawn = F.concat(drawn, F.transform("top.v", lambda x: F.struct(
                x["p"].alias("p"), x["pn"].alias("pn"), F.col("top.comp").alias("pc"))))
        pivots = written(per.select("bucket", "c", F.col("top.comp").alias("largest"), F.array_distinct(drawn).alias("v")))
        if pivots.isEmpty():
            break
        met = live.join(bounded_broadcast(pivots), "bucket")
        if r == ROUNDS:
            found = _rest(written(met.drop("v")), sigs, sets, percent)
        else:
            wanted = F.filter("v", lambda x: (x["pc"] != F.col("comp")) & (100 * F.least("n", x["pn"]) >= percent * F.greatest(
                "n", x["pn"])))
            pairs = met.select("id", F.explode(F.transform(wanted, lambda x: x["p"])).alias("p")).select(
                F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
            found = verified(written(alike(written(pairs.distinct()), sigs, percent)), sets, percent)
        found = written(found)
        links = found if links is None else links.unionByName(found)
        # components of all links so far, kept as stars; unlinked documents are their own
        roots = written(union_find(links))
        links = roots.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        if r < ROUNDS:
            rest = met.filter(~F.exists("v", lambda x: x["p"] == F.col("id"))).select("bucket", "id", "n")
            live = written(rest.join(bounded_broadcast(roots), "id", "left").select(
                "bucket", "id", "n", F.coalesce("root", "id").alias("comp")))
    return roots


def _rest(met: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links left across components in the buckets of ``met(bucket, id, n,
    comp, c, largest)``."""
    a = met.filter(F.col("c") <= LISTED).withColumnRenamed("id", "a")
    b = met.select("bucket", F.col("id").alias("b"), F.col("n").alias("pn"), F.col("comp").alias("pc"))
    pairs = a.join(b, "bucket").filter((F.col("a") < F.col("b")) & (F.col("comp") != F.col("pc")) & (
        100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))).select("a", "b")
    few = verified(written(alike(written(pairs.distinct()), sigs, percent)), sets, percent)
    large = met.filter(F.col("c") > LISTED)
    if large.isEmpty():
        return few
    outer = large.filter(F.col("comp") != F.col("largest"))
    # blocks of about BLOCK members: each outer block meets each block of all members once
    rows = outer.groupBy("bucket").agg(F.count(F.lit(1)).alias("out"), F.first("c").alias("c"))
    plan = bounded_broadcast(written(rows.select("bucket", F.ceil(F.col("out") / BLOCK).alias("no"),
                                                 F.ceil(F.col("c") / BLOCK).alias("nm"))))
    with_sets = large.join(sets, "id").join(plan, "bucket")
    left = with_sets.filter(F.col("comp") != F.col("largest")).select(
        "bucket", F.pmod(F.xxhash64("id"), "no").alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)).alias("m"),
        "id", "comp", "shingles")
    right = with_sets.select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("no") - 1)).alias("o"), F.pmod(F.xxhash64("id"), "nm").alias("m"),
        "id", "comp", "shingles")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            each = [np.frombuffer(v, dtype=np.uint64) for v in y["shingles"]]
            size, ids, comps = np.array([len(v) for v in each]), y["id"].to_numpy(), y["comp"].to_numpy()
            every, owner = np.concatenate(each), np.repeat(np.arange(len(each)), size)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for i, c, v in zip(x["id"], x["comp"], x["shingles"]):
                own = np.frombuffer(v, dtype=np.uint64)
                start, end = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
                n = end - start
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(each))
                linked = (100 * shared >= percent * (len(own) + size - shared)) & (comps != c)
                out += [(min(i, j), max(i, j)) for j in ids[linked].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    right = right.toDF(*right.columns)  # columns of their own beside the left side's
    many = left.groupBy("bucket", "o", "m").cogroup(right.groupBy("bucket", "o", "m")).applyInPandas(run, "a bigint, b bigint")
    return few.unionByName(many)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_shingles``, ``component_id``
    (smallest id linked, directly or through others) and ``kept`` (the id is
    its component's). ``k`` words make a shingle; texts are linked from
    ``percent`` of shared shingles."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sk = written(sketches(docs, k).drop("text"))
    # one class per shingle set; its smallest id stands for it
    classes = sk.filter("id is not null and digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"))
    copied = written(classes.filter("c > 1").select("digest", "rep"))
    member = written(sk.select("id", "n_shingles", "digest").join(bounded_broadcast(copied), "digest", "left").select(
        "id", "n_shingles", F.coalesce("rep", "id").alias("rep")))
    others = written(member.filter("id != rep").select("id").distinct())
    reps = sk.filter("id is not null and digest is not null").select("id", "n_shingles", "bands", "sig")
    reps = written(reps.join(bounded_broadcast(others), "id", "left_anti").dropDuplicates(["id"]))
    found = components(reps, docs.filter("id is not null"), k, percent) if percent < 100 else None
    forget(sk)
    if found is None:
        out = member.withColumn("component_id", F.col("rep"))
    else:
        out = member.join(bounded_broadcast(written(found).withColumnRenamed("id", "rep")), "rep", "left").withColumn(
            "component_id", F.coalesce("root", "rep"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, k=2, percent=80)


QUERIES = {"op1_minhash": op1_minhash}
ORACLE_SQL: dict[str, str] = {}
