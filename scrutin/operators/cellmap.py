"""Analytics over a trained map — top terms, regions, region
adjacency and colours, neighbour term differences, map summary, display
curves, and result distributions over cells.

Everything here is sized by the map (cells × features), not by the corpus;
joins with documents (G27, G28) are ordinary equi-joins on ID or cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .som import SomConfig


def top_terms(weights: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """(cell, rank, term) — the k terms with the largest ``int(1000·w)``
    per cell, ties by feature index."""
    ex = weights.select("cell", F.posexplode("w").alias("idx", "v"))
    ex = ex.withColumn("val", (F.col("v") * 1000).cast("int"))
    w = Window.partitionBy("cell").orderBy(F.col("val").desc(), F.col("idx"))
    top = ex.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (top.join(F.broadcast(features.select("idx", "term")), "idx")
            .select("cell", (F.col("rank") - 1).cast("int").alias("rank"), "term"))


def regions(tops: DataFrame) -> DataFrame:
    """(cell, region) — cells sharing their first top term form a
    region; regions are numbered by the lowest cell that has the term.
    The ranking window spans the map's distinct first terms (map-sized)."""
    first = tops.where(F.col("rank") == 0).select("cell", "term")
    ids = (first.groupBy("term").agg(F.min("cell").alias("first_cell"))
           .withColumn("region", (F.row_number().over(Window.orderBy("first_cell")) - 1).cast("int")))
    return first.join(ids, "term").select("cell", "region", F.col("term").alias("region_term"))


def neighbour_pairs(spark: SparkSession, cfg: SomConfig, ordered: bool = True) -> DataFrame:
    """8-neighbourhood cell pairs (a, b), a < b when ``ordered``;
    at most 4 per cell (8 unordered), generated from the map shape."""
    cells = spark.range(cfg.cells).select(F.col("id").cast("int").alias("a"))
    x, y = F.col("a") % cfg.width, (F.col("a") / cfg.width).cast("int")
    deltas = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                       for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)])
    p = cells.select("a", x.alias("x"), y.alias("y"), F.explode(deltas).alias("d"))
    nx, ny = F.col("x") + F.col("d.dx"), F.col("y") + F.col("d.dy")
    p = p.where((nx >= 0) & (nx < cfg.width) & (ny >= 0) & (ny < cfg.height))
    p = p.select("a", (ny * cfg.width + nx).cast("int").alias("b"))
    return p.where(F.col("a") < F.col("b")) if ordered else p


def region_adjacency(regs: DataFrame, cfg: SomConfig) -> DataFrame:
    """Symmetric (region, other) pairs of different regions that touch."""
    spark = regs.sparkSession
    pairs = neighbour_pairs(spark, cfg, ordered=False)
    r = regs.select("cell", "region")
    j = (pairs.join(r.withColumnRenamed("cell", "a"), "a")
         .join(r.select(F.col("cell").alias("b"), F.col("region").alias("other")), "b"))
    return j.where(F.col("region") != F.col("other")).select("region", "other").distinct()


def region_colors(adjacency: DataFrame, num_regions: int) -> dict[int, int]:
    """Greedy colouring in region order, the lowest of 9 colours not used
    by an already coloured neighbour (a driver step over the map-sized
    adjacency list). With more neighbours than colours a clash is allowed,
    as in the original."""
    adj: dict[int, set[int]] = {}
    for r in adjacency.collect():
        adj.setdefault(r["region"], set()).add(r["other"])
    colors: dict[int, int] = {}
    for reg in range(num_regions):
        used = {colors[o] for o in adj.get(reg, ()) if o in colors}
        free = [c for c in range(K.NUM_REGION_COLORS) if c not in used]
        colors[reg] = free[0] if free else reg % K.NUM_REGION_COLORS
    return colors


def term_differences(weights: DataFrame, features: DataFrame, cfg: SomConfig) -> DataFrame:
    """For every neighbour pair a < b, the feature with the largest
    absolute weight difference ``w_a − w_b`` (first index on ties) and its
    sign: −1 when the most negative difference outweighs the largest."""
    spark = weights.sparkSession
    pairs = neighbour_pairs(spark, cfg, ordered=True)
    wa = weights.select(F.col("cell").alias("a"), F.col("w").alias("wa"))
    wb = weights.select(F.col("cell").alias("b"), F.col("w").alias("wb"))
    d = pairs.join(wa, "a").join(wb, "b").select(
        "a", "b", F.zip_with("wa", "wb", lambda p, q: p - q).alias("d"))
    d = d.select("a", "b", "d", F.array_max("d").alias("mx"), F.array_min("d").alias("mn"))
    neg = (F.col("mn") < 0) & (F.abs(F.col("mn")) > F.col("mx"))
    d = d.select("a", "b",
                 F.when(neg, F.array_position("d", F.col("mn"))).otherwise(
                     F.array_position("d", F.col("mx"))).cast("int").alias("pos"),
                 F.when(neg, F.lit(-1)).otherwise(F.lit(1)).alias("sign"))
    return (d.join(F.broadcast(features.select("idx", "term")), F.col("pos") - 1 == F.col("idx"))
            .select("a", "b", "term", "sign"))


def signed_differences(diffs: DataFrame) -> DataFrame:
    """Lookup in both directions; (b, a) carries the opposite sign."""
    back = diffs.select(F.col("b").alias("a"), F.col("a").alias("b"), "term",
                        (-F.col("sign")).alias("sign"))
    return diffs.select("a", "b", "term", "sign").unionByName(back)


def map_summary(stats: DataFrame, assignments: DataFrame, regs: DataFrame) -> DataFrame:
    """One row over the cells, with outliers and regions, all reduced in
    one aggregation over a union (no join of single rows)."""
    c = stats.select(
        F.lit(1).alias("cells"), F.col("num"), F.col("ssd"), F.col("std_dev"),
        F.lit(0).alias("outlier"), F.lit(None).cast("int").alias("region"))
    o = assignments.where(F.col("cell") == "-1").select(
        F.lit(0).alias("cells"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("double").alias("ssd"),
        F.lit(None).cast("double").alias("std_dev"), F.lit(1).alias("outlier"),
        F.lit(None).cast("int").alias("region"))
    r = regs.select(
        F.lit(0).alias("cells"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("double").alias("ssd"),
        F.lit(None).cast("double").alias("std_dev"), F.lit(0).alias("outlier"), "region")
    u = c.unionByName(o).unionByName(r)
    out = u.agg(
        F.count_if((F.col("cells") == 1) & (F.col("num") == 0)).alias("num_zero"),
        F.count_if(F.col("num") > 0).alias("num_with"),
        F.coalesce(F.sum(F.when(F.col("num") > 0, F.col("num"))), F.lit(0)).cast("long").alias("total_with"),
        F.coalesce(F.sum("outlier"), F.lit(0)).cast("long").alias("num_outliers"),
        F.coalesce(F.sum("ssd"), F.lit(0.0)).alias("ssd"),
        F.countDistinct("region").alias("num_regions"),
        F.coalesce(F.max("num"), F.lit(0)).alias("max_cell_num"),
        F.coalesce(F.max("ssd"), F.lit(0.0)).alias("max_cell_ssd"),
        F.coalesce(F.max("std_dev"), F.lit(0.0)).alias("max_cell_std"))
    return out.withColumn("avg_num", F.when(F.col("num_with") == 0, F.lit(0.0))
                          .otherwise(F.col("total_with") / F.col("num_with")))


def cell_info(stats: DataFrame, tops: DataFrame, regs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Per cell — count, region, top terms, spread, and the signed
    neighbour terms as ``neighbour:±term`` (ordered by neighbour)."""
    terms = tops.groupBy("cell").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))),
                                 lambda s: s["term"]), ", ").alias("top_terms"))
    sd = signed_differences(diffs)
    nb = sd.groupBy(F.col("a").alias("cell")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("b", "sign", "term"))),
        lambda s: F.concat(s["b"].cast("string"), F.lit(":"),
                           F.when(s["sign"] < 0, F.lit("-")).otherwise(F.lit("")), s["term"])),
        " ").alias("neighbour_terms"))
    return (stats.join(regs.select("cell", "region"), "cell", "left").join(terms, "cell", "left")
            .join(nb, "cell", "left")
            .select("cell", "num", "region", "top_terms", "std_dev", "ssd", "neighbour_terms"))


def cell_colors(stats: DataFrame, regs: DataFrame, colors: DataFrame, max_std: float) -> DataFrame:
    """hue = region colour · 40, saturation = −100·(std − max)/max."""
    j = stats.join(regs.select("cell", "region"), "cell", "left").join(colors, "region", "left")
    sat = (F.lit(100.0) * (F.lit(max_std) - F.col("std_dev")) / F.lit(max_std)) if max_std else F.lit(None)
    return j.select("cell", (F.coalesce("color", F.lit(0)) * 40).alias("hue"), sat.cast("double").alias("saturation"))


def luminance_curve(stats: DataFrame) -> DataFrame:
    """(num, luminance) — empty cells 100; otherwise from 95 down by
    60/m per sorted position over the m cells from the last cell of the
    smallest non-zero count, each count taking its last position's value.
    The window runs over the map's cells (map-sized)."""
    w = Window.orderBy("num")
    s = stats.select("num").withColumn("le", F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    min_nz = F.min(F.when(F.col("num") > 0, F.col("num"))).over(Window.partitionBy(F.lit(1)))
    s = s.withColumn("n", total).withColumn("min_nz", min_nz)
    i0 = F.max(F.when(F.col("num") == F.col("min_nz"), F.col("le") - 1)).over(Window.partitionBy(F.lit(1)))
    s = s.withColumn("i0", i0).distinct()
    lum = F.when(F.col("num") == 0, F.lit(100.0)).otherwise(
        F.lit(95.0) - (F.col("le") - 1 - F.col("i0")) * (F.lit(60.0) / (F.col("n") - F.col("i0"))))
    return s.select("num", lum.alias("luminance")).distinct()


def result_distribution(results: DataFrame, assignments: DataFrame, regs: DataFrame) -> DataFrame:
    """Matching documents per cell and region (outliers under -1)."""
    j = results.select("ID").join(assignments.select("ID", "cell"), "ID")
    j = j.join(regs.select(F.col("cell").cast("string").alias("cell"), "region"), "cell", "left")
    return j.groupBy("cell", "region").agg(F.count(F.lit(1)).alias("n"))


def cell_members(assignments: DataFrame, cell: int, lo: float | None = None,
                 hi: float | None = None) -> DataFrame:
    """Documents of a cell by distance to the cell's weights, optionally
    within a distance band."""
    a = assignments.where(F.col("cell") == str(cell))
    if lo is not None:
        a = a.where(F.col("som_cell_distance") >= lo)
    if hi is not None:
        a = a.where(F.col("som_cell_distance") <= hi)
    return a.orderBy("som_cell_distance", F.col("ID").cast("long"))
