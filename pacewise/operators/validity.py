"""Cluster validity and spatial statistics over rows (id, label, x) and neighbour pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .areas import likeness
from .graph import components


def sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq(a, b))


def centroids(rows: DataFrame) -> DataFrame:
    """label, n, c: mean vector of each label."""
    one = rows.select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return one.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c")).select("label", "n", F.transform("c", lambda s: s["v"]).alias("c"))


def _mean(rows: DataFrame) -> DataFrame:
    one = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("v"))
    return one.agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c")).select(F.transform("c", lambda s: s["v"]).alias("g"))


def _pairs(rows: DataFrame) -> DataFrame:
    """All pairs of a set of bounded size (the metrics that need them are defined on a sample)."""
    a, b = (rows.select(F.col("id").alias(f"i{s}"), F.col("label").alias(f"l{s}"), F.col("x").alias(f"x{s}")) for s in "ab")
    return a.join(F.broadcast(b), F.col("ia") != F.col("ib")).withColumn("d", dist(F.col("xa"), F.col("xb")))


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean silhouette by Euclidean distance; a label of one row scores 0. ``rows`` is a sample of bounded size."""
    m = _pairs(rows).groupBy("ia", "la", "lb").agg(F.avg("d").alias("m"))
    s = m.groupBy("ia").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("a"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    c, g = centroids(rows), _mean(rows)
    between = c.join(F.broadcast(g), how="cross").agg(F.sum(F.col("n") * sq(F.col("c"), F.col("g"))).alias("b"), F.count("*").alias("k"), F.sum("n").alias("n"))
    inside = rows.join(F.broadcast(c), "label").agg(F.sum(sq(F.col("x"), F.col("c"))).alias("w"))
    return between.join(inside, how="cross").select((F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))).alias("ch"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    c = centroids(rows)
    s = rows.join(F.broadcast(c), "label").groupBy("label").agg(F.avg(dist(F.col("x"), F.col("c"))).alias("s")).join(c, "label")
    a, b = (s.select(F.col("label").alias(f"l{t}"), F.col("s").alias(f"s{t}"), F.col("c").alias(f"c{t}")) for t in "ab")
    r = a.join(F.broadcast(b), F.col("la") != F.col("lb")).withColumn("r", F.try_divide(F.col("sa") + F.col("sb"), dist(F.col("ca"), F.col("cb"))))
    return r.groupBy("la").agg(F.max("r").alias("r")).agg(F.avg("r").alias("db"))


def dunn(rows: DataFrame) -> DataFrame:
    """Smallest distance between labels over the largest inside one, of a sample of bounded size."""
    p = _pairs(rows).agg(F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("a"), F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("b"))
    return p.select(F.try_divide("a", F.coalesce("b", F.lit(0.0))).alias("dunn"))


def i_index(rows: DataFrame) -> DataFrame:
    """((E1 / EK) DK / K)^2."""
    c, g = centroids(rows), _mean(rows)
    e1 = rows.join(F.broadcast(g), how="cross").agg(F.sum(dist(F.col("x"), F.col("g"))).alias("e1"))
    ek = rows.join(F.broadcast(c), "label").agg(F.sum(dist(F.col("x"), F.col("c"))).alias("ek"))
    a, b = (c.select(F.col("label").alias(f"l{t}"), F.col("c").alias(f"c{t}")) for t in "ab")
    dk = a.join(F.broadcast(b), F.col("la") < F.col("lb")).agg(F.max(dist(F.col("ca"), F.col("cb"))).alias("dk"))
    k = c.agg(F.count("*").alias("k"))
    return e1.join(ek, how="cross").join(dk, how="cross").join(k, how="cross").select(F.pow(F.try_divide("e1", "ek") * F.col("dk") / F.col("k"), 2).alias("i_index"))


def entropy(u: Column) -> Column:
    return -F.aggregate(u, F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(1e-12)) * F.log(F.greatest(v, F.lit(1e-12))))


def partition_measures(rows: DataFrame, k: int) -> DataFrame:
    """Partition coefficient, entropy and sharpness of rows (u)."""
    pc = F.aggregate("u", F.lit(0.0), lambda s, v: s + v * v)
    return rows.agg(F.avg(pc).alias("pc"), F.avg(entropy(F.col("u"))).alias("pe")).withColumn("sharpness", 1 - F.col("pe") / F.log(F.lit(float(k))))


def neighbour_share(labels: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Share of neighbouring pairs (each once) with one label."""
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ij")
    return adjacency.where("i < j").join(a, "i").join(b, "j").agg(F.avg((F.col("li") == F.col("lj")).cast("double")).alias("share"))


def size_entropy(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    p = n.withColumn("p", F.col("n") / total)
    out = p.agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("entropy"), (100 * F.max("p")).alias("largest_pct"))
    return out.withColumn("degenerate", F.col("largest_pct") > 90).withColumn("near", F.col("largest_pct") >= 85)


def moran(values: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Moran's I of (id, label) with row-standardised neighbours (i, j)."""
    m = values.join(F.broadcast(values.agg(F.avg("label").alias("m"))), how="cross").select("id", (F.col("label") - F.col("m")).alias("z"))
    w = adjacency.join(adjacency.groupBy("i").agg(F.count("*").alias("deg")), "i")
    num = w.join(m.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(m.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").agg(F.sum(F.col("zi") * F.col("zj") / F.col("deg")).alias("num"), F.countDistinct("i").alias("s0"))
    return num.join(m.agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.count("*").alias("n")), how="cross").select((F.col("n") / F.col("s0") * F.try_divide("num", "den")).alias("moran_i"))


def moran_p(values: pd.DataFrame, i: np.ndarray, j: np.ndarray, permutations: int = 999, seed: int = 42) -> tuple[float, float]:
    """Moran's I of a block in memory and its pseudo p-value by permutations."""
    z = values["label"].to_numpy(float) - values["label"].mean()
    deg = np.bincount(i, minlength=len(z))
    w = 1 / deg[i]
    stat = lambda v: len(v) / (deg > 0).sum() * (v[i] * v[j] * w).sum() / (v @ v)
    g = np.random.Generator(np.random.PCG64(seed))
    own = stat(z)
    larger = sum(stat(g.permutation(z)) >= own for _ in range(permutations))
    return own, (min(larger, permutations - larger) + 1) / (permutations + 1)


def blocks(labels: DataFrame, adjacency: DataFrame) -> DataFrame:
    """id, label, block: components of neighbours with one label."""
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ij")
    same = adjacency.join(a, "i").join(b, "j").where("li = lj").select(F.col("i").alias("a"), F.col("j").alias("b"))
    comp = components(same, labels.select(F.col("id").alias("node")))
    return labels.join(comp.select(F.col("node").alias("id"), F.col("component").alias("block")), "id")


def similarity(x: Column) -> Column:
    return 1 / (1 + x * x)


def block_table(rows: DataFrame, blk: DataFrame) -> DataFrame:
    """label, block, v (rows), share (of its label), c (centre of x), dbar (mean distance to it), and the centre's place if rows have cx and cy."""
    r = rows.join(blk.select("id", "block"), "id")
    c = centroids(r.select(F.col("block").alias("label"), "x")).select(F.col("label").alias("block"), F.col("n").alias("v"), "c")
    place = [F.avg(k).alias(k) for k in ("cx", "cy") if k in r.columns]
    out = r.join(c, "block").groupBy("label", "block", "v").agg(F.avg(dist(F.col("x"), F.col("c"))).alias("dbar"), F.first("c").alias("c"), *place)
    own = out.groupBy("label").agg(F.sum("v").alias("cn"))  # a row for each label
    return out.join(F.broadcast(own), "label").withColumn("share", F.col("v") / F.col("cn"))


def desc_contribution(table: DataFrame) -> DataFrame:
    """What each block of ``block_table`` adds to DESC: share squared over dbar squared, for blocks of two rows or more whose rows differ."""
    ok = (F.col("v") >= 2) & (F.col("dbar") > 1e-9)
    return table.withColumn("kontribusi", F.when(ok, F.col("share") * F.col("share") / (F.col("dbar") * F.col("dbar"))).otherwise(0.0))


def largest_blocks(table: DataFrame, most: int = 3000) -> DataFrame:
    """The largest blocks of each label, the smaller number first on a tie: pairs are defined on so many."""
    order = Window.partitionBy("label").orderBy(F.desc("v"), "block")
    return table.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _block_pairs(table: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of blocks of one label, each once."""
    a, b = (table.select("label", *[F.col(k).alias(f"{k}{s}") for k in ("block", "share", "c", *cols)]) for s in "ab")
    return a.join(b, "label").where("blocka < blockb")


def desc_pesc(table: DataFrame) -> DataFrame:
    """DESC, the sum of the blocks' contributions, and PESC: over pairs of a label's blocks, shares over distance of places (km), of centres and the number of blocks."""
    desc = desc_contribution(table).agg(F.sum("kontribusi").alias("desc"))
    count = table.groupBy("label").agg(F.count("*").alias("bn"))
    p = _block_pairs(largest_blocks(table), ["cx", "cy"]).join(F.broadcast(count), "label")
    under = F.hypot((F.col("cxa") - F.col("cxb")) / 1000, (F.col("cya") - F.col("cyb")) / 1000) * dist(F.col("ca"), F.col("cb")) * F.col("bn")
    pesc = p.withColumn("under", under).where("under > 1e-12").agg(F.coalesce(F.sum(F.col("sharea") * F.col("shareb") / F.col("under")), F.lit(0.0)).alias("pesc"))
    return desc.join(pesc, how="cross")


def scale(rows: DataFrame) -> DataFrame:
    """One row with s, the mean distance of the rows to their mean."""
    return rows.join(F.broadcast(_mean(rows)), how="cross").agg(F.avg(dist(F.col("x"), F.col("g"))).alias("s"))


def desc_pesc_n(rows: DataFrame, blk: DataFrame, near: DataFrame | None = None, cell: float = 100.0) -> DataFrame:
    """DESC-N, PESC-N, contiguity and homogeneity, each weighted by the labels' sizes; s and the number of blocks.

    A block's distance is dbar / s, 1 for a single row. ``near`` has a, b (blocks, a < b) and d, the smallest distance of
    their cells; it counts in cells, 1 at least. Without it pairs are met on arrays and summed up there. A label of one
    block has a PESC-N of 1.
    """
    own = rows.join(blk.select("id", "block"), "id")
    table = written(block_table(rows, blk).join(F.broadcast(scale(rows)), how="cross"), "block-table")
    far = F.when(F.col("v") == 1, 1.0).otherwise(F.coalesce(F.try_divide("dbar", "s"), F.lit(0.0)))
    table = table.withColumn("g", similarity(far))
    per = table.groupBy("label").agg(F.first("cn").alias("cn"), F.count("*").alias("bn"), F.first("s").alias("s"), F.sum(F.col("share") * F.col("share")).alias("kont"), F.sum(F.col("share") * F.col("g")).alias("homo"), F.sum(F.col("share") * F.col("share") * F.col("g")).alias("desc"))
    if near is None:
        pairs = likeness(own.select("label", "block", "cx", "cy"), table.select("label", "block", "share", "c", "s"), cell)
    else:
        p = _block_pairs(table, ["s"]).join(near.select(F.col("a").alias("blocka"), F.col("b").alias("blockb"), "d"), ["blocka", "blockb"])
        w = F.col("sharea") * F.col("shareb")
        like = similarity(F.coalesce(F.try_divide(dist(F.col("ca"), F.col("cb")), F.col("sa")), F.lit(0.0))) / F.greatest(F.col("d") / cell, F.lit(1.0))
        pairs = p.groupBy("label").agg((F.sum(w * like) / F.sum(w)).alias("p"))
    every = per.join(F.broadcast(pairs), "label", "left").withColumn("p", F.when(F.col("bn") < 2, 1.0).otherwise(F.col("p")))
    mean = lambda c: F.sum(F.col("cn") * F.col(c)) / F.sum("cn")
    return every.agg(mean("desc").alias("desc_n"), mean("p").alias("pesc_n"), mean("kont").alias("kontiguitas"), mean("homo").alias("homogenitas"), F.first("s").alias("s"), F.sum("bn").alias("n_blok"))
