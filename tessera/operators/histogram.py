"""Histograms, their specification and comparison, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def levels(pixels: DataFrame, ids: list[str], n: int = 256) -> DataFrame:
    """Dense counts: ids, v (0 to n - 1), n.  Counting combines before the shuffle; filling is per group."""
    counted = pixels.groupBy(*ids, "v").agg(F.count("*").alias("n"))
    frame = counted.select(*ids).distinct().withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return frame.join(counted, [*ids, "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cdf(hist: DataFrame, ids: list[str]) -> DataFrame:
    """Running share of each level; groups are of a fixed number of levels."""
    w = Window.partitionBy(*ids)
    run = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hist.withColumn("cdf", run / F.sum("n").over(w))


def lut(source: DataFrame, target: DataFrame, ids: list[str], n: int = 256) -> DataFrame:
    """ids, i, j: the first level j whose share in the target reaches that of i in the source, the last one if none does.

    An as-of join on the running share: both sides are put in one order (sources before targets of an equal share), and
    the next target seen from a source is its answer.
    """
    t = target.select(*ids, F.col("cdf").alias("x"), F.col("v").alias("j"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("i"))
    s = source.select(*ids, F.col("cdf").alias("x"), F.lit(None).cast("long").alias("j"), F.lit(-1).alias("side"), F.col("v").alias("i"))
    following = Window.partitionBy(*ids).orderBy("x", "side", "j").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = t.unionByName(s).withColumn("next", F.min("j").over(following))
    return out.filter("i IS NOT NULL").select(*ids, "i", F.coalesce("next", F.lit(n - 1)).cast("long").alias("j"))


def bins(pixels: DataFrame, ids: list[str], n: int = 32, width: int = 8) -> DataFrame:
    """ids, bin, p: shares of n bins within the last of ids (a channel); only bins that occur."""
    counted = pixels.groupBy(*ids, F.floor(F.col("v") / width).cast("long").alias("bin")).agg(F.count("*").alias("n_"))
    return counted.withColumn("p", F.col("n_") / F.sum("n_").over(Window.partitionBy(*ids))).drop("n_")


def intersection(shares: DataFrame, channels: int) -> DataFrame:
    """img_a, img_b (a before b), score (least shares summed, 1 at most) and score_mean (over the channels)."""
    a = shares.select(F.col("img").alias("img_a"), "c", "bin", F.col("p").alias("pa"))
    b = shares.select(F.col("img").alias("img_b"), "c", "bin", F.col("p").alias("pb"))
    both = a.join(b, ["c", "bin"]).filter("img_a < img_b").groupBy("img_a", "img_b").agg(F.sum(F.least("pa", "pb")).alias("s"))
    return both.select("img_a", "img_b", F.least(F.col("s"), F.lit(1.0)).alias("score"), (F.col("s") / channels).alias("score_mean"))


def otsu(hist: DataFrame, ids: list[str]) -> DataFrame:
    """ids, t: the level that splits a histogram with the largest variance between the two sides, the first of equals."""
    w = Window.partitionBy(*ids)
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = hist.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("v")).over(upto), "w": F.sum("n").over(w), "s": F.sum(F.col("n") * F.col("v")).over(w)})
    x = x.filter("w0 > 0 AND w0 < w")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.round(F.col("w0") / F.col("w") * ((F.col("w") - F.col("w0")) / F.col("w")) * gap * gap, 6)
    return x.groupBy(*ids).agg(F.max(F.struct(between.alias("b"), (-F.col("v")).alias("v"))).alias("m")).select(*ids, (-F.col("m.v")).alias("t"))
