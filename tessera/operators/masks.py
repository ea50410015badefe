"""Masks as sets: filters, overlaps, suppression, splitting.

Sets hold a place once; masks without places overlap nothing; null ids meet nothing; repeated edges and masks count once;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import aspect
from tessera.session import Scratch, materialize


def judged(masks: DataFrame, image_area: int, low: float = 0.0002, high: float = 0.04, solidity: float = 0.60, aspects: tuple[float, float] = (0.20, 5.0)) -> DataFrame:
    """masks with kept_reason: the first test that fails (area, solidity, aspect), or kept."""
    shape = aspect(F.col("w").cast("double"), F.col("h").cast("double"))
    ok = F.col("area").between(int(image_area * low), int(image_area * high))
    reason = F.when(~ok, "area").when(F.col("solidity") < solidity, "solidity").when(~shape.between(*aspects), "aspect").otherwise("kept")
    return masks.withColumn("kept_reason", reason)


def gathered(sets: DataFrame) -> DataFrame:
    """mask_id, n, tokens (freq, px) of each set, its rarest pixels first."""
    freq = sets.groupBy("px").agg(F.count("*").alias("freq"))
    return sets.join(freq, "px").groupBy("mask_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("freq", "px"))).alias("tokens"))


def candidates(sets: DataFrame, least: float, hot: int = 20_000, inter: int = 1, large: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """a, b, pairs that can overlap by more than `least` of the smaller one, a, and by `inter` pixels; sets: gathered().

    large: those of them that b is taken from.  With carry also na, px and these columns of both sets (.._a, .._b).

    If a shares w pixels or more, one of its n - w + 1 rarest is in b (prefix), and from the first shared pixel on, the
    rarest, both sets have w left (position).  So the common pixels of large sets are not joined on.  A pixel of many masks
    is split by the larger set, and the few prefixes that hold it are sent to every part.
    """
    n = F.col("n")
    # The least number of shared pixels, by the very division that decides in the end.
    low = F.floor(n * least)
    sized = sets.withColumn("w", F.greatest(F.when(low / n > least, low).otherwise(low + 1), F.lit(inter))).filter("n >= w")
    parts = F.ceil(F.col("t.freq") / hot).cast("int")
    of_a, of_b = ([F.col(c).alias(f"{c}_{x}") for c in carry] for x in "ab")
    small = sized.select(F.col("mask_id").alias("a"), F.col("n").alias("na"), "w", *of_a, F.posexplode(F.slice("tokens", F.lit(1), (F.col("n") - F.col("w") + 1).cast("int"))).alias("i", "t")).filter("t.freq > 1")
    small = small.select("a", "na", "w", "i", *(f"{c}_a" for c in carry), F.col("t.px").alias("px"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    large = (sets if large is None else large).select(F.col("mask_id").alias("b"), F.col("n").alias("nb"), *of_b, F.posexplode("tokens").alias("j", "t")).filter("t.freq > 1")
    large = large.select("b", "nb", "j", *(f"{c}_b" for c in carry), F.col("t.px").alias("px"), F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= F.col("w")
    # Merged: what a plan takes for the size of exploded rows would have them broadcast.
    met = small.join(large.hint("merge"), ["px", "part"]).filter(smaller & left)
    return met.select("a", "b", *(["na", "px", *(f"{c}_{x}" for c in carry for x in "ab")] if carry else []))


def overlaps(sets: DataFrame, least: float, inter: int = 1, scores: DataFrame | None = None, light: int = 64) -> DataFrame:
    """a, b (a < b), inter, ov: pairs of masks that share `inter` pixels or more, with an overlap coefficient above `least`.

    sets: mask_id, px (distinct).  candidates() tells which pairs can.  Sets of up to `light` pixels travel with their pixels,
    so a pair is counted where it meets, once, at the rarest pixel that both have: pairs are not shuffled.  Pairs with a
    larger set are made distinct and meet both sets.  scores: mask_id, score; then masks without one take no part, and
    score_a and score_b come along.
    """
    whole = gathered(sets.filter("mask_id IS NOT NULL AND px IS NOT NULL"))
    with_score = () if scores is None else ("score",)
    if scores is not None:
        whole = whole.join(scores.groupBy("mask_id").agg(F.max("score").alias("score")), "mask_id")
    g = materialize(whole, "sets").withColumn("set", F.transform("tokens", lambda t: t["px"]))
    carry = ("set", *with_score)
    met = candidates(g.filter(F.col("n") <= light), least, inter=inter, carry=carry).withColumn("both", F.array_intersect("set_a", "set_b"))
    met = met.filter(F.get("both", F.lit(0)) == F.col("px")).drop("px")
    large = g.filter(F.col("n") > light)
    if large.limit(1).count():
        pairs = candidates(g, least, inter=inter, large=large).distinct()
        of_a, of_b = ([F.col(c).alias(f"{c}_{x}") for c in carry] for x in "ab")
        more = pairs.join(g.select(F.col("mask_id").alias("a"), F.col("n").alias("na"), *of_a), "a").join(g.select(F.col("mask_id").alias("b"), *of_b), "b")
        met = met.unionByName(more.withColumn("both", F.array_intersect("set_a", "set_b")))
    met = met.withColumn("inter", F.size("both").cast("long")).withColumn("ov", F.col("inter") / F.col("na"))
    met = met.filter((F.col("ov") > least) & (F.col("inter") >= inter))
    first = F.col("a") < F.col("b")
    sides = [F.when(first, F.col(f"score_{x}")).otherwise(F.col(f"score_{y}")).alias(f"score_{x}") for x, y in ("ab", "ba") if with_score]
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "inter", "ov", *sides)


def suppressed(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """mask_id of the masks that stay when, from the highest score down, a mask goes if it overlaps one that stayed.

    masks: mask_id, score; edges: a, b, and score_a, score_b, where these are known, which saves two joins of all edges.
    Every round takes the masks that no undecided stronger one touches, lets their neighbours go, and goes on with the links
    between masks that are left, which shrink fast; what never goes stays.  The number of rounds is that of the longest chain
    of ever weaker neighbours at most.
    """
    if "score_a" not in edges.columns:
        for x in "ab":
            edges = edges.join(masks.select(F.col("mask_id").alias(x), F.col("score").alias(f"score_{x}")), x)
    ka, kb = (F.struct((-F.col(f"score_{x}")).alias("s"), F.col(x).alias("mask_id")) for x in "ab")
    arcs = edges.select(F.when(kb < ka, F.col("a")).otherwise(F.col("b")).alias("weak"), F.when(kb < ka, F.col("b")).otherwise(F.col("a")).alias("strong"))
    with Scratch(masks.sparkSession) as scratch:
        arcs = scratch.table(arcs.filter("weak <> strong"), "arcs")
        gone = None
        while arcs.limit(1).count():
            lead = arcs.select("strong").distinct().join(arcs.select(F.col("weak").alias("strong")).distinct(), "strong", "left_anti")
            now = scratch.table(arcs.join(lead, "strong", "left_semi").select("weak").distinct(), "gone")
            gone = now if gone is None else gone.unionByName(now)
            left = arcs.join(now, "weak", "left_anti").join(now.withColumnRenamed("weak", "strong"), "strong", "left_anti").select("weak", "strong")
            last, arcs = arcs, scratch.table(left, "arcs")
            scratch.drop(last)
        out = masks.select("mask_id").distinct()
        return out if gone is None else out.join(materialize(gone, "gone").withColumnRenamed("weak", "mask_id"), "mask_id", "left_anti")


def split(masks: DataFrame, children: DataFrame, min_area: int, share: float = 0.15) -> DataFrame:
    """mask_id, parent_id, area, refined: parents with two valid children or more give way to these.

    children: parent_id, child, area; valid: at least min_area and `share` of the parent.  mask_id of a child is
    "parent/child".
    """
    valid = children.join(masks.select(F.col("mask_id").alias("parent_id"), F.col("area").alias("whole")), "parent_id").filter((F.col("area") >= min_area) & (F.col("area") >= share * F.col("whole")))
    many = valid.groupBy("parent_id").agg(F.count("*").alias("n")).filter("n >= 2").select("parent_id")
    new = valid.join(many, "parent_id", "left_semi").select(F.concat_ws("/", F.col("parent_id").cast("string"), "child").alias("mask_id"), "parent_id", "area", F.lit(True).alias("refined"))
    old = masks.join(many.withColumnRenamed("parent_id", "mask_id"), "mask_id", "left_anti")
    return new.unionByName(old.select(F.col("mask_id").cast("string").alias("mask_id"), F.lit(None).cast("long").alias("parent_id"), "area", F.lit(False).alias("refined")))
