"""Pixel tables: row, col and value columns; kernels are equi-joins or aggregations.

Places without a row are unset, repeated places count once in masks and twice in means, null values are left out of
means, and empty tables give no rows (a shape without rows is 1 x 1).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators.graph import components


def gray(pixels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """img, gray, n: weighted sums of the channels' mean level within each of an image's blocks (img, block, c, v)."""
    parts = [w * F.coalesce(F.avg(F.when(F.col("c") == c, F.col("v"))), F.lit(0.0)) for c, w in weights.items()]
    level = pixels.groupBy("img", "block").agg(sum(parts[1:], parts[0]).alias("g"))
    return level.withColumn("gray", F.floor(F.round("g", 6)).cast("long")).groupBy("img", "gray").agg(F.count("*").alias("n"))


def downscale(raster: DataFrame, factor: int) -> DataFrame:
    """row, col, avg of each factor x factor block."""
    block = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    return raster.groupBy(*block).agg(F.avg("v").alias("avg"))


def gaussian3(raster: DataFrame, shape: DataFrame, sigma: float = 0.8) -> DataFrame:
    """row, col, val: 3 x 3 Gaussian, borders reflected without repeating the edge; shape is one row of n_rows, n_cols.

    Pixels send their weighted value to the up to nine places they count for, which are then summed.
    """
    side = math.exp(-1 / (2 * sigma * sigma))
    w = {-1: side / (1 + 2 * side), 0: 1 / (1 + 2 * side), 1: side / (1 + 2 * side)}
    moves = [F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(w[a] * w[b]).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    at = raster.join(F.broadcast(shape)).select("row", "col", "v", "n_rows", "n_cols", F.explode(F.array(*moves)).alias("m"))
    # The place that looks at a pixel through offset m, and the one that sees it once more by reflection.
    to = at.select("row", "col", "v", "m", "n_rows", "n_cols", F.explode(F.array(F.lit(False), F.lit(True))).alias("mirror_r")).withColumn("mirror_c", F.explode(F.array(F.lit(False), F.lit(True))))

    def place(x: str, d: str, n: str, mirror: str):
        plain = F.col(x) - F.col(f"m.{d}")
        low, high = (F.col(f"m.{d}") == -1) & (F.col(x) == 1), (F.col(f"m.{d}") == 1) & (F.col(x) == F.col(n) - 2)
        mirrored = F.when(low, F.lit(0)).when(high, F.col(n) - 1)
        return F.when(F.col(mirror), mirrored).otherwise(F.when(plain.between(0, F.col(n) - 1), plain))

    sent = to.select(place("row", "dr", "n_rows", "mirror_r").cast("long").alias("r"), place("col", "dc", "n_cols", "mirror_c").cast("long").alias("c"), (F.col("m.w") * F.col("v")).alias("x"))
    return sent.filter("r IS NOT NULL AND c IS NOT NULL").groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum("x").alias("val"))


def composite(raster: DataFrame, mask: DataFrame, ground: int = 128) -> DataFrame:
    """row, col, val: the pixel where its mask is set, else the ground; fractions are cut off."""
    a = F.coalesce(F.col("m"), F.lit(0)).cast("double")
    return raster.join(mask, ["row", "col"], "left").select("row", "col", F.floor(F.col("v") * a + ground * (1 - a)).cast("long").alias("val"))


def boundary_strips(raster: DataFrame, mask: DataFrame, shape: DataFrame, widest: int = 10) -> DataFrame:
    """side (0 top, 1 right, 2 bottom, 3 left), n, mean of the masked pixels within a strip at each side."""
    width = F.greatest(F.lit(1), F.least(F.lit(widest), F.floor(F.col("n_rows") / 4), F.floor(F.col("n_cols") / 4)))
    x = raster.join(mask.filter("m > 0"), ["row", "col"], "left_semi").join(F.broadcast(shape)).withColumn("wd", width)
    inside = [F.col("row") < F.col("wd"), F.col("col") >= F.col("n_cols") - F.col("wd"), F.col("row") >= F.col("n_rows") - F.col("wd"), F.col("col") < F.col("wd")]
    sides = F.filter(F.array(*[F.when(c, F.lit(i).cast("long")) for i, c in enumerate(inside)]), lambda s: s.isNotNull())
    return x.select(F.explode(sides).alias("side"), "v").groupBy("side").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


# -- Masks as sets of places (row, col) ----------------------------------------------------------------------------


def frame(shape: DataFrame) -> DataFrame:
    """row, col of every place of a grid of one-row shape n_rows, n_cols: rows are dealt, columns follow in place."""
    rows = shape.select("n_cols", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1)).alias("col"))


def box(size: int) -> list[tuple[int, int]]:
    """Offsets of a square of odd size."""
    k = size // 2
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of a disc of odd size: in each row as many places as the circle's chord, rounded."""
    k = size // 2
    wide = {a: round(k * math.sqrt((k * k - a * a) / (k * k))) if k else 0 for a in range(-k, k + 1)}
    return [(a, b) for a in wide for b in range(-wide[a], wide[a] + 1)]


def dilated(mask: DataFrame, offsets: list[tuple[int, int]], shape: DataFrame) -> DataFrame:
    """Places within the grid that an offset leads to from a place of the mask."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    to = mask.select("row", "col", F.explode(moves).alias("m")).select((F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col")).distinct()
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("n_rows")) & (F.col("col") < F.col("n_cols"))
    return to.join(F.broadcast(shape)).filter(inside).select("row", "col")


def eroded(mask: DataFrame, offsets: list[tuple[int, int]], shape: DataFrame) -> DataFrame:
    """Places all of whose offsets within the grid lead to the mask; offsets are symmetrical."""
    outside = frame(shape).join(mask, ["row", "col"], "left_anti")
    return mask.select("row", "col").distinct().join(dilated(outside, offsets, shape), ["row", "col"], "left_anti")


def closed(mask: DataFrame, offsets: list[tuple[int, int]], shape: DataFrame) -> DataFrame:
    return eroded(dilated(mask, offsets, shape), offsets, shape)


def labelled(mask: DataFrame, width: int = 1 << 31) -> DataFrame:
    """row, col, component of 8-connected regions; a component is its first place in row order, as row * width + col."""
    at = mask.select("row", "col", (F.col("row") * width + F.col("col")).alias("id")).distinct()
    links = None
    for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)):  # each pair of neighbours once
        there = at.select((F.col("row") - a).alias("row"), (F.col("col") - b).alias("col"), F.col("id").alias("v"))
        pair = at.join(there, ["row", "col"]).select(F.col("id").alias("u"), "v")
        links = pair if links is None else links.unionByName(pair)
    return at.join(components(links, "u", "v").withColumnRenamed("node", "id"), "id", "left").select("row", "col", F.coalesce("component", "id").alias("component"))


def component_stats(labels: DataFrame) -> DataFrame:
    """component, area, bounding box (ends included) and centroid, cut off to whole places."""
    of = {"row0": F.min("row"), "col0": F.min("col"), "row1": F.max("row"), "col1": F.max("col"), "c_row": F.floor(F.avg("row")), "c_col": F.floor(F.avg("col"))}
    return labels.groupBy("component").agg(F.count("*").alias("area"), *[c.cast("long").alias(n) for n, c in of.items()])


def area_between(stats: DataFrame, image_area: Column, low: float = 1e-4, high: float = 0.05) -> DataFrame:
    """Components of at least `low` and at most `high` of the image, both cut off to whole places."""
    return stats.filter(F.col("area").between(F.floor(image_area * low), F.floor(image_area * high)))


def extracted(stats: DataFrame, shape: DataFrame, pad: int = 8) -> DataFrame:
    """piece_id (from 0, by component), component, area and the crop's box y0, x0, y1, x1 (ends excluded), padded and kept
    within the image.  Ids are gapless, so one pass orders the components; there are as many as pieces."""
    zero = F.lit(0).cast("long")
    at = {"y0": F.greatest(zero, F.col("row0") - pad), "x0": F.greatest(zero, F.col("col0") - pad), "y1": F.least("n_rows", F.col("row1") + 1 + pad), "x1": F.least("n_cols", F.col("col1") + 1 + pad)}
    ids = (F.row_number().over(Window.orderBy("component")) - 1).cast("long")
    return stats.join(F.broadcast(shape)).select(ids.alias("piece_id"), "component", "area", *[c.alias(n) for n, c in at.items()])


# -- Geometry ------------------------------------------------------------------------------------------------------


def resized(raster: DataFrame, shape: DataFrame, long_edge: int) -> DataFrame:
    """row, col, v of the image whose longer edge is long_edge at most, each place the mean of what it covers, by area;
    smaller images stay as they are.  A pixel is sent to the places that it overlaps, four at most."""
    scale = F.least(F.lit(1.0), long_edge / F.greatest("n_rows", "n_cols"))
    size = {n: F.greatest(F.lit(1), F.floor(F.col(n) * scale + 0.5)).cast("long") for n in ("n_rows", "n_cols")}
    at = raster.join(F.broadcast(shape.select("n_rows", "n_cols", size["n_rows"].alias("h"), size["n_cols"].alias("w"))))

    def covers(x: str, n: str, m: str) -> Column:
        """(place, share) of the target places over which a pixel's edge from x to x + 1 lies."""
        lo, hi = F.col(x) * F.col(m) / F.col(n), (F.col(x) + 1) * F.col(m) / F.col(n)
        first, last = F.floor(lo + 1e-9).cast("long"), F.least(F.ceil(hi - 1e-9).cast("long"), F.col(m)) - 1
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("k"), (F.least(hi, k + 1.0) - F.greatest(lo, k.cast("double"))).alias("part")))

    sent = at.select("v", F.explode(covers("row", "n_rows", "h")).alias("r"), covers("col", "n_cols", "w").alias("cs")).select("v", "r", F.explode("cs").alias("c"))
    part = F.col("r.part") * F.col("c.part")
    return sent.groupBy(F.col("r.k").alias("row"), F.col("c.k").alias("col")).agg((F.sum(F.col("v") * part) / F.sum(part)).alias("v"))


def rotated(raster: DataFrame, shape: DataFrame, degrees: float, ground: float = 128.0) -> DataFrame:
    """row, col, v of the image turned counter-clockwise on the canvas that holds it, by nearest neighbours; ground where
    nothing lies.  Every place of the canvas looks up the pixel that it came from, an equi-join."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    size = lambda a, b: F.ceil(F.abs(F.col("n_rows") * a) + F.abs(F.col("n_cols") * b) - 1e-9).cast("long")
    canvas = shape.select(size(c, s).alias("n_rows"), size(s, c).alias("n_cols"), F.col("n_rows").alias("h"), F.col("n_cols").alias("w"))
    at = frame(canvas.select("n_rows", "n_cols")).join(F.broadcast(canvas))
    dy, dx = F.col("row") - (F.col("n_rows") - 1) / 2, F.col("col") - (F.col("n_cols") - 1) / 2
    y, x = s * dx + c * dy + (F.col("h") - 1) / 2, c * dx - s * dy + (F.col("w") - 1) / 2
    near = lambda z: F.floor(F.round(z, 9) + 0.5).cast("long")
    to = at.select("row", "col", near(y).alias("y"), near(x).alias("x"))
    return to.join(raster.select(F.col("row").alias("y"), F.col("col").alias("x"), "v"), ["y", "x"], "left").select("row", "col", F.coalesce("v", F.lit(ground)).alias("v"))


def inner_distance(masks: DataFrame, image: str = "image") -> DataFrame:
    """image, row, col, distance: the city-block distance of each set place to the nearest one that is not.

    Two passes of windows: along the rows the distance to the ends of a run, then along the columns the least of these
    with the way to them, upwards and downwards; a column's own ends count as well.  No window is larger than a row or a
    column of an image.
    """
    m = masks.select(image, "row", "col").dropna().distinct()

    def runs(df: DataFrame, along: str, across: str) -> tuple[DataFrame, Window]:
        """Gapless runs along one axis."""
        nth = F.row_number().over(Window.partitionBy(image, across).orderBy(along))
        return df.withColumn("run", F.col(along) - nth), Window.partitionBy(image, across, "run")

    m, w = runs(m, "col", "row")
    m = m.withColumn("d", F.least(F.col("col") - F.min("col").over(w), F.max("col").over(w) - F.col("col")) + 1)
    m, w = runs(m, "row", "col")
    up, down = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("row"), F.desc("row")))
    ends = F.least(F.col("row") - F.min("row").over(w), F.max("row").over(w) - F.col("row")) + 1
    near = F.least(F.min(F.col("d") - F.col("row")).over(up) + F.col("row"), F.min(F.col("d") + F.col("row")).over(down) - F.col("row"))
    return m.select(image, "row", "col", F.least(ends, near).cast("long").alias("distance"))


def watershed(masks: DataFrame, image: str = "image", share: float = 0.4) -> DataFrame:
    """image, row, col, part (from 1; 0 for islands that no core reaches): masks split at their necks; rows of an image are
    one piece's mask, which is bounded by the piece, and one worker floods it."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = p.row.min(), p.col.min()
        m = np.zeros((p.row.max() - r0 + 1, p.col.max() - c0 + 1), bool)
        m[p.row - r0, p.col - c0] = True
        return pd.DataFrame({image: key[0], "row": p.row, "col": p.col, "part": kernels.watershed(m, share)[p.row - r0, p.col - c0]})

    return masks.select(image, "row", "col").distinct().groupBy(image).applyInPandas(run, f"{image} long, row long, col long, part long")
