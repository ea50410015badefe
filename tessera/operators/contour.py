"""Ordered point series: curvature, corners, sides, polygons.  Windows run within one contour.

Points come in the order of idx, which is unique within a contour; a contour of few points has an area of 0 and the
neighbours that it has; points with a null coordinate give null angles; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators.outline import hull_corners, hulls


def _wrapped(points: DataFrame, id_: str) -> DataFrame:
    """Points with their circular neighbours: xp, yp before and xn, yn after."""
    w = Window.partitionBy(id_).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {}
    for c in ("x", "y"):
        cols[f"{c}p"] = F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
        cols[f"{c}n"] = F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return points.withColumns(cols)


def signed_curvature(points: DataFrame, id_: str) -> DataFrame:
    """id, idx, kappa: turning angle at inner points; a contour of fewer than three points has a single 0 at idx 0."""
    w = Window.partitionBy(id_).orderBy("idx")
    cols = {"n": F.count("*").over(Window.partitionBy(id_))}
    for c in ("x", "y"):
        cols |= {f"{c}1": F.col(c) - F.lag(c).over(w), f"{c}2": F.lead(c).over(w) - F.col(c)}
    p = points.withColumns(cols)
    turn = F.atan2(F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2"), F.col("x1") * F.col("x2") + F.col("y1") * F.col("y2"))
    inner = p.filter("x1 IS NOT NULL AND x2 IS NOT NULL").select(id_, "idx", turn.alias("kappa"))
    return inner.unionByName(p.filter("n < 3").select(id_, F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("kappa")).distinct())


def corner_angles(points: DataFrame, id_: str) -> DataFrame:
    """id, idx, angle_deg: inner angle at each point of the closed contour; 0 where a neighbour coincides."""
    p = _wrapped(points, id_)
    ax, ay, bx, by = F.col("xp") - F.col("x"), F.col("yp") - F.col("y"), F.col("xn") - F.col("x"), F.col("yn") - F.col("y")
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cos = F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / F.when(size > 0, size)))).otherwise(1.0)
    return p.select(id_, "idx", F.degrees(F.acos(cos)).alias("angle_deg"))


def box_corners(points: DataFrame, id_: str) -> DataFrame:
    """id, corner (0 to 3, clockwise from the top left), cx, cy of each contour's bounding box."""
    box = points.groupBy(id_).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corners = [F.struct(F.lit(i).cast("long").alias("corner"), F.col(x).alias("cx"), F.col(y).alias("cy")) for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))]
    return box.select(id_, F.explode(F.array(*corners)).alias("k")).select(id_, "k.*")


def nearest_points(points: DataFrame, corners: DataFrame, id_: str) -> DataFrame:
    """id, corner, idx: the contour's point closest to each corner, the first of equals."""
    d = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    best = points.join(corners, id_).groupBy(id_, "corner").agg(F.min(F.struct(F.round(d, 9).alias("d"), "idx")).alias("m"))
    return best.select(id_, "corner", F.col("m.idx").alias("idx"))


def side_segments(points: DataFrame, nearest: DataFrame, id_: str) -> DataFrame:
    """id, side, n_points: points from each corner to the next along the contour, ends shared, the last side wrapping."""
    n = points.groupBy(id_).agg(F.count("*").alias("n"))
    w = Window.partitionBy(id_).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = nearest.select(id_, "idx").distinct().withColumns({"side": (F.row_number().over(w) - 1).cast("long"), "to": F.lead("idx").over(w), "first": F.first("idx").over(whole)})
    count = F.when(F.col("to").isNotNull(), F.col("to") - F.col("idx") + 1).otherwise(F.col("n") - F.col("idx") + F.col("first") + 1)
    return at.join(n, id_).select(id_, "side", count.cast("long").alias("n_points"))


def centred(sides: DataFrame, ids: list[str]) -> DataFrame:
    return sides.withColumn("k", F.col("k") - F.avg("k").over(Window.partitionBy(*ids)))


def resampled(sides: DataFrame, ids: list[str], n_in: int, n_out: int) -> DataFrame:
    """ids, s, k: linear interpolation at n_out even places, by two lookups in the side's own samples."""
    samples = sides.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "k"))), lambda s: s["k"]).alias("ks"))
    x = samples.select(*ids, "ks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_out - 1).cast("long"))).alias("s")).withColumn("p", F.col("s") * (n_in - 1) / F.lit(float(n_out - 1)))
    lo = F.floor("p").cast("int")
    a, b = F.get("ks", lo), F.get("ks", F.least(lo + 1, F.lit(n_in - 1)))
    return x.select(*ids, "s", (a + (b - a) * (F.col("p") - lo)).alias("k"))


def classified(sides: DataFrame, ids: list[str], flat: float) -> DataFrame:
    """ids, is_flat (mean absolute value below `flat`), peak (signed value of largest size, the first of equals)."""
    size = F.round(F.abs("k"), 9)
    out = sides.groupBy(*ids).agg((F.avg(F.abs("k")) < flat).alias("is_flat"), F.max(F.struct(size.alias("m"), (-F.col("idx")).alias("i"), "k")).alias("x"))
    return out.select(*ids, "is_flat", F.col("x.k").alias("peak"))


def polygons(points: DataFrame, id_: str) -> DataFrame:
    """id, area (shoelace), perimeter, compactness (4 pi area / perimeter squared, 0 without a perimeter)."""
    p = _wrapped(points, id_)
    dx, dy = F.col("xn") - F.col("x"), F.col("yn") - F.col("y")
    out = p.groupBy(id_).agg((F.abs(F.sum(F.col("x") * F.col("yn") - F.col("xn") * F.col("y"))) / 2).alias("area"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"))
    full = 4 * F.pi() * F.col("area") / F.when(F.col("perimeter") > 0, F.col("perimeter") * F.col("perimeter"))
    return out.withColumn("compactness", F.coalesce(full, F.lit(0.0)))


def orientation(points: DataFrame, id_: str) -> DataFrame:
    """id, angle_mod180: direction of the principal axis in degrees, modulo 180."""
    got = points.groupBy(id_).agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    angle = F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    return got.select(id_, F.when(angle < 0, angle + 180).otherwise(angle).alias("angle_mod180"))


def largest(points: DataFrame, id_: str, image: str) -> DataFrame:
    """image, contour (its id), area: the contour of the largest area in each image, the smallest id of equals."""
    area = polygons(points, id_).select(id_, F.round("area", 6).alias("area")).join(points.select(id_, image).distinct(), id_)
    best = area.groupBy(image).agg(F.max(F.struct("area", (-F.col(id_)).alias("i"))).alias("x"))
    return best.select(image, (-F.col("x.i")).alias("contour"), F.col("x.area").alias("area"))


def shapes(points: DataFrame, id_: str) -> DataFrame:
    """id, solidity, merged (whether a dent is deeper than its share of the perimeter), corners (idx of up to four): what
    needs the hull or the whole outline at once; a contour is one group, bounded by the outline of a piece."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        xy = p[["x", "y"]].to_numpy(float)
        at = p.idx.to_numpy()[kernels.corners(xy)] if len(xy) else np.empty(0, int)
        return pd.DataFrame({id_: [key[0]], "solidity": [kernels.solidity(xy)], "merged": [kernels.has_deep_defect(xy)], "corners": [at.tolist()]})

    return points.select(id_, "idx", "x", "y").groupBy(id_).applyInPandas(run, f"{id_} long, solidity double, merged boolean, corners array<long>")


def dents(points: DataFrame, id_: str, share: float = 0.08) -> DataFrame:
    """id, solidity (area over that of the hull), dent (the deepest point below an edge of the hull that bridges it), merged
    (whether that is deeper than its share of the perimeter).

    Hulls are put together from partial ones; along the outline every point finds the hull's corners before and after it,
    round the end of the list as well, so no worker holds an outline.
    """
    corner = hull_corners(points, id_, "x", "y").withColumn("hull", F.lit(True))
    w = Window.partitionBy(id_).orderBy("idx")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.select(F.col(id_).cast("long").alias(id_), "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(corner, [id_, "x", "y"], "left")
    on = F.when(F.col("hull"), F.struct("x", "y"))
    p = p.withColumns({"a": F.coalesce(F.last(on, True).over(past), F.last(on, True).over(whole)), "b": F.coalesce(F.first(on, True).over(ahead), F.first(on, True).over(whole))})
    ex, ey, mx, my = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    n = F.sqrt(ex * ex + ey * ey)
    deep = F.when(n > 0, F.abs(ex * my - ey * mx) / F.when(n > 0, n)).otherwise(F.sqrt(mx * mx + my * my))
    dent = p.groupBy(id_).agg(F.max(F.when(F.col("hull").isNull(), deep)).alias("dent"))
    out = polygons(points, id_).join(hulls(points, id_, "x", "y"), id_).join(dent, id_)
    depth = F.when(F.col("hull_area") > 0, F.coalesce("dent", F.lit(0.0))).otherwise(0.0)
    return out.select(id_, F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).otherwise(0.0).alias("solidity"), depth.alias("dent"), (depth > share * F.col("perimeter")).alias("merged"))


def analysed(sides: DataFrame, ids: list[str], n_in: int, n_out: int, flat: float) -> DataFrame:
    """ids, is_flat, peak, profile (n_out samples of the centred curve): centring, sampling and class of every side at
    once; a piece's ids but the last, which numbers its sides, say whose they are."""
    mid = centred(sides, ids)
    line = resampled(mid, ids, n_in, n_out).groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "k"))), lambda x: x["k"]).alias("profile"))
    return classified(sides, ids, flat).join(line, ids)
