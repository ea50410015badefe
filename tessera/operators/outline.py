"""Outlines of regions by list ranking: pixel tables in, ordered border points out.

The border of a region runs along the sides of its pixels, with the region on the right; where two pixels touch at a
corner only, it goes round both (8-connected).  Every side knows its successor from the pixel's eight neighbours, so the
border is a table of links, and places along it come from pointer doubling: a logarithmic number of equi-joins, whatever
the length of an outline, and no group of one outline.  Areas and lengths are sums over links and need no order.

Repeated pixels count once; pixels with a null place or component are left out; regions that touch keep their own outlines;
empty tables give no rows.  Rows and columns are at least 0 and below 2^28.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.session import Scratch, materialize

WIDTH = 1 << 28
#: Bits of the neighbours, clockwise from the one above, then the pixel itself.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (0, 0))
#: Side (0 top, 1 right, 2 bottom, 3 left): the neighbour beyond it, the one ahead to the left and the one ahead.
SIDES = ((0, 1, 2), (2, 3, 4), (4, 5, 6), (6, 7, 0))
#: Where a side begins.
CORNER = ((0, 0), (0, 1), (1, 1), (1, 0))


def sides(mask: DataFrame) -> DataFrame:
    """e, nxt, component, row, col, side of every pixel's side on a border; mask: row, col, component.

    Every pixel tells its neighbours that it is there, one combinable aggregation; the rest is arithmetic.
    """
    told = F.array(*[F.struct(F.lit(-r).alias("r"), F.lit(-c).alias("c"), F.lit(1 << i).alias("bit")) for i, (r, c) in enumerate(AROUND)])
    at = mask.filter("row IS NOT NULL AND col IS NOT NULL AND component IS NOT NULL").select("component", "row", "col", F.explode(told).alias("t"))
    seen = at.groupBy("component", (F.col("row") + F.col("t.r")).alias("row"), (F.col("col") + F.col("t.c")).alias("col")).agg(F.bit_or("t.bit").alias("bits"))
    seen = seen.filter(F.col("bits").bitwiseAND(1 << 8) != 0)

    def there(i: int) -> Column:
        return F.col("bits").bitwiseAND(1 << i) != 0

    def name(i: int, side: int) -> Column:
        r, c = AROUND[i]
        return ((F.col("row") + r) * WIDTH + F.col("col") + c) * 4 + side

    every = [F.when(~there(beyond), F.struct(F.lit(s).cast("long").alias("side"), name(8, s).alias("e"), F.when(there(left), name(left, (s + 3) % 4)).when(there(ahead), name(ahead, s)).otherwise(name(8, (s + 1) % 4)).alias("nxt"))) for s, (beyond, left, ahead) in enumerate(SIDES)]
    return seen.select("component", "row", "col", F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("s")).select("s.e", "s.nxt", "component", "row", "col", "s.side")


def ranked(links: DataFrame) -> DataFrame:
    """e, loop (its least e), idx (steps from there), n: places along closed lists; links: e, nxt, every e once.

    A link knows the least name within its next 2^k steps and how far off that is; joined with the link 2^k steps on, it
    knows 2^(k+1).  When no link learns of a smaller name any more, each window holds its loop's least one.
    """
    with Scratch(links.sparkSession) as scratch:
        s = scratch.table(links.select("e", F.col("nxt").alias("to"), F.col("e").alias("least"), F.lit(0).cast("long").alias("off")), "links")
        step, news = 1, True
        while news:
            on = s.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("least").alias("other"), (F.col("off") + step).alias("there"))
            less = F.col("other") < F.col("least")
            new = s.join(on, "to").select("e", F.col("far").alias("to"), F.least("least", "other").alias("least"), F.when(less, F.col("there")).otherwise(F.col("off")).alias("off"), less.alias("news"))
            last, s = s, scratch.table(new, "links")
            scratch.drop(last)
            news, step = bool(s.filter("news").limit(1).count()), 2 * step
        n = s.groupBy(F.col("least").alias("loop")).agg(F.count("*").alias("n"))
        at = s.select("e", F.col("least").alias("loop"), "off").join(n, "loop")
        return materialize(at.select("e", "loop", F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("idx"), "n"), "ranked")


def _placed(borders: DataFrame) -> DataFrame:
    """borders with the corner where a side begins and the way to the next side's pixel."""
    corner = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CORNER]), F.col("side").cast("int") + 1)
    to = F.floor(F.col("nxt") / 4)
    return borders.withColumns({"y": F.col("row") + corner(0), "x": F.col("col") + corner(1), "row2": F.floor(to / WIDTH).cast("long"), "col2": F.pmod(to, F.lit(WIDTH)).cast("long")})


def outlines(mask: DataFrame) -> DataFrame:
    """component, loop, outer, idx, y, x, row, col: the corners of every border in order, clockwise round a region and
    the other way round a hole, with the pixel that the step runs along."""
    b = _placed(materialize(sides(mask), "sides"))
    at = b.join(ranked(b.select("e", "nxt")), "e")
    turn = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(-1), F.lit(0)), F.col("side").cast("int") + 1)
    area = at.groupBy("loop").agg(F.sum(-turn * F.col("y")).alias("area"))  # dx times y, over the horizontal sides
    return at.join(area, "loop").select("component", "loop", (F.col("area") > 0).alias("outer"), "idx", "y", "x", "row", "col")


def hull_corners(points: DataFrame, id_: str, x: str = "col", y: str = "row") -> DataFrame:
    """id, x, y of the corners of the convex hull of each id's points.

    A hull of hulls is the hull: every batch of rows sends only the corners of its own, so what meets is a few points a
    task however many an outline has.
    """
    schema = f"{id_} long, {x} double, {y} double"

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        h = kernels.convex_hull(p[[x, y]].to_numpy(float))
        return pd.DataFrame({id_: np.full(len(h), key), x: h[:, 0], y: h[:, 1]})

    def corners(batches):
        for p in batches:
            if len(p):
                yield pd.concat([of(key, q) for key, q in p.groupby(id_)])

    some = points.select(F.col(id_).cast("long").alias(id_), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna().distinct()
    return some.mapInPandas(corners, schema).groupBy(id_).applyInPandas(lambda key, p: of(key[0], p), schema)


def hulls(points: DataFrame, id_: str, x: str = "col", y: str = "row") -> DataFrame:
    """id, hull_area of the points of each id: the corners' polygon, in order of their angle around their mean."""
    c = hull_corners(points, id_, x, y)
    mean = c.groupBy(id_).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    at = c.join(mean, id_).select(id_, (F.col(x) - F.col("mx")).alias("u"), (F.col(y) - F.col("my")).alias("v"))
    ring = at.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct(F.atan2("v", "u").alias("t"), "u", "v"))).alias("p"))
    nxt = lambda i: F.element_at("p", (i + 1) % F.size("p") + 1)
    parts = F.transform("p", lambda a, i: a["u"] * nxt(i)["v"] - nxt(i)["u"] * a["v"])
    area = F.aggregate(parts, F.lit(0.0), lambda s, z: s + z) / 2
    return ring.select(id_, F.when(F.size("p") > 2, F.abs(area)).otherwise(0.0).alias("hull_area"))


def described(mask: DataFrame) -> DataFrame:
    """component, pixels, holes, area, perimeter, compactness, solidity of each region.

    area and perimeter are those of the polygon through the centres of the outermost border's pixels; of several such
    borders the one of the largest area counts.
    """
    b = _placed(materialize(sides(mask), "sides"))
    at = b.join(ranked(b.select("e", "nxt")), "e")
    dr, dc = F.col("row2") - F.col("row"), F.col("col2") - F.col("col")
    turn = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(-1), F.lit(0)), F.col("side").cast("int") + 1)
    loops = at.groupBy("component", "loop").agg(F.sum(-turn * F.col("y")).alias("crack"), (F.sum(F.col("col") * F.col("row2") - F.col("col2") * F.col("row")) / 2).alias("area"), F.sum(F.sqrt((dr * dr + dc * dc).cast("double"))).alias("perimeter"))
    outer = loops.filter("crack > 0").groupBy("component").agg(F.max(F.struct(F.abs("area").alias("area"), (-F.col("loop")).alias("l"), "perimeter")).alias("o"))
    holes = loops.groupBy("component").agg(F.count(F.when(F.col("crack") < 0, 1)).alias("holes"))
    size = mask.filter("row IS NOT NULL AND col IS NOT NULL").select("component", "row", "col").distinct().groupBy("component").agg(F.count("*").alias("pixels"))
    out = outer.select("component", F.col("o.area").alias("area"), F.col("o.perimeter").alias("perimeter")).join(holes, "component").join(size, "component").join(hulls(b, "component"), "component", "left")
    compact = F.when(F.col("perimeter") > 0, 4 * F.pi() * F.col("area") / F.col("perimeter") / F.col("perimeter")).otherwise(0.0)
    return out.select("component", "pixels", "holes", "area", "perimeter", compact.alias("compactness"), F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).otherwise(0.0).alias("solidity"))


def crops(raster: DataFrame, mask: DataFrame, boxes: DataFrame) -> DataFrame:
    """piece_id, y, x, v, alpha: the pixels in each piece's padded box (piece_id, component, y0, x0, y1, x1; ends excluded),
    from the box's corner on; alpha is 255 on the piece.  A box asks for its places, an equi-join; other pieces' pixels in
    the box are background."""
    rows = boxes.select("piece_id", "component", "y0", "x0", "x1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("row"))
    asked = rows.select("piece_id", "component", "y0", "x0", "row", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("col"))
    on = mask.select("component", "row", "col", F.lit(255).cast("long").alias("alpha")).distinct()
    got = asked.join(raster.select("row", "col", "v"), ["row", "col"]).join(on, ["component", "row", "col"], "left")
    return got.select("piece_id", (F.col("row") - F.col("y0")).alias("y"), (F.col("col") - F.col("x0")).alias("x"), "v", F.coalesce("alpha", F.lit(0).cast("long")).alias("alpha"))
