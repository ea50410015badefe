"""Grid algebra: places, neighbours, shapes, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import expected_flats, piece_type


def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols inferred from the largest row and col; an empty grid is 1 x 1."""
    return df.agg((F.coalesce(F.max("row"), F.lit(0)) + 1).cast("long").alias("n_rows"), (F.coalesce(F.max("col"), F.lit(0)) + 1).cast("long").alias("n_cols"))


def classified(df: DataFrame, grid: DataFrame) -> DataFrame:
    """df (row, col) with piece_type and expected flat sides; grid is the one-row shape."""
    kind = piece_type(F.col("row"), F.col("col"), F.col("n_rows"), F.col("n_cols"))
    return df.join(F.broadcast(grid)).withColumn("piece_type", kind).withColumn("expected", expected_flats(F.col("piece_type")))


def flat_score(expected: Column, actual: Column) -> Column:
    """1 where the flat sides are as expected, half a point less for each that is not, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - 0.5 * F.abs(expected - actual))


def neighbour_pairs(matches: DataFrame) -> DataFrame:
    """a, b, side_a, side_b of assigned pieces next to each other; sides: 0 top, 1 right, 2 bottom, 3 left.

    Two equi-joins on a shifted place, one to the right (1, 3) and one down (2, 0).
    """
    a = matches.select(F.col("piece_id").alias("a"), "row", "col")
    b = matches.select(F.col("piece_id").alias("b"), "row", "col")
    right = a.join(b.withColumn("col", F.col("col") - 1), ["row", "col"]).select("a", "b", F.lit(1).cast("long").alias("side_a"), F.lit(3).cast("long").alias("side_b"))
    down = a.join(b.withColumn("row", F.col("row") - 1), ["row", "col"]).select("a", "b", F.lit(2).cast("long").alias("side_a"), F.lit(0).cast("long").alias("side_b"))
    return right.unionByName(down)


def ends(pairs: DataFrame) -> DataFrame:
    """Both ends of each pair: piece_id, other and the pair's other columns."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    one = pairs.select(F.col("a").alias("piece_id"), F.col("b").alias("other"), *rest)
    return one.unionByName(pairs.select(F.col("b").alias("piece_id"), F.col("a").alias("other"), *rest))


def best_shapes(counts: DataFrame, aspect: float, radius: int = 5, least: int = 2, most: int = 100) -> DataFrame:
    """key, piece_count (positive) -> key, rows, cols, diff_pct: the grid within `radius` of the ideal one whose number
    of cells is closest to the count; then the one closest in aspect, then the rounded ideal, then the first in row order.
    """
    cols, rows = F.sqrt(F.col("piece_count") * aspect), F.col("piece_count") / F.sqrt(F.col("piece_count") * aspect)
    ideal = counts.filter("piece_count > 0").withColumns({"cf": cols, "rf": rows})

    def span(x: str) -> Column:
        lo, hi = F.greatest(F.lit(least), F.floor(x) - radius), F.least(F.lit(most), F.floor(x) + radius)
        return F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    tried = ideal.withColumn("r", F.explode(span("rf"))).withColumn("c", F.explode(span("cf"))).withColumn("seq", F.lit(1))
    rounded = ideal.withColumns({"r": F.bround("rf").cast("long"), "c": F.bround("cf").cast("long"), "seq": F.lit(0)})
    all_of = tried.unionByName(rounded).withColumn("diff", F.abs(F.col("r") * F.col("c") - F.col("piece_count")))
    off = F.abs(F.when(F.col("r") > 0, F.col("c") / F.col("r")).otherwise(0.0) - F.col("cf") / F.col("rf"))
    best = all_of.groupBy("key", "piece_count").agg(F.min(F.struct("diff", off.alias("off"), "seq", "r", "c")).alias("x"))
    return best.select("key", "piece_count", F.col("x.r").alias("rows"), F.col("x.c").alias("cols"), (F.col("x.diff") / F.col("piece_count") * 100).alias("diff_pct"))


def override_check(overrides: DataFrame, tolerance: float = 15.0, least: int = 2, most: int = 100) -> DataFrame:
    """rows, cols, piece_count -> with status (ok, out_of_range, high_deviation) and diff_pct."""
    diff = F.abs(F.col("rows") * F.col("cols") - F.col("piece_count")) / F.col("piece_count") * 100
    inside = F.col("rows").between(least, most) & F.col("cols").between(least, most)
    return overrides.withColumn("diff_pct", diff).withColumn("status", F.when(~inside, "out_of_range").when(F.col("diff_pct") > tolerance, "high_deviation").otherwise("ok"))


def pixel_map(df: DataFrame, height: int, width: int) -> DataFrame:
    """row, col, n_rows, n_cols -> x, y of the cell's corner, and the cell that this pixel falls into, kept in the grid."""
    pw, ph = F.lit(float(width)) / F.col("n_cols"), F.lit(float(height)) / F.col("n_rows")
    out = df.withColumns({"x": F.floor(F.col("col") * pw).cast("long"), "y": F.floor(F.col("row") * ph).cast("long")})
    back = lambda v, size, n: F.greatest(F.lit(0), F.least(F.floor(F.col(v) / size), F.col(n) - 1)).cast("long")
    return out.withColumns({"back_row": back("y", ph, "n_rows"), "back_col": back("x", pw, "n_cols")})


def rotated(df: DataFrame) -> DataFrame:
    """Places of a grid turned by deg, counter-clockwise in steps of 90: k, row2, col2; needs n_rows, n_cols."""
    k = F.pmod(F.floor(F.col("deg") / 90), F.lit(4)).cast("long")
    row, col, last_r, last_c = F.col("row"), F.col("col"), F.col("n_rows") - 1, F.col("n_cols") - 1
    r2 = F.when(k == 0, row).when(k == 1, last_c - col).when(k == 2, last_r - row).otherwise(col)
    c2 = F.when(k == 0, col).when(k == 1, row).when(k == 2, last_c - col).otherwise(last_r - row)
    return df.withColumns({"k": k, "row2": r2, "col2": c2})


def clamped_boxes(boxes: DataFrame, width: int, height: int, pad: int) -> DataFrame:
    """x, y, w, h -> the padded box within the image (x1, y1, x2, y2), its area, and the box's aspect (0 for no height)."""
    edge = {
        "x1": F.greatest(F.lit(0), F.col("x") - pad), "y1": F.greatest(F.lit(0), F.col("y") - pad),
        "x2": F.least(F.lit(width), F.col("x") + F.col("w") + pad), "y2": F.least(F.lit(height), F.col("y") + F.col("h") + pad),
    }
    out = boxes.withColumns(edge)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return out.withColumn("area", area).withColumn("aspect", aspect(F.col("w"), F.col("h")))


def aspect(w: Column, h: Column) -> Column:
    return F.when(h > 0, w / h).otherwise(0.0)


def overridden(matches: DataFrame, corrections: DataFrame) -> DataFrame:
    """matches with corrected places; conflict marks places that more than one piece then holds."""
    from pyspark.sql import Window

    new = corrections.select("piece_id", F.col("row").alias("r_"), F.col("col").alias("c_"))
    out = matches.join(new, "piece_id", "left").withColumns({"row": F.coalesce("r_", "row"), "col": F.coalesce("c_", "col")}).drop("r_", "c_")
    return out.withColumn("conflict", F.count("*").over(Window.partitionBy("row", "col")) > 1)
