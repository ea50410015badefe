"""Steps, manifests, labels, addresses and draw commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import band


def summary(steps: DataFrame) -> DataFrame:
    """One row: total, flagged, mean, min, max (four places), corners, edges, interior."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    r4 = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    kind = F.col("piece_type")
    return steps.agg(
        F.count("*").alias("total"), n(F.col("flagged")).alias("flagged"), r4(F.avg("confidence")).alias("mean"), r4(F.min("confidence")).alias("min"), r4(F.max("confidence")).alias("max"),
        n(kind == "corner").alias("corners"), n(kind == "edge").alias("edges"), n(kind == "interior").alias("interior"),
    )


def to_json(steps: DataFrame) -> DataFrame:
    """One JSON line a step, so that a manifest is written by many tasks and read by many."""
    return steps.select(F.to_json(F.struct(*steps.columns)).alias("value"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def labels(steps: DataFrame) -> DataFrame:
    text = F.format_string("Step %d (%d,%d) R%d %s conf:%.2f", "step_num", "row", "col", "rot", "piece_type", F.round("confidence", 2))
    return steps.select("step_num", text.alias("label"))


def addresses(steps: DataFrame, job: str) -> DataFrame:
    card, crop = f"/assets/{job}/step_cards/step_%04d.jpg", f"/assets/{job}/pieces/piece_%04d.jpg"
    return steps.select("step_num", F.format_string(card, "step_num").alias("card_url"), F.format_string(crop, "piece_id").alias("crop_url"))


def draw_commands(steps: DataFrame, grid: DataFrame, height: int, width: int, radius: int = 6) -> DataFrame:
    """kind, x0, y0, x1, y1, text, colour of an overlay: grid lines, a dot coloured by confidence and the step's number
    for each placed piece."""
    i = lambda c: F.floor(c).cast("long")
    none = F.lit(None).cast("string")
    lines = []
    for n, size, flat in (("n_rows", height, True), ("n_cols", width, False)):
        at = i(F.col("k") * (F.lit(float(size)) / F.col(n)))
        ends = (F.lit(0), at, F.lit(width), at) if flat else (at, F.lit(0), at, F.lit(height))
        row = grid.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n))))
        lines.append(row.select(F.lit("line").alias("kind"), *[e.cast("long").alias(x) for e, x in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)], none.alias("text"), F.lit("grid").alias("colour")))
    s = steps.select("step_num", "row", "col", "confidence").join(F.broadcast(grid)).withColumns({"ch": F.lit(float(height)) / F.col("n_rows"), "cw": F.lit(float(width)) / F.col("n_cols")})
    x, y = i((F.col("col") + 1) * F.col("cw")) - radius - 3, i(F.col("row") * F.col("ch")) + radius + 3
    colour = F.when(band(F.col("confidence")) == "high", "green").when(band(F.col("confidence")) == "medium", "yellow").otherwise("red")
    dots = s.select(F.lit("dot").alias("kind"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), none.alias("text"), colour.alias("colour"))
    cx, cy = i(F.col("col") * F.col("cw") + F.col("cw") / 2), i(F.col("row") * F.col("ch") + F.col("ch") / 2)
    text = s.select(F.lit("text").alias("kind"), cx.alias("x0"), cy.alias("y0"), cx.alias("x1"), cy.alias("y1"), F.col("step_num").cast("string").alias("text"), F.lit("white").alias("colour"))
    return lines[0].unionByName(lines[1]).unionByName(dots).unionByName(text)
