"""Draw commands to pixels: lines, discs and numbers, composed in the order of the commands.

Every command sends the places that it covers; of several at a place the last command's colour stays, a combinable maximum,
so a canvas is no group and no image has to fit a worker.  Commands: kind (line, dot, text), x0, y0, x1, y1, text, colour.
Lines lie over the ground, dots over lines, text over dots; within a kind, commands come in the order of their places.
Places outside of the canvas, commands with a null place and kinds or characters that are not known draw nothing; repeated
commands draw once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The strokes of a digit, named as on a display of seven segments: a top, b and c right, d bottom, e and f
#: left, g middle.
DIGITS = {"0": "abcdef", "1": "bc", "2": "abged", "3": "abgcd", "4": "fgbc", "5": "afgcd", "6": "afgedc", "7": "abc", "8": "abcdefg", "9": "abcdfg", "-": "g"}
#: Ends of a stroke in halves of a digit's width and height: x0, y0, x1, y1.
STROKES = {"a": (0, 0, 2, 0), "b": (2, 0, 2, 1), "c": (2, 1, 2, 2), "d": (0, 2, 2, 2), "e": (0, 1, 0, 2), "f": (0, 0, 0, 1), "g": (0, 1, 2, 1)}
KINDS = ("line", "dot", "text")


def strokes(text: DataFrame, width: int = 4, height: int = 8, gap: int = 2) -> DataFrame:
    """x0, y0, x1, y1, z, colour of the strokes of texts; a text begins at its command's place."""
    known = F.create_map(*[F.lit(v) for c, lines in DIGITS.items() for v in (c, lines)])
    at = text.select("x0", "y0", "z", "colour", F.posexplode(F.split("text", "")).alias("k", "ch")).withColumn("lines", known[F.col("ch")]).filter("lines IS NOT NULL")
    ends = F.create_map(*[x for c, e in STROKES.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in e]))])
    at = at.select("x0", "y0", "z", "colour", "k", F.explode(F.split("lines", "")).alias("s")).withColumn("e", ends[F.col("s")])
    x = lambda i: F.col("x0") + F.col("k") * (width + gap) + F.col("e")[i] * (width // 2)
    y = lambda i: F.col("y0") + F.col("e")[i] * (height // 2)
    return at.select(x(0).alias("x0"), y(1).alias("y0"), x(2).alias("x1"), y(3).alias("y1"), "z", "colour")


def lines(ends: DataFrame) -> DataFrame:
    """row, col, z, colour of straight lines: a place for each step along the longer direction, the nearest one across."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    at = ends.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), "n")))
    step = lambda a, d: F.when(F.col("n") == 0, F.col(a)).otherwise(F.col(a) + F.floor((2 * d * F.col("t") + F.col("n")) / (2 * F.col("n"))))
    return at.select(step("y0", dy).cast("long").alias("row"), step("x0", dx).cast("long").alias("col"), "z", "colour")


def discs(dots: DataFrame, radius: int) -> DataFrame:
    """row, col, z, colour of the places within `radius` of each dot."""
    near = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    at = dots.withColumn("o", F.explode(F.array(*near)))
    return at.select((F.col("y0") + F.col("o.a")).alias("row"), (F.col("x0") + F.col("o.b")).alias("col"), "z", "colour")


def drawn(commands: DataFrame, height: int, width: int, radius: int = 6) -> DataFrame:
    """row, col, colour of every place that a command covers on a canvas of height by width."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("kind")
    z = F.struct(kind, "y0", "x0", "y1", "x1", F.coalesce("text", F.lit("")).alias("text"), "colour")
    c = commands.filter("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").withColumn("z", z)
    straight = c.filter("kind = 'line'").select("x0", "y0", "x1", "y1", "z", "colour").unionByName(strokes(c.filter("kind = 'text'")))
    every = lines(straight).unionByName(discs(c.filter("kind = 'dot'"), radius))
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return every.filter(inside).groupBy("row", "col").agg(F.max_by("colour", "z").alias("colour"))


def painted(pixels: DataFrame, ground: DataFrame, colours: dict[str, tuple[int, int, int]]) -> DataFrame:
    """path, y, x, c, v: an image (path, y, x, c, v) with drawn places (path, row, col, colour) laid over it."""
    level: Column = F.create_map(*[x for k, rgb in colours.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in rgb]))])
    over = pixels.select("path", F.col("row").alias("y"), F.col("col").alias("x"), level[F.col("colour")].alias("rgb"))
    return ground.join(over, ["path", "y", "x"], "left").select("path", "y", "x", "c", F.coalesce(F.get("rgb", F.col("c")), F.col("v")).alias("v"))
