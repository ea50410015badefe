"""Positions in a hashed order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of a hashed order holds on average.
ROWS = 400


def unit(h: Column) -> Column:
    """A 64-bit hash as a fraction in [0, 1) that rises with it."""
    return (F.shiftright(h, 11).cast("double") + 2.0**52) / 2.0**53


def parts_of(rows: Column) -> Column:
    """Into how many parts the hash range of a group of so many rows is cut."""
    return F.greatest(F.lit(1), F.ceil(rows / ROWS)).cast("long")


def positions(df: DataFrame, group: list[str], parts: Column, order: str, ties: list[str], amount: Column | None = None, out: str = "position") -> DataFrame:
    """Adds to each row the sum of `amount` (default: 1) over the rows of its group that come before it in the order of
    the bigint hash column `order`, then of `ties`; rows equal in all of these are interchangeable.

    A group's hash range is cut into equal `parts` (parts_of the group's size, which the caller knows); their sums are
    added up per group, and within a part a window does the rest.  So a group with a third of all rows spreads over as
    many tasks as its size asks for, and rows are shuffled once, by group and part.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    split = df.withColumn("amount_", amount).withColumn("part_", F.floor(unit(F.col(order)) * parts).cast("long"))
    split = split.repartition(*group, "part_")
    sums = split.groupBy(*group, "part_").agg(F.sum("amount_").alias("sum_"))
    before = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_", F.coalesce(F.sum("sum_").over(before), F.lit(0))).drop("sum_")
    within = Window.partitionBy(*group, "part_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    split = split.join(sums, [*group, "part_"]).withColumn(out, F.col("before_") + F.coalesce(F.sum("amount_").over(within), F.lit(0)))
    return split.drop("part_", "before_", "amount_")
