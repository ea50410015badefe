"""Costs, optimal assignment and confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPATIAL, FLAT = 0.70, 0.30


def composite(fine: Column, flat: Column) -> Column:
    return SPATIAL * fine + FLAT * flat


def least_costs(candidates: DataFrame) -> DataFrame:
    """piece_id, row, col, composite -> the least cost over rotations; costs of 1 and more are left to the default."""
    cost = candidates.groupBy("piece_id", "row", "col").agg(F.min(1 - F.col("composite")).alias("cost"))
    return cost.withColumn("cost", F.least("cost", F.lit(1.0)))


def best_rotations(candidates: DataFrame) -> DataFrame:
    """One row a piece and cell: the rotation of the largest composite, the smallest of equals."""
    top = candidates.groupBy("piece_id", "row", "col").agg(F.max(F.struct("composite", (-F.col("rot")).alias("r"), "fine", "flat")).alias("x"))
    return top.select("piece_id", "row", "col", (-F.col("x.r")).alias("rot"), F.col("x.fine").alias("fine"), F.col("x.flat").alias("flat"), F.col("x.composite").alias("composite"))


def top_cells(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The k best cells of each piece, each with its best rotation: rk from 1."""
    order = Window.partitionBy("piece_id").orderBy(F.desc("composite"), "row", "col")
    return best_rotations(candidates).withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest one-to-one assignment of min(n, m) pairs: shortest augmenting paths with dual
    prices, one row at a time, every step over all columns at once."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    price_row, price_col = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, so_far, seen = start, 0.0, []
        while True:
            reach = so_far + c[row] - price_row[row] - price_col
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], row
            j = int(np.argmin(np.where(done, np.inf, dist)))
            so_far, done[j] = dist[j], True
            if row_of[j] < 0:
                break
            row = row_of[j]
            seen.append(row)
        price_row[start] += so_far
        for r in seen:
            price_row[r] += so_far - dist[col_of[r]]
        price_col[done] -= so_far - dist[done]
        while True:
            r = via[j]
            row_of[j] = r
            col_of[r], j = j, col_of[r]
            if r == start:
                break
    rows = np.arange(n)
    return (col_of, rows) if flip else (rows, col_of)


def assign(costs: DataFrame, cells: DataFrame, pieces: DataFrame, job: str = "job_id") -> DataFrame:
    """job, piece_id, row, col, confidence (1 - cost) of each job's cheapest one-to-one assignment.

    costs are sparse: a pair without a row costs 1.  A job is one puzzle (some 2,000 pieces at most), so its dense
    matrix fits one worker; jobs run in parallel.  Surplus pieces or cells stay out.
    """

    def run(key: tuple, cost: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["kind", "a", "b"])
        grid, ids = cell[cell.kind == 0], cell[cell.kind == 1].a.to_numpy()
        at = {x: i for i, x in enumerate(zip(grid.a, grid.b, strict=True))}
        who = {x: i for i, x in enumerate(ids)}
        m = np.ones((len(ids), len(grid)))
        for p, r, c, x in zip(cost.piece_id, cost.row, cost.col, cost.cost, strict=True):
            if p in who and (r, c) in at:
                m[who[p], at[r, c]] = min(m[who[p], at[r, c]], x)
        i, j = solve(m) if m.size else (np.empty(0, int), np.empty(0, int))
        a, b = grid.a.to_numpy()[j], grid.b.to_numpy()[j]
        return pd.DataFrame({job: [key[0]] * len(i), "piece_id": ids[i], "row": a, "col": b, "confidence": 1 - m[i, j]})

    # The job under a new name, since costs may come from the same tables.
    frame = cells.select(F.col(job).alias("job_"), F.lit(0).alias("kind"), F.col("row").alias("a"), F.col("col").alias("b"))
    frame = frame.unionByName(pieces.select(F.col(job).alias("job_"), F.lit(1).alias("kind"), F.col("piece_id").alias("a"), F.lit(0).cast("long").alias("b")))
    both = costs.select(job, "piece_id", "row", "col", "cost").groupBy(job).cogroup(frame.groupBy("job_"))
    return both.applyInPandas(run, f"{job} long, piece_id long, row long, col long, confidence double")


def stats(matches: DataFrame) -> DataFrame:
    """One row of confidence statistics; zeros for an empty table."""
    c = F.col("confidence")
    n = F.count("*")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    flagged = F.coalesce(F.sum(F.col("flagged").cast("long")), F.lit(0))
    return matches.agg(
        zero(F.avg(c)).alias("mean"), zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"), zero(F.stddev_pop(c)).alias("std_pop"),
        flagged.alias("flagged_count"), F.when(n > 0, flagged / n).otherwise(0.0).alias("flagged_fraction"),
    )
