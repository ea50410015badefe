"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows start in virtual partitions (a hash of the row).  How many rows each partition sends to each shard is drawn from
the multivariate hypergeometric law, so rows and columns of the matrix add up to the partitions' and shards' sizes;
every partition is permuted and cut by its row of the matrix, and after the exchange every shard is permuted again.
All of it is DataFrame operations; the driver draws the matrix, whose size (partitions times shards) is a parameter.

Law `rows`: counts of any two shards differ by one at most.  Cases: an empty table gives no rows; null ids and texts,
equal texts and repeated rows are placed like any other row (equal rows are interchangeable); extra columns stay, but
for names that end in an underscore, which are reserved.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ordering import parts_of, positions


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls are good.  Inversion that goes outwards from the mode, so it takes about as many steps
    as there are standard deviations in its range, whatever the population."""
    lo, hi = max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    top = math.exp(_log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn))
    u = rng.random() - top
    if u <= 0:
        return mode
    left = right = mode
    p_left = p_right = top
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-18 and p_right < 1e-18:
            break
    return mode


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each partition sends to each shard; shard sizes are equal but for one row."""
    rng = random.Random(seed)
    total = sum(sizes)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in sizes:
        row, left, others = [], n, sum(room)
        for j in range(shards):
            others -= room[j]
            x = hypergeometric(rng, room[j], others, left)
            row.append(x)
            left -= x
        room = [r - x for r, x in zip(room, row, strict=True)]
        out.append(row)
    return out


def shard(rows: DataFrame, key: list[Column], shards: int = 16, partitions: int = 128, seed: int = 1) -> DataFrame:
    """rows with `shard` (from 0) and `slot` (gapless from 0 in each shard); key: what tells rows apart."""
    h = [F.xxhash64(F.lit(f"{seed}-{k}"), *key) for k in range(3)]
    local = rows.withColumns({"partition_": F.pmod(h[0], F.lit(partitions)).cast("int"), "first_": h[1], "second_": h[2]})
    counted = local.groupBy("partition_").agg(F.count("*").alias("n")).orderBy("partition_").collect()  # partitions rows
    sent = matrix([r["n"] for r in counted], shards, seed)
    cuts = []
    for r, row in zip(counted, sent, strict=True):
        ends, total = [], 0
        for x in row:
            total += x
            ends.append(total)
        cuts.append({"partition_": r["partition_"], "rows_": r["n"], "ends_": ends})
    spec = "array<struct<partition_:int,rows_:bigint,ends_:array<bigint>>>"
    table = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(cuts)), spec)).alias("x")).select("x.*")
    placed = positions(local.join(F.broadcast(table), "partition_"), ["partition_"], parts_of(F.col("rows_")), "first_", ["second_"], out="rank_")
    placed = placed.withColumn("shard", F.size(F.filter("ends_", lambda e: e <= F.col("rank_"))).cast("int")).drop("ends_", "rows_", "rank_", "partition_")
    each = parts_of(F.lit(sum(r["n"] for r in counted) / shards))
    return positions(placed, ["shard"], each, "second_", ["first_"], out="slot").drop("first_", "second_")
