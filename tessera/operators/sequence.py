"""Order of assembly: breadth first from an anchor.

Of several pieces on one place the one of the smallest id is met by its neighbours; the others are reached as anchors only.
A null confidence comes after all others, an unknown or null type after the interior ones; pieces without an id, a place or
a job are left out; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, materialize

PRIORITY = {"corner": 0, "edge": 1, "interior": 2}
STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))  # up, down, left, right


def _pieces(matches: DataFrame, job: str) -> DataFrame:
    cols = matches.select(job, "piece_id", "row", "col", "piece_type", "confidence")
    return cols.dropna(subset=[job, "piece_id", "row", "col"]).distinct()


def assembly_order(matches: DataFrame, job: str = "job_id") -> DataFrame:
    """job, piece_id, row, col, piece_type, confidence, level (null if not reached), step_num (from 1).

    The anchor is the piece at (0, 0), else the surest corner, else the surest piece.  From each piece in turn its
    unvisited neighbours join the queue by type (corners, edges, others), then confidence, then up, down, left, right.
    Pieces that are not reached follow by type, confidence and id.  A job is one puzzle and fits one worker.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("piece_id", kind="stable")
        rows = list(p.assign(confidence=p.confidence.fillna(-np.inf)).itertuples(index=False))
        at = {}
        for i, x in enumerate(rows):
            at.setdefault((x.row, x.col), i)
        rank = lambda i: (PRIORITY.get(rows[i].piece_type, len(PRIORITY)), -rows[i].confidence)
        level: dict[int, int] = {}
        order: list[int] = []
        if rows:
            surest = lambda ids: min(ids, key=lambda i: (-rows[i].confidence, rows[i].piece_id))
            corners = [i for i in range(len(rows)) if rows[i].piece_type == "corner"]
            start = at[0, 0] if (0, 0) in at else surest(corners or range(len(rows)))
            level[start], queue = 0, deque([start])
            while queue:
                i = queue.popleft()
                order.append(i)
                near = [at[z] for d in STEPS if (z := (rows[i].row + d[0], rows[i].col + d[1])) in at]
                for j in sorted((j for j in near if j not in level), key=rank):
                    level[j] = level[i] + 1
                    queue.append(j)
        order += sorted((i for i in range(len(rows)) if i not in level), key=lambda i: (*rank(i), rows[i].piece_id))
        out = p.iloc[order].copy()
        out["level"] = pd.array([level.get(i) for i in order], dtype="Int64")
        out["step_num"] = range(1, len(order) + 1)
        return out

    cols = _pieces(matches, job)
    return cols.groupBy(job).applyInPandas(run, f"{job} long, piece_id long, row long, col long, piece_type string, confidence double, level long, step_num long")


def frontier_order(matches: DataFrame, job: str = "job_id") -> DataFrame:
    """assembly_order() for puzzles of any size: a level of all puzzles at a time.

    The frontier meets the places next to it by an equi-join; what it meets and what is not in the last two levels is the
    next one (a neighbour's level differs by one at most).  A piece follows its first parent: its place in the level is by
    (parent's place, type, confidence, direction), counted among the frontier alone, which has the length of a border.
    There are as many rounds as levels, each cut by a table.
    """
    with Scratch(matches.sparkSession) as scratch:
        kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("piece_type")), F.lit(0))
        sure = F.coalesce(F.col("confidence"), F.lit(float("-inf")))
        p = _pieces(matches, job).withColumns({"kind": F.when(kind == 0, len(PRIORITY) + 1).otherwise(kind), "unsure": -sure})
        first = Window.partitionBy(job, "row", "col").orderBy("piece_id")
        p = scratch.table(p.withColumn("seat", F.row_number().over(first)), "pieces")
        seats = p.filter("seat = 1")
        home = ~((F.col("row") == 0) & (F.col("col") == 0) & (F.col("seat") == 1))
        anchor = p.groupBy(job).agg(F.min(F.struct(home.alias("h"), F.when(home, F.col("kind") != 1).alias("c"), F.when(home, F.col("unsure")).alias("u"), "piece_id", "row", "col")).alias("a"))
        one = F.lit(1).cast("long")
        frontier = scratch.table(anchor.select(job, "a.piece_id", "a.row", "a.col", F.lit(0).cast("long").alias("level"), one.alias("place")), "level")
        levels, before = [frontier], None
        while frontier.limit(1).count():
            way = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(STEPS)])).alias("w")
            asked = frontier.select(job, F.col("place").alias("parent"), "row", "col", "level", way).select(job, "parent", "w.way", (F.col("row") + F.col("w.a")).alias("row"), (F.col("col") + F.col("w.b")).alias("col"), (F.col("level") + 1).alias("level"))
            met = seats.join(asked, [job, "row", "col"]).groupBy(job, "piece_id", "row", "col", "kind", "unsure", "level").agg(F.min(F.struct("parent", "way")).alias("x"))
            for old in (frontier, before):
                met = met if old is None else met.join(old.select(job, "piece_id"), [job, "piece_id"], "left_anti")
            place = F.row_number().over(Window.partitionBy(job).orderBy("x.parent", "kind", "unsure", "x.way")).cast("long")
            before, frontier = frontier, scratch.table(met.select(job, "piece_id", "row", "col", "level", place.alias("place")), "level")
            levels.append(frontier)
        reached = levels[0]
        for x in levels[1:-1]:
            reached = reached.unionByName(x)
        reached = reached.select(job, "piece_id", "level", "place")
        size = reached.groupBy(job, "level").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy(job).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        at = reached.join(size.withColumn("done", F.coalesce(F.sum("n").over(earlier), F.lit(0))), [job, "level"]).select(job, "piece_id", "level", (F.col("done") + F.col("place")).alias("step_num"))
        rest = p.join(reached, [job, "piece_id"], "left_anti").join(size.groupBy(job).agg(F.sum("n").alias("done")), job)
        last = F.row_number().over(Window.partitionBy(job).orderBy("kind", "unsure", "piece_id"))
        rest = rest.select(job, "piece_id", F.lit(None).cast("long").alias("level"), (F.col("done") + last).alias("step_num"))
        out = p.join(at.unionByName(rest), [job, "piece_id"])
        return materialize(out.select(job, "piece_id", "row", "col", "piece_type", "confidence", "level", F.col("step_num").cast("long").alias("step_num")), "order")
