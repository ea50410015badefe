"""Scores of neighbouring pieces and the local search over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import ends

HIST, CURV, NEUTRAL = 0.6, 0.4, 0.5


def combined(hist: Column, curv: Column) -> Column:
    """A missing score counts as neutral."""
    return HIST * F.coalesce(hist, F.lit(NEUTRAL)) + CURV * F.coalesce(curv, F.lit(NEUTRAL))


def complement(flat_a: Column, flat_b: Column, n: Column, cov: Column, std_a: Column, std_b: Column) -> Column:
    """How well two sides fit: 1 for two flat ones, a quarter for one, neutral if something is missing; else the
    correlation of one with the other's negative, on [0, 1]."""
    rho = F.when((std_a < 1e-8) | (std_b < 1e-8), 0.0).otherwise(-cov / (std_a * std_b))
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rho + 1) / 2))
    missing = flat_a.isNull() | flat_b.isNull() | (F.coalesce(n, F.lit(0)) == 0)
    return F.when(missing, NEUTRAL).when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.25).otherwise(fit)


def attached(pieces: DataFrame, scored: DataFrame) -> DataFrame:
    """piece_id with the means of its pairs' scores: adjacency (hist), curv and neighbourhood (combined); pieces without
    neighbours get 0.5, 0.5 and 1."""
    mean = ends(scored).groupBy("piece_id").agg(F.avg("hist").alias("h"), F.avg("curv").alias("c"), F.avg("combined").alias("m"))
    out = pieces.select("piece_id").join(mean, "piece_id", "left")
    return out.select("piece_id", F.coalesce("h", F.lit(0.5)).alias("adjacency"), F.coalesce("c", F.lit(0.5)).alias("curv"), F.coalesce("m", F.lit(1.0)).alias("neighborhood"))


def facing(sides: np.ndarray, flat: float = 0.1, bins: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Combined scores of any two pieces side by side [left, right] and one above the other [upper, lower], from their
    side profiles [piece, side, sample] of values in [-1, 1]; sides: 0 top, 1 right, 2 bottom, 3 left."""
    n, _, m = sides.shape
    level = np.clip(np.floor((sides + 1) * bins / 2), 0, bins).astype(int)
    share = (level[..., None] == np.arange(bins + 1)).mean(axis=2)
    is_flat, x, std = np.abs(sides).mean(axis=2) < flat, sides - sides.mean(axis=2, keepdims=True), sides.std(axis=2)

    def score(a: int, b: int) -> np.ndarray:
        hist = np.array([np.minimum(share[i, a], share[:, b]).sum(axis=1) for i in range(n)]).reshape(n, n)
        spread = std[:, a, None] * std[None, :, b]
        flatless = (std[:, a, None] < 1e-8) | (std[None, :, b] < 1e-8)
        rho = np.where(flatless, 0.0, -(x[:, a] @ x[:, b].T) / m / np.where(flatless, 1.0, spread))
        fit = np.clip((rho + 1) / 2, 0, 1)
        fa, fb = is_flat[:, a, None], is_flat[None, :, b]
        curv = np.where(fa & fb, 1.0, np.where(fa | fb, 0.25, fit))
        return np.round(HIST * np.minimum(hist, 1.0) + CURV * curv, 9)

    return score(1, 3), score(2, 0)


def climb(row: np.ndarray, col: np.ndarray, across: np.ndarray, down: np.ndarray, limit: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """Places after local search over pieces in the order of their ids; see swap_search."""
    place = list(zip(row.tolist(), col.tolist(), strict=True))
    held = {xy: i for i, xy in enumerate(place)}

    def around(i: int) -> float:
        r, c = place[i]
        got = [score[j, i] if first else score[i, j] for z, score, first in (((r - 1, c), down, True), ((r + 1, c), down, False), ((r, c - 1), across, True), ((r, c + 1), across, False)) if (j := held.get(z)) is not None]
        return float(np.mean(got)) if got else 1.0

    def change(i: int, j: int) -> None:
        place[i], place[j] = place[j], place[i]
        held[place[i]], held[place[j]] = i, j

    for _ in range(limit):
        pairs = [(score[i, j], i, j) for i, (r, c) in enumerate(place) for z, score in (((r, c + 1), across), ((r + 1, c), down)) if (j := held.get(z)) is not None]
        if not pairs or (worst := min(pairs))[0] >= enough:
            break
        i = worst[1]
        for j in range(len(place)):
            if j in worst[1:]:
                continue
            before = around(i) + around(j)
            change(i, j)
            if around(i) + around(j) > before + 1e-12:
                break
            change(i, j)
        else:
            break
    return np.array([p[0] for p in place]), np.array([p[1] for p in place])


def swap_search(places: DataFrame, profiles: DataFrame, limit: int = 500, enough: float = 0.4, job: str = "job_id") -> DataFrame:
    """Places after local search: job, piece_id, row, col.

    Time and again the worst pair of neighbours is taken (of equals the first by ids); its first piece changes places with
    the first other piece, in the order of ids and but for the pair's second, that raises the sum of the two pieces' mean
    scores.  Every trial scores the neighbours that the two would have then, with the sides that would face each other.
    The search ends when the worst pair scores `enough`, no change helps, or after `limit` changes.  profiles: job,
    piece_id, sides (array of four arrays of samples).  A job is one puzzle, whose two matrices of scores (some 2,000
    pieces squared at most) one worker holds.  Pieces without a profile, or on a place that a smaller id holds, stay put
    and count for nothing; empty tables give no rows.
    """

    def run(key: tuple, place: pd.DataFrame, prof: pd.DataFrame) -> pd.DataFrame:
        place = place.sort_values("piece_id", kind="stable").reset_index(drop=True)
        known = {p: x for p, x in zip(prof.piece_id, prof.sides, strict=True)}
        move = np.flatnonzero(place.piece_id.isin(list(known)) & ~place.duplicated(["row", "col"]) & ~place.duplicated(["piece_id"]))
        if len(move):
            sides = np.array([[list(x) for x in known[p]] for p in place.piece_id.iloc[move]], float)
            r, c = climb(place.row.to_numpy()[move], place.col.to_numpy()[move], *facing(sides), limit, enough)
            place.loc[move, "row"], place.loc[move, "col"] = r, c
        return place[[job, "piece_id", "row", "col"]]

    return places.select(job, "piece_id", "row", "col").groupBy(job).cogroup(profiles.select(job, "piece_id", "sides").groupBy(job)).applyInPandas(run, f"{job} long, piece_id long, row long, col long")


def worst(scored: DataFrame, n: int = 1) -> DataFrame:
    """The n lowest pairs, a top-k that needs no full sort."""
    return scored.orderBy("combined", "a", "b").limit(n)


__all__ = ["attached", "climb", "combined", "complement", "facing", "swap_search", "worst"]
