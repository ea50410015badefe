"""Overlaps are counted where masks meet: pairs are not shuffled, and large sets take their own way."""

import numpy as np
import pytest

from tessera.operators import masks


def drawn(seed=8, n=120):
    rng = np.random.default_rng(seed)
    return {m: set(rng.integers(0, 70, rng.integers(1, 16)).tolist()) for m in range(n)}


def brute(sets, least, inter):
    n = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    return sorted((a, b, k) for (a, b), k in n.items() if k >= inter and k / min(len(sets[a]), len(sets[b])) > least)


def table(spark, sets):
    return spark.createDataFrame([(m, p) for m, s in sets.items() for p in s], "mask_id long, px long")


@pytest.mark.parametrize("light", [1, 7, 64])
@pytest.mark.parametrize("inter", [1, 2, 3])
def test_small_and_large_sets(spark, light, inter):
    sets = drawn()
    for least in (0.0, 0.5):
        got = masks.overlaps(table(spark, sets), least, inter, light=light)
        assert sorted((r["a"], r["b"], r["inter"]) for r in got.collect()) == brute(sets, least, inter)


def test_pairs_are_not_shuffled(spark):
    plan = masks.overlaps(table(spark, drawn()), 0.3)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in above and "Aggregate" not in above


@pytest.mark.parametrize("light", [3, 64])
def test_suppression_with_scores_on_the_edges(spark, light):
    sets = drawn(9)
    rows = [(m, (m * 7 % 10) / 10) for m in sets if m != 5] + [(900, 0.5)]
    score = dict(rows)
    kept = []
    for m in sorted(score, key=lambda m: (-score[m], m)):
        if not any(len(sets.get(m, set()) & sets[k]) / min(len(sets[m]), len(sets[k])) > 0.4 for k in kept if m in sets and k in sets):
            kept.append(m)
    t, df = table(spark, sets), spark.createDataFrame(rows, "mask_id long, score double")
    for edges in (masks.overlaps(t, 0.4, scores=df, light=light), masks.overlaps(t, 0.4)):
        assert sorted(r["mask_id"] for r in masks.suppressed(df, edges).collect()) == sorted(kept)
