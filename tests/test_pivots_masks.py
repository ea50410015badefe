"""Nearest keys and overlapping masks against all pairs, and how many pairs are met on the way."""

import numpy as np
import pytest

from tessera.operators import masks, pivots, vectors

SCHEMA = "q long, cls array<double>"
SMALL = pivots.Params(sample=300, block=64, least_block=16, queries=50)


def slow(queries, keys, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-8)
    out = []
    for q, v in queries:
        cos = [(round(float(unit(v) @ unit(x)), 12) + 0.0, i) for i, x in keys]
        out += [(q, i, r) for r, (_, i) in enumerate(sorted(cos, key=lambda t: (-t[0], t[1]))[:k], 1)]
    return sorted(out)


def drawn(kind, rng, n=900, dim=12):
    x = rng.standard_normal((n, dim)).round(3)
    if kind != "isotropic":
        x = (6 * rng.standard_normal((14, dim)))[rng.integers(0, 14, n)] + 0.4 * x
    if kind == "copies":
        x[: n // 3] = x[0]
        x[-5:] = 0.0
    return x


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "copies"])
def test_nearest_keys(spark, kind):
    rng = np.random.default_rng(3)
    x = drawn(kind, rng)
    keys = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [(i, v.tolist()) for i, v in enumerate(x[::9] + 0.01)] + [(1000, [0.0] * 12), (1001, keys[0][1])]
    q, ks = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(keys, "id long, cls array<double>")
    want = slow(queries, keys, 7)
    for p in (SMALL, pivots.Params()):
        got = vectors.top_cosine(q, ks, 7, ["q"], ["id"], p=p)
        assert sorted((r["q"], r["id"], r["rk"]) for r in got.collect()) == want
    share = pivots.share_met(q.filter("q <> 1000"), ks, 7, ["q"], ["id"], p=SMALL)
    assert share < {"isotropic": 1.01, "clusters": 0.25, "copies": 0.6}[kind], share


def test_few_keys_and_none(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    keys = lambda rows: spark.createDataFrame(rows, "id long, cls array<double>")
    run = lambda rows: [(r["id"], r["coarse"], r["rk"]) for r in vectors.top_cosine(q, keys(rows), 3, ["q"], ["id"]).orderBy("rk").collect()]
    assert run([(5, [0.0, 2.0]), (4, [3.0, 0.0])]) == [(4, 1.0, 1), (5, 0.0, 2)]
    assert run([(5, [0.0, 0.0]), (4, [0.0, 0.0])]) == [(4, 0.0, 1), (5, 0.0, 2)]
    assert run([]) == []
    assert vectors.top_cosine(q.limit(0), keys([(5, [0.0, 2.0])]), 3, ["q"], ["id"]).count() == 0


def brute_overlaps(sets, least):
    out = []
    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and n / min(len(sets[a]), len(sets[b])) > least:
                out.append((a, b, n))
    return sorted(out)


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.75])
def test_overlaps(spark, least):
    rng = np.random.default_rng(4)
    sets = {m: set(rng.integers(0, 60, rng.integers(1, 14)).tolist()) for m in range(90)}
    sets |= {90: set(sets[3]), 91: {500}, 92: {500}}
    rows = [(m, p) for m, s in sets.items() for p in s]
    df = spark.createDataFrame([*rows, (None, 3), (4, None)], "mask_id long, px long")
    got = masks.overlaps(df, least).collect()
    assert sorted((r["a"], r["b"], r["inter"]) for r in got) == brute_overlaps(sets, least)
    assert all(r["ov"] == r["inter"] / min(len(sets[r["a"]]), len(sets[r["b"]])) for r in got)
    assert masks.overlaps(df.limit(0), least).count() == 0


def test_a_pixel_of_a_third_of_all_masks(spark):
    """The common pixel is in nobody's prefix: pairs are met through rare ones, and the result is exact."""
    rng = np.random.default_rng(5)
    sets = {m: {-1, *rng.integers(0, 4000, 9).tolist()} if m % 3 == 0 else set(rng.integers(0, 4000, 10).tolist()) for m in range(900)}
    for m in range(0, 60, 2):
        sets[m + 1] = {*list(sets[m])[:8], 9000 + m}
    df = spark.createDataFrame([(m, p) for m, s in sets.items() for p in s], "mask_id long, px long")
    every = df.toDF("a", "px").join(df.toDF("b", "px"), "px").filter("a < b").count()
    met = masks.candidates(masks.gathered(df), 0.5).count()
    assert met < every / 10, (met, every)
    split = masks.candidates(masks.gathered(df), 0.5, hot=50).distinct()
    assert sorted(tuple(r) for r in split.collect()) == sorted(tuple(r) for r in masks.candidates(masks.gathered(df), 0.5).distinct().collect())
    got = sorted((r["a"], r["b"], r["inter"]) for r in masks.overlaps(df, 0.5).collect())
    assert got == brute_overlaps(sets, 0.5) and len(got) >= 30
