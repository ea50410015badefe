"""Hard negatives against all pairs: drawn vectors, odd rows, the tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hardneg, registry

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def slow(rows, every=5, p=hardneg.Params()):
    dim = max(sorted({len(r[1]) for r in rows if r[1]}), key=lambda d: sum(r[1] is not None and len(r[1]) == d for r in rows), default=0)
    keep = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and len(v) == dim and None not in v and np.isfinite(v).all():
            keep[i] = min(keep.get(i, (label, v)), (label, v))
    ids = np.array(sorted(keep))
    x = np.array([np.floor(p.scale * np.array(keep[i][1], np.float32).astype(float)) for i in ids])
    labels = np.array([keep[i][0] for i in ids])
    out = []
    for a in [n for n, i in enumerate(ids) if i % every == 0]:
        s = x @ x[a]
        order = [n for n in np.lexsort((ids, -s)) if n != a]
        for b in [n for n in order if labels[n] == labels[a]][: p.positives]:
            hard = [n for n in order if labels[n] != labels[a] and p.low * s[b] <= 100 * s[n] <= p.high * s[b]][: p.negatives]
            out += [(int(ids[a]), int(ids[b]), k, int(ids[n]), int(s[b]), int(s[n])) for k, n in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, every=5, p=hardneg.Params()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % every == 0, p).collect())


SMALL = hardneg.Params(sample=120, leaf=8, cell=40, least_cell=16, group=7, tip=6, tip_anchors=3)


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "copies"])
def test_against_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8))
    if kind != "isotropic":
        x = (4 * rng.standard_normal((9, 8)))[rng.integers(0, 9, 400)] + 0.3 * x
    if kind == "copies":
        x[50:200] = x[50]  # a third of all rows
    labels = rng.integers(0, 4, 400)
    rows = [(i * 3 - 40, v.tolist(), int(c), "s", 1) for i, (v, c) in enumerate(zip(x.astype(np.float32), labels, strict=True))]
    want = slow(rows)
    assert len(want) > 20
    assert mined(spark, rows, p=SMALL) == want
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist(), i % 3, None, None) for i in range(60)]
    rows += [(None, [1.0] * 4, 1, "x", 0), (100, None, 1, "x", 0), (105, [1.0] * 4, None, "", 0), (110, [1.0, None, 1.0, 1.0], 0, "", 0), (115, [1.0, float("nan"), 1.0, 1.0], 0, "", 0), (120, [float("inf")] * 4, 0, "", 0), (125, [1.0] * 3, 1, "", 0), (130, [], 1, "", 0), (135, [0.0] * 4, 1, "", 0)]
    rows += [rows[5], rows[10], (7, [9.0] * 4, 0, "", 0), (10, [2.0] * 4, 2, "", 0)]
    assert mined(spark, rows) == mined(spark, rows, p=SMALL) == slow(rows) != []
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_nodes_are_pruned_for_whole_groups():
    """On clustered vectors few pairs of leaves are scored, and intervals hold what they promise."""
    rng = np.random.default_rng(9)
    x = (40 * rng.standard_normal((30, 16)))[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))
    a, b = hardneg.Tree(x[:300], 8), hardneg.Tree(x, 32)
    for i, j in rng.integers(0, [len(a.start), len(b.start)], (300, 2)):
        low, up = hardneg.intervals(a, np.array([i]), b, np.array([j]))
        s = x[:300][a.rows(i)] @ x[b.rows(j)].T
        assert low[0] <= s.min() and s.max() <= up[0]
    fifth = np.sort(x[:300] @ x.T, axis=1)[:, -5]
    i, j, _ = hardneg.descend(a, b, a.over(fifth, True), np.full(len(a.start), np.inf))
    met = sum((a.end[p] - a.start[p]) * (b.end[q] - b.start[q]) for p, q in zip(i, j, strict=True))
    assert met < 0.15 * 300 * 3000


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/sf{sf}/embeddings.parquet'")
    want = con.execute(hardneg.oracle()).fetchall()
    got = registry.op13_hard_negatives(spark, f"/root/testdata/sf{sf}")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
