"""Targets against rounds of resharing, schedules, shards."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = budget * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > cap * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in rest}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def words(t):
    return len((t or "").encode().split())


def check(docs, p):
    rows = docs.collect()
    out = mixing.mix(docs, p).collect()
    assert sorted((str(r["row"]["doc_id"]), r["size"]) for r in out) == sorted((str(r["doc_id"]), words(r["text"])) for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    want = brute_targets(sizes)
    for r in out:
        s = r["row"]["source"]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    filled, first = defaultdict(list), defaultdict(list)
    for r in out:
        for x in r["pieces"]:
            filled[x["slot"]].append((x["place"], x["place"] + x["n"], r["row"]["source"]))
            first[x["slot"]].append(r["row"]["source"])
        for turn in (0, 1):  # each time through, a document's words are taken from the first one on, without gaps
            at = 0
            for x in sorted((x for x in r["pieces"] if x["turn"] == turn), key=lambda x: x["first"]):
                assert x["first"] == at and x["n"] > 0
                at += x["n"]
            assert at <= r["size"]
    for slot, parts in filled.items():  # a slot is one block of one source, filled from its start
        parts.sort(key=lambda x: x[:2])
        assert parts[0][0] == 0 and len({x[2] for x in parts}) == 1
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False)) and parts[-1][1] <= p.block
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = mixing.mix(docs.repartition(3), p).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))


def test_odd_documents(odd_docs):
    check(odd_docs, mixing.Params())
    check(odd_docs, mixing.Params(block=7))


def test_smallest_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), mixing.Params(block=64))


def test_slots_are_those_of_the_sequence():
    one = 1 << mixing.BITS
    point = lambda s: int(format(s, f"0{mixing.BITS}b")[::-1], 2)
    edges = [0, one // 3, one // 3 + 12_345, one // 2, one - one // 7, one]
    for lo, hi in zip(edges, edges[1:], strict=False):
        want = [s for s in range(3_000) if lo <= point(s) < hi]
        assert mixing.slots(lo, hi, np.arange(len(want))).tolist() == want
    assert mixing.slots(0, one, np.arange(5)).tolist() == [0, 1, 2, 3, 4]
    tiny = mixing.slots(5, 6, np.arange(2))  # one point in 2 ** BITS
    assert point(int(tiny[0])) == 5 and tiny[1] - tiny[0] == one
    assert (mixing.slots(7, 7, np.arange(3)) >= one).all()


def test_every_stretch_has_the_targets_proportions():
    cuts = [int(x * 2**mixing.BITS) for x in (0, 0.7, 0.9, 1)]
    drawn = sorted((int(s), k) for k, n in enumerate((700, 200, 100)) for s in mixing.slots(cuts[k], cuts[k + 1], np.arange(n)))
    for k, n in enumerate((700, 200, 100)):
        seen = 0
        for i, (_, source) in enumerate(drawn[:900], 1):
            seen += source == k
            assert abs(seen - n / 1000 * i) < 8


def test_no_words_and_no_rows(spark, odd_docs):
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(none).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_shards(odd_docs):
    key = [F.col("doc_id"), F.col("text")]
    out = sharding.shard(odd_docs, key, 4, 8)
    assert set(odd_docs.columns) <= set(out.columns)
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    n = [len(x) for x in by.values()]
    assert sum(n) == odd_docs.count() and max(n) - min(n) <= 1 and len(by) == 4
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    place = lambda df: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in df.collect())
    assert place(out) == place(sharding.shard(odd_docs.repartition(2), key, 4, 8))
    assert place(out) != place(sharding.shard(odd_docs, key, 4, 8, seed=2))
    assert sharding.shard(odd_docs.limit(0), key, 4, 8).count() == 0


def test_matrix_and_law():
    import random

    sizes = [7, 0, 13, 5, 1000]
    m = sharding.matrix(sizes, 6, 3)
    assert [sum(r) for r in m] == sizes and max(map(sum, zip(*m, strict=True))) - min(map(sum, zip(*m, strict=True))) <= 1
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    mean, var = sum(draws) / 4000, sum((x - 6) ** 2 for x in draws) / 4000
    assert mean == pytest.approx(6, abs=0.12) and var == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, abs=0.3)
    assert sharding.hypergeometric(rng, 10**12, 10**13, 10**9) == pytest.approx(10**9 / 11, rel=1e-3)
