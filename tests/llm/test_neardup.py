"""ProbMinHash near-duplicates against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import neardup

SF = "/root/testdata/sf0.001"


def brute(rows, k=5, least=0.8):
    """id of row -> set of rows in its component, over all pairs of texts."""
    texts = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        texts[t or ""].append(i)
    names = list(texts)
    sets = [set(neardup.shingles(t, k)[0].tolist()) for t in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for x, t in enumerate(names):
        for i in texts[t]:
            out[i] = find(x)
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    comp = brute(rows)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    want = sorted((str(d), str(least.get(comp[i]))) for i, (d, _) in enumerate(rows))
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in neardup.assign(docs).collect())
    assert got == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))


def test_odd_documents(odd_docs):
    check(odd_docs)


def test_smallest_tables(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_empty_table(odd_docs):
    assert neardup.assign(odd_docs.limit(0)).count() == 0 and neardup.keep_one(odd_docs.limit(0)).count() == 0


def test_estimates_follow_probability_jaccard():
    rng = np.random.default_rng(1)
    p = neardup.Params(registers=2048)
    a, b = (dict(zip(rng.integers(0, 2**62, 80).tolist(), rng.exponential(1, 80), strict=True)) for _ in range(2))
    shared = dict(list(a.items())[:50])
    b = dict(list(b.items())[:30]) | {k: v * rng.exponential(1) for k, v in shared.items()}
    sig = neardup.prob_minhash([(np.array(list(x), np.uint64), np.array(list(x.values()))) for x in (a, b)], p.registers)
    keys = set(a) | set(b)
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in set(a) & set(b))
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.04)


def test_small_sets_fill_every_register():
    sig = neardup.prob_minhash([(np.array([7], np.uint64), np.ones(1)), (np.array([7, 9], np.uint64), np.ones(2))], 128)
    assert (sig[0] == 7).all() and set(sig[1].tolist()) == {7, 9}


def test_unequal_repeats(spark):
    """Equal shingle sets but for a few, of which half is repeated in one text: always found."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:100] * 100 + words[100:]))]
    got = neardup.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i // 2 * 2 for i in range(120)}
