"""Counts against plain loops, EM on drawn votes, automata against edit distance, scores on labels."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import quality, registry, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é\x0b\x1c |"), max_size=120))
def test_counts(text):
    assert quality.counts_of(text)[:5] == brute(text)


def test_documents(odd_docs):
    out = quality.judge(odd_docs)
    rows = out.select("doc_id", "counts.*", "posterior").collect()
    want = Counter((r["doc_id"], *brute(r["text"])) for r in odd_docs.collect())
    assert Counter(tuple(r)[:6] for r in rows) == want
    assert all(0 < r["posterior"] < 1 for r in rows)
    assert quality.judge(odd_docs.limit(0)).count() == 0


def test_posterior_finds_the_drawn_class():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    right = np.array([0.9, 0.8, 0.95, 0.7, 0.85])
    vote = np.where(rng.random((20_000, 5)) < right, good[:, None], ~good[:, None]).astype(int)
    vote[rng.random(vote.shape) < 0.3] = 2
    patterns, n = np.unique(vote, axis=0, return_counts=True)
    m = quality.fit(patterns, n.astype(float))
    odds = m.prior + sum(np.array(w)[vote[:, j]] for j, w in enumerate(m.weights))
    assert ((odds > 0) == good).mean() > 0.95
    assert np.argmax([abs(w[1] - w[0]) for w in m.weights]) == 2


def test_verdicts_on_labels(spark):
    out = registry.op4_weak_supervision(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in out) > 0.97 * len(out)


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
        d = new
    return d[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=6, unique=True), st.integers(0, 3))
def test_automaton(word, terms, most):
    near = [(distance(word, t), i) for i, t in enumerate(terms)]
    want = min((x for x in near if x[0] <= most), default=None)
    assert toxicity.nearest_term(word, toxicity.build_trie(terms), most) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=4, max_size=9), st.lists(st.text("abcd", min_size=5, max_size=8), min_size=1, max_size=4, unique=True))
def test_halves_lose_no_misspelling(word, terms):
    got = toxicity.Scanner(terms, [1.0] * len(terms), toxicity.Params()).lookup(word)
    want = min(((distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= 1), default=None)
    assert (got and (got[1], got[0])) == want


def test_quotation_is_told_from_abuse():
    s = toxicity.Scanner(["idiot"], [3.0], toxicity.Params())
    plain, quoted, bent = (s.features(t) for t in ("you are an idiot !", 'they wrote " you idiot " and left', "you idi0t"))
    assert plain[0] > 0 and plain[2] == 0 and quoted[2] > 0 and quoted[0] == 0 and bent[1] > 0
    assert s.features(None) == s.features("") == [0.0] * 6 + [1.0]


def test_scores(spark, odd_docs):
    out = registry.op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) > 0.9 * len(out)
    labels = odd_docs.filter("doc_id IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"))
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model)
    assert got.columns == [*odd_docs.columns, "score"] and got.filter("score BETWEEN 0 AND 1").count() == odd_docs.count()
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


def test_stems_speak_when_they_are_repeated():
    scan = toxicity.Scanner(["scum"], [4.0], toxicity.Params(), {"achli": 3.0})
    assert scan.features("ein achlichb wort")[:6] == [0.0] * 6
    assert scan.features("ein achlichb wort achlige mit scum")[0] == np.log1p(7.0)
    assert scan.features('er sagte "achlichb" und achlige wort')[:6] == [0.0] * 6


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_weights_keep_their_meaning(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.exponential(1, (60, 4)) * (rng.random((60, 4)) < 0.5), np.ones(60)])
    y = (x @ rng.normal(0, 2, 5) + rng.normal(0, 1, 60) > 0).astype(float)
    beta = toxicity.meaningful(x, y, 0.5)
    assert -1e-6 <= beta[1] <= beta[0] + 1e-6 and beta[2] <= beta[0] + 1e-6 or not beta[:-1].any()
    free = toxicity.logistic(x, y, 0.5)
    if 0 <= free[1] <= free[0] and free[2] <= free[0]:
        assert np.allclose(beta, free)


def test_only_supported_terms_lend_their_neighbours_weight():
    scan = toxicity.Model(["idiot", "eronhe", "scum"], [4.0, 2.1, 4.0], []).scanner()
    assert scan.lookup("idiit") == (0, 1, "") and scan.lookup("eronhx") is None and scan.lookup("eronhe") == (1, 0, "")
