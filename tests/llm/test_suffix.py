"""Removal of repeated strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix

SMALL = suffix.Params(length=24, gram=16, shallow=8, most=3)


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def check(docs, p):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *x) for r, x in zip(rows, brute([r["text"] for r in rows], p.length), strict=True))
    got = suffix.remove(docs, p, digest=True).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got.collect()) == want


def test_odd_documents(odd_docs):
    check(odd_docs, suffix.Params())


def test_small_windows_and_large_groups(spark, odd_docs):
    check(odd_docs, SMALL)  # groups of more than three contexts are divided
    rng = random.Random(2)
    words = ["".join(rng.choice("ab ") for _ in range(30)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(words) + rng.choice("xyz") for _ in range(5))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, SMALL)
    check(docs, suffix.Params(length=24, gram=16, shallow=8))


def test_one_gram_in_many_contexts(spark):
    """A common gram, whose contexts share some bytes on one side, on both or none, in groups of at most eight."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abc") for _ in range(n))
    gram, rows = some(16), []
    lefts, rights = [some(8) for _ in range(5)], [some(8) for _ in range(5)]
    for i in range(160):
        left, right = (rng.choice(lefts)[k:] if i % 4 else some(8 - k) for k in (0, 0)) if i % 3 else (lefts[0], rng.choice(rights)[: rng.randint(0, 8)])
        rows.append((i, f"{i}{left}{gram}{right}{i}"))
    check(spark.createDataFrame(rows, "doc_id long, text string"), suffix.Params(length=24, gram=16, shallow=8, most=8))


def test_smallest_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), suffix.Params())


def test_columns_and_text_stay(odd_docs):
    out = suffix.remove(odd_docs)
    assert out.columns == [*odd_docs.columns, "cut"]
    short = {r["text"] for r in out.filter("length(text) < 20 OR text IS NULL").collect()}
    assert {None, "", " \t\n", "one", "two words"} <= short
    assert suffix.remove(odd_docs.limit(0)).count() == 0


def test_words(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    for n in [7, 8, 9, 10] * 6:
        shared, other = [word() for _ in range(n)], [word() for _ in range(n)]
        rows += [(len(rows), " ".join([word(), *shared, word(), word(), *other, word()])), (len(rows), "\n".join([*shared, word(), *other]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 9]) for w in split for i in range(len(w) - 8))
    want = [[any(seen[tuple(w[i : i + 9])] > 1 for i in range(max(0, k - 8), min(k, len(w) - 9) + 1)) for k in range(len(w))] for w in split]
    want = sorted((str(i), tuple(x for x, gone in zip(w, g, strict=True) if not gone)) for (i, _), w, g in zip(rows, split, want, strict=True))
    for most in (3, 20_000):  # groups of more than three contexts are divided
        got = suffix.remove(docs, suffix.Params(length=10**6), words=suffix.Params(length=9, gram=4, most=most, words=True))
        assert sorted((str(r["doc_id"]), tuple((r["text"] or "").encode().split())) for r in got.collect()) == want


def test_passages_are_told_apart_from_bytes(spark):
    """What repeats over so many words is counted but stays, unless it repeats over so many bytes as well."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    short, long = " ".join(word(3) for _ in range(9)), " ".join(word(9) for _ in range(9))
    rows = [(i, f"{word(8)}{i} {short} {word(8)}{i} {long} {word(8)}{i}") for i in range(3)] + [(3, " ".join(word(5) for _ in range(30))), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.remove(docs, suffix.Params(length=60, gram=32), digest=True, report=suffix.Params(length=9, gram=4, words=True))
    want = {i: (2, len(short) + len(long), 1) for i in range(3)} | {3: (0, 0, 0), 4: (0, 0, 0)}
    assert {r["doc_id"]: (r["cut"]["n_passages"], r["cut"]["n_passage_bytes"], r["cut"]["n_spans"]) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=30))
def test_order(strings):
    order = suffix.deep_shallow(strings, 8)
    assert [strings[i] for i in order] == sorted(strings)
    lcp = suffix.agreeing(strings, order).tolist() if strings else []
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_anchors_of_many_texts_are_those_of_each():
    """Texts taken as one string choose what each alone would: every least gram of a window, and nothing over an end."""
    rng = np.random.default_rng(4)
    for words in (False, True):
        p = suffix.Params(length=24, gram=16, words=words)
        texts = ["".join(rng.choice(list("ab c"), n)) * k for n, k in ((0, 1), (23, 1), (24, 1), (200, 1), (3, 40), (1, 90), (25, 2), (60, 3))] * 2
        symbols = [suffix.symbols(t, p) for t in texts]
        which, at, g, c = suffix.anchors(symbols, p)
        for i, b in enumerate(symbols):
            alone = suffix.anchors([b], p)
            assert all((x[which == i] == y).all() for x, y in zip((at, g, c), alone[1:], strict=True))
            # The guarantee: each string of `length` holds an anchor whose gram no other gram of the string is below.
            hashes = {a: h for a, h in zip(at[which == i].tolist(), g[which == i].tolist(), strict=True)}
            for s in range(len(b) - p.length + 1):
                inner = [hashes[a] for a in range(s, s + p.side + 1) if a in hashes]
                grams = [b[a : a + p.gram].tobytes() for a in range(s, s + p.side + 1)]
                assert inner and all(grams[a - s] in {grams[x - s] for x in hashes if s <= x <= s + p.side and hashes[x] == hashes[a]} for a in hashes if s <= a <= s + p.side)
        assert len(np.unique(suffix.symbols("a b ab ba a\tb", suffix.Params(words=True)))) == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 45), st.integers(0, 12)), max_size=12), st.integers(0, 40))
def test_runs_of_ranges(ranges, n):
    covered = np.zeros(n + 60, bool)
    for a, k in ranges:
        covered[max(a, 0) : max(a + k, 0)] = True
    covered[n:] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]]))).reshape(-1, 2)
    a, b = suffix.runs_of(np.array([a for a, _ in ranges], int), np.array([a + k for a, k in ranges], int), n)
    assert [[x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)] == edge.tolist()


@settings(max_examples=200, deadline=None)
@given(*[st.binary(max_size=8).map(lambda b: bytes(x % 2 + 97 for x in b))] * 4)
def test_a_pair_needs_no_order(a, b, c, d):
    for lo, hi in ((0, 8), (2, 5), (3, 3)):
        found = suffix.repeated_offsets([a, b], [c, d], [1, 1], SMALL, lo, hi)
        assert [suffix._runs(f, SMALL, lo) for f in found] == [suffix.pair_ranges([a, b], [c, d], SMALL, lo, hi)] * 2
