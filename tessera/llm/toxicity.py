"""Toxicity scores from a fuzzy lexicon.

A lexicon of terms is learned from labelled texts; the trie of its well supported terms is intersected with the Levenshtein
automaton of each unseen word, so that misspelled terms are found as well.  A term's support is the lesser of the toxic
documents and of the contexts that hold it, and its weight is a lower bound of its log odds.  Stems stand for inflected
terms: words that begin alike count where a document repeats them.  Each hit is weighed in its context window: inside
quotation marks it counts as quoted, next to other hits as abuse.  A logistic model over these sums gives the score; in it
a misspelled hit counts no less than nothing and, like a quoted one, no more than an exact one.

Cases: a null or empty text has no hits and gets the score of a text without hits; null labels are ignored; repeated
rows are scored one by one; without a single toxic (or clean) label every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches
from tessera.session import materialize

EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‟‘’‚«»‹›…–—¿¡·"
#: Marks a stem among counted words.
STEM = "\0"
OPEN, CLOSE = "“„«‹‘", "”»›’"
FEATURES = 7


@dataclass(frozen=True)
class Params:
    """sample_rows bounds the labelled rows that a fit reads; max_terms the lexicon, whose words have `shortest` to `longest`
    characters.  A term's log odds are a lower bound, `doubt` standard deviations of both counts below the point value; it
    is kept from min_log_odds; a stem, which is stem_from to stem_to characters long and counts in documents that repeat it,
    from min_stem_odds.  Terms of fuzzy_from characters and fuzzy_odds are found misspelled, too.  window is in
    characters a side."""

    sample_rows: int = 20_000
    min_support: int = 3
    min_share: float = 0.008
    min_log_odds: float = 2.0
    min_stem_odds: float = 1.6
    doubt: float = 1.0
    fuzzy_odds: float = 3.0
    max_terms: int = 2_000
    shortest: int = 3
    longest: int = 64
    fuzzy_from: int = 5
    stem_from: int = 5
    stem_to: int = 8
    window: int = 64
    cache_words: int = 400_000
    ridge: float = 0.5


# -- Levenshtein automaton and trie ---------------------------------------------------------------------------------


def build_trie(terms: list[str]) -> dict:
    """Nested dicts by character; the key "" holds the index of the term that ends there."""
    root: dict = {}
    for i, term in enumerate(terms):
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = i
    return root


class Automaton:
    """Nondeterministic Levenshtein automaton of one word: states are (characters used, edits spent)."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most
        self.start = self.close({(0, 0)})

    def close(self, states: set) -> frozenset:
        """Adds what deleting characters of the word reaches; drops states that another one subsumes."""
        best: dict[int, int] = {}
        for i, e in states:
            while i <= len(self.word) and e <= self.most:
                if best.get(i, self.most + 1) <= e:
                    break
                best[i] = e
                i, e = i + 1, e + 1
        return frozenset(best.items())

    def step(self, states: frozenset, ch: str) -> frozenset:
        out = set()
        for i, e in states:
            if i < len(self.word) and self.word[i] == ch:
                out.add((i + 1, e))
            elif e < self.most:
                out.add((i, e + 1))
                out.add((i + 1, e + 1))
        return self.close({(i, e) for i, e in out if i <= len(self.word)})

    def accepts(self, states: frozenset) -> int | None:
        return min((e for i, e in states if i == len(self.word)), default=None)


def nearest_term(word: str, trie: dict, most: int) -> tuple[int, int] | None:
    """(edits, term index) of the closest term within `most` edits; ties go to the smaller index."""
    auto = Automaton(word, most)
    best, stack = None, [(trie, auto.start)]
    while stack:
        node, states = stack.pop()
        for ch, below in node.items():
            if ch == "":
                d = auto.accepts(states)
                if d is not None and (best is None or (d, below) < best):
                    best = (d, below)
            elif after := auto.step(states, ch):
                stack.append((below, after))
    return best


# -- Scanner --------------------------------------------------------------------------------------------------------


class Scanner:
    """Finds terms in texts; remembers which words are clean, up to a bound."""

    def __init__(self, terms: list[str], weights: list[float], p: Params, stems: dict[str, float] | None = None, fuzzy: list[int] | None = None):
        """fuzzy: the terms to be found misspelled (default: all that are long enough)."""
        self.terms, self.weights, self.p, self.stems = terms, weights, p, stems or {}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        self.index = {t: i for i, t in enumerate(terms)}
        self.fuzzy = [i for i in (range(len(terms)) if fuzzy is None else fuzzy) if len(terms[i]) >= p.fuzzy_from]
        long = [terms[i] for i in self.fuzzy]
        self.trie = build_trie(long)
        # One edit leaves one half of a term as it was: either the word begins with the first or it ends with the second.
        # By the word's possible lengths, and the half's.
        self.halves: dict[int, dict[int, tuple[set, set]]] = {}
        for t in long:
            for size in (len(t) - 1, len(t), len(t) + 1):
                cut = len(t) // 2
                self.halves.setdefault(size, {}).setdefault(cut, (set(), set()))[0].add(t[:cut])
                self.halves[size].setdefault(len(t) - cut, (set(), set()))[1].add(t[cut:])
        self.clean: set[str] = set()
        self.found: dict[str, tuple[int, int, str]] = {}

    def lookup(self, raw: str) -> tuple[int, int, str] | None:
        """(term index or -1, edits, stem or "") for a word as it stands in a lower-cased text."""
        w = raw.strip(EDGE)
        stem = next((w[:n] for n in self.stem_sizes if w[:n] in self.stems), "") if self.stems else ""
        if (i := self.index.get(w)) is not None:
            return i, 0, stem
        for n, (heads, tails) in self.halves.get(len(w), {}).items():
            if w[:n] in heads or w[-n:] in tails:
                near = nearest_term(w, self.trie, 1)
                if near is not None:
                    return self.fuzzy[near[1]], near[0], stem
                break
        return (-1, 0, stem) if stem else None

    def features(self, text: str | None) -> list[float]:
        """Sums of weights of exact, misspelled and quoted hits, closeness of hits, distinct terms, density, 1."""
        low = (text or "").lower()
        words = low.split()
        new = set(words)
        hits = [w for w in new if w in self.found]
        new -= self.clean
        for w in new:
            if w not in self.found:
                if (hit := self.lookup(w)) is None:
                    self.clean.add(w)
                else:
                    self.found[w] = hit
                    hits.append(w)
        if len(self.clean) > self.p.cache_words:
            self.clean = set()
        if len(self.found) > self.p.cache_words:
            keep = {w: self.found[w] for w in hits}
            self.found = keep
        if not hits:
            return [0.0] * (FEATURES - 1) + [1.0]
        exact = fuzzy = quoted = close = 0.0
        n, last, kinds, begun = 0, -(10**9), set(), set()
        for m in re.finditer("|".join(re.escape(w) for w in sorted(hits, key=len, reverse=True)), low):
            a, b = m.span()
            if (a and not low[a - 1].isspace()) or (b < len(low) and not low[b].isspace()):
                continue
            i, edits, stem = self.found[m[0]]
            said = self.is_quoted(low, a, b)
            if i < 0 and (said or stem not in begun):  # a stem speaks from its second time on
                begun |= set() if said else {stem}
                continue
            weight = self.weights[i] if i >= 0 else self.stems[stem]
            if said:
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                exact += weight
                kinds.add(i if i >= 0 else stem)
                begun.add(stem)
            close += a - last <= self.p.window
            last, n = b, n + 1
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(close), np.log1p(len(kinds)), min(1.0, 20 * n / max(1, len(words))), 1.0]

    def is_quoted(self, low: str, a: int, b: int) -> bool:
        """Whether the hit stands within a quotation that begins and ends within the window, in its own line."""
        start = max(low.rfind("\n", 0, a) + 1, a - self.p.window)
        end = low.find("\n", b)
        after = low[max(a, b - 1) : min(len(low) if end < 0 else end, b + self.p.window)]
        before = low[start : a + 1]
        if before.count('"') % 2 and '"' in after:
            return True
        opened, closed = (max(before.rfind(c) for c in marks) for marks in (OPEN, CLOSE))
        return opened > closed and any(c in after for c in CLOSE)


# -- Model ----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    beta: list[float]
    params: Params = field(default_factory=Params)
    stems: dict[str, float] = field(default_factory=dict)

    def scanner(self) -> Scanner:
        # Only terms of real support lend their neighbours a weight.
        return Scanner(self.terms, self.weights, self.params, self.stems, [i for i, w in enumerate(self.weights) if w >= self.params.fuzzy_odds])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.asarray(self.beta), -30, 30)))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that very long texts do not pile up."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _word_counts(p: Params):
    """word, before, clean, toxic: rows without `before` count documents; a toxic document also gives a row for each word
    and the one before it, so that what near-copies repeat can be counted once.  The same for stems (word + STEM) that a document repeats."""

    def run(batches):
        seen: dict[tuple[str, str | None], list[int]] = {}
        for b in _texts(batches):
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                words = [w.strip(EDGE) for w in (text or "").lower().split()]
                stems = Counter(w[:n] for w in words if len(w) <= p.longest for n in range(p.stem_from, min(p.stem_to, len(w)) + 1))
                for pair in {(t + STEM, None) for t, n in stems.items() if n >= 2} | ({(t + STEM, before) for w, before in zip(words, ["", *words], strict=False) for n in range(p.stem_from, min(p.stem_to, len(w)) + 1) if stems[t := w[:n]] >= 2} if toxic else set()):
                    seen.setdefault(pair, [0, 0])[toxic] += 1
                for pair in {(w, None) for w in words} | (set(zip(words, ["", *words], strict=False)) if toxic else set()):
                    if p.shortest <= len(pair[0]) <= p.longest:
                        seen.setdefault(pair, [0, 0])[toxic] += 1
            if len(seen) > p.cache_words:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    return run


def _counted(seen: dict) -> pa.RecordBatch:
    words, before = zip(*seen, strict=True) if seen else ([], [])
    return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "before": pa.array(before, pa.string()), "clean": pa.array([v[0] for v in seen.values()], pa.int64()), "toxic": pa.array([v[1] for v in seen.values()], pa.int64())})


def _feature_rows(model: Model):
    def run(batches):
        scan = model.scanner()
        for b in _texts(batches):
            x = [scan.features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "toxic": b["toxic"]})

    return run


def penalty(columns: int, ridge: float) -> np.ndarray:
    """A ridge on all but the last column, the constant."""
    return np.array([ridge] * (columns - 1) + [1e-3])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50, pen: np.ndarray | None = None) -> np.ndarray:
    """Newton's method with penalty(), or with weights `pen` on the squares."""
    beta = np.zeros(x.shape[1])
    pen = penalty(x.shape[1], ridge) if pen is None else pen
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def meaningful(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """logistic() under the features' meaning: 0 <= misspelled <= exact and quoted <= exact.

    The likelihood is concave, so its best point under these is that of one set of active bounds: each bound is left out,
    or holds as an equality (a column that is dropped, or added to that of the exact hits), and the likeliest result that
    meets all of them is taken.
    """
    exact, fuzzy, quoted = 0, 1, 2
    pen = penalty(x.shape[1], ridge)
    best, least = None, np.inf
    for f in ("free", "zero", "exact"):
        for q in ("free", "exact"):
            join = np.eye(x.shape[1])
            if f == "exact":
                join[fuzzy, exact] = 1
            if q == "exact":
                join[quoted, exact] = 1
            drop = [fuzzy] * (f != "free") + [quoted] * (q == "exact")
            join = np.delete(join, drop, axis=1)
            beta = join @ logistic(x @ join, y, ridge, pen=pen @ join)
            z = x @ beta
            loss = np.logaddexp(0, z).sum() - y @ z + 0.5 * pen @ beta**2
            meets = -1e-9 <= beta[fuzzy] <= beta[exact] + 1e-9 and beta[quoted] <= beta[exact] + 1e-9
            if meets and loss < least:
                best, least = beta, loss
    return logistic(x[:, -1:], y, ridge) * np.eye(x.shape[1])[-1] if best is None else best


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Learn lexicon and weights from labelled rows.

    docs: doc_id, text.  labels: doc_id, toxic (0/1); at most p.sample_rows of them are used, those with the smallest
    hashes of doc_id, so the driver holds bounded data whatever the corpus.
    """
    small_batches(docs.sparkSession)
    picked = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows)
    )
    # Bounded by sample_rows; exact copies count once, since copied texts would lend their words false support.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    rows = materialize(rows, "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        share = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
        return Model([], [], [0.0] * (FEATURES - 1) + [float(np.log(share / (1 - share)))], p)
    support = max(p.min_support if n_toxic >= 20 else 2, int(np.ceil(p.min_share * n_toxic)))
    # What the counts allow: the toxic one lower, the clean one higher by so many standard deviations.
    few, many = F.greatest(F.col("toxic") - p.doubt * F.sqrt("toxic"), F.lit(0.0)), F.col("clean") + p.doubt * F.sqrt(F.col("clean") + 1)
    odds = F.log((few + 0.5) / (n_toxic + 1)) - F.log((many + 0.5) / (n_clean + 1))
    words = (
        rows.mapInArrow(_word_counts(p), "word string, before string, clean long, toxic long")
        .groupBy("word", "before").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.least(F.max(F.when(F.isnull("before"), F.col("toxic"))), F.count("before")).alias("toxic"))
        .filter(F.col("toxic") >= support).withColumn("odds", odds).filter(F.col("odds") >= F.when(F.col("word").endswith(STEM), p.min_stem_odds).otherwise(p.min_log_odds))
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(p.max_terms).collect()
    )
    terms = {r["word"]: float(r["odds"]) for r in words if not r["word"].endswith(STEM)}
    support = {r["word"]: r["toxic"] for r in words}
    stems: dict[str, float] = {}
    for r in words:  # the strongest first: of stems that begin alike one stays, and none that one term explains
        t = r["word"].removesuffix(STEM)
        if r["word"].endswith(STEM) and not any(k.startswith(t) or t.startswith(k) for k in stems) and not any(k.startswith(t) and support[k] >= r["toxic"] for k in terms):
            stems[t] = float(r["odds"])
    model = Model(list(terms), list(terms.values()), [], p, stems)
    seen = rows.mapInArrow(_feature_rows(model), "x array<double>, toxic int").collect()
    model.beta = meaningful(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float), p.ridge).tolist()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with one more double column: the probability that label toxic is 1.  One pass, no shuffle."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        scan = model.scanner()
        for b in _texts(batches):
            x = np.array([scan.features(t) for t in b[text].to_pylist()]).reshape(b.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)
