"""Quality by weak supervision: rules vote or abstain, and the posterior of a latent class decides.

Every rule votes good, bad or abstains on a document's counts.  Expectation-maximisation over the patterns of votes
(at most 3 to the number of rules, however many documents) estimates how each rule votes on good and on bad documents;
the posterior probability of the good class then follows from a document's own votes.

Cases: null and empty texts have counts of 0; no rule divides by zero (a rule without a basis abstains); repeated rows
count each; an empty table gives no rows and the prior's estimates; extra columns stay, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WHITE, small_batches
from tessera.session import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_ended", "n_unlettered")
SYMBOLS = b"#*$%&|<>"
NO_LETTER = "".join(c for c in string.printable if not c.isalpha()).encode()
STRIP = WHITE.decode()


@dataclass(frozen=True)
class Rule:
    """Conditions in SQL over the counts; where neither holds, or one is null, the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_words > 0 AND n_symbols <= 0.02 * n_words"),
    Rule("word_length", "word_chars > 6.8 * n_words OR word_chars < 3.4 * n_words", "n_words > 0 AND word_chars BETWEEN 3.8 * n_words AND 6.2 * n_words"),
    Rule("same_lines", "n_dup_lines > 0.5 * n_lines", "n_lines >= 2 AND n_dup_lines <= 0.2 * n_lines"),
    Rule("same_phrases", "n_repeat_words > 0.3 * n_words", "n_words >= 3 AND n_repeat_words <= 0.1 * n_words"),
    Rule("vocabulary", "n_words >= 50 AND n_distinct < 0.25 * n_words", "n_words >= 50 AND n_distinct > 0.5 * n_words"),
    Rule("line_ends", "n_lines >= 3 AND n_ended < 0.3 * n_lines", "n_lines >= 1 AND n_ended > 0.7 * n_lines"),
    Rule("letters", "n_unlettered > 0.2 * n_words", "n_words > 0 AND n_unlettered <= 0.05 * n_words"),
)


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if x.strip(STRIP)]
    repeat = 0
    if n >= 3:
        v = len(index)
        pair = ids[:-1] * v + ids[1:]
        if v >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * v + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    bare = [i for w, i in index.items() if not w.translate(None, NO_LETTER)]
    unlettered = int(np.bincount(ids, minlength=len(index))[bare].sum()) if bare else 0
    ended = sum(x.rstrip(STRIP)[-1] in ".!?:;。！？…\"'”»)" for x in lines)
    letters = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    return n, letters, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(index), len(lines), ended, unlettered


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with a struct column `counts` of COUNTS, in one pass over whole texts."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "counts")]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = np.array([counts_of(b[text][i].as_py()) for i in range(b.num_rows)], np.int64).reshape(b.num_rows, len(COUNTS))
            counts = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), counts], names=[*names, "counts"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("counts", kind)]))


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of 1 (good), 0 (bad) and 2 (abstains), over a struct column `counts`."""
    from re import sub

    on = lambda cond: F.expr(sub("|".join(COUNTS), lambda m: f"counts.{m[0]}", cond))
    return F.array(*[F.when(on(r.bad), 0).when(on(r.good), 1).otherwise(2) for r in rules])


@dataclass
class Model:
    """log odds of good: the prior's, and per rule those of the votes bad, good and abstains."""

    prior: float
    weights: list[list[float]]

    def log_odds(self, vote: Column) -> Column:
        out = F.lit(self.prior)
        for j, w in enumerate(self.weights):
            out = out + F.element_at(F.array(*[F.lit(x) for x in w]), F.element_at(vote, j + 1) + 1)
        return out


def fit(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, pseudo: float = 4.0) -> Model:
    """EM on distinct patterns of votes with their counts.

    The start and the pseudo-counts say that rules seldom call a good document bad (2 %) and catch half of the bad ones.
    Abstaining is no evidence: it takes no part in the likelihood.
    """
    rules = patterns.shape[1]
    start = np.array([[0.5, 0.5], [0.02, 0.98]])  # votes of bad, of good documents
    table, share = np.repeat(start[:, None, :], rules, axis=1), np.array([0.1, 0.9])
    for _ in range(rounds):
        told = np.concatenate([np.log(table), np.zeros((2, rules, 1))], axis=2)
        log = np.log(share)[:, None] + sum((told[:, j, patterns[:, j]] for j in range(rules)), np.zeros((2, len(n))))
        post = np.exp(log - log.max(axis=0))
        post = post / post.sum(axis=0) * n
        new = pseudo * start[:, None, :] + np.stack([[[post[c][patterns[:, j] == v].sum() for v in range(2)] for j in range(rules)] for c in range(2)])
        new /= new.sum(axis=2, keepdims=True)
        share = (post.sum(axis=1) + pseudo * np.array([0.1, 0.9])) / (n.sum() + pseudo)
        moved, table = np.abs(new - table).max(), new
        if moved < 1e-10:
            break
    weights = [[*w, 0.0] for w in np.log(table[1] / table[0]).tolist()]
    return Model(float(np.log(share[1] / share[0])), weights)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without the text, with counts, votes and posterior (probability of good)."""
    voted = materialize(count(docs, text).withColumn("votes", votes(rules)), "votes")
    seen = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3 ** len(rules) rows
    patterns = np.array([r["votes"] for r in seen], np.int64).reshape(len(seen), len(rules))
    model = fit(patterns, np.array([r["n"] for r in seen], float))
    return voted.withColumn("posterior", 1 / (1 + F.exp(-model.log_odds(F.col("votes")))))
