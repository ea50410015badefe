"""Language of texts by sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters is white space, runs of it are one space; a space stands at either end.
n-grams of one to `orders` characters are hashed into 2^bits features.  A feature's value is its share of the text's
n-grams (TF) times ln((1 + texts) / (1 + texts that have it)) + 1 (IDF, counted over all training texts), times a gain.
The weights are learned by follow-the-regularised-leader with an elastic net (FTRL-proximal: L1 keeps most of them at
exactly 0, L2 shrinks the rest), and a temperature, fitted on sampled rows that training has not seen, divides the logits.

IDF and the languages' shares are counted over all training rows.  The regression reads a bounded sample: per language
those rows whose hashed ids lie below what gives about as many of each; shares correct the bias for it.

Cases: texts that are null or have no letter are `und` with score 0, and so is every text where nothing could be learned;
training rows with a null or empty language or a null text teach nothing; with one language all others' texts get it, with
score 1; very long texts are read whole, a stretch at a time; repeated rows are predicted one by one; other columns are
kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches
from tessera.session import Scratch

UNKNOWN = "und"
SPACE = 32
#: Letters end here in Unicode.
PLANES = 0x33500


@dataclass(frozen=True)
class Params:
    """sample is about how many rows the regression reads (never over four times that), languages how many there may be; alpha and beta set the steps of
    FTRL, l1 and l2 the elastic net; stretch is how many characters are hashed at once."""

    orders: int = 4
    bits: int = 16
    gain: float = 20.0
    sample: int = 4_096
    languages: int = 500
    calibrate: int = 5
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    stretch: int = 250_000


# -- n-grams --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: the lower-cased letter, or a space."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else SPACE for c in range(PLANES)] + [SPACE], np.uint32)


def normal(text: str) -> np.ndarray:
    """Code points of the letters, words parted by one space, one at either end; no letter: empty."""
    codes = letters()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), PLANES)]
    codes = np.concatenate([[SPACE], codes, [SPACE]]).astype(np.uint32)
    blank = codes == SPACE
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    return codes if len(codes) > 1 else codes[:0]


def hashed(codes: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, first position) of the n-grams, one order after the other; a lone space is none."""
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, p.orders + 1):
        if len(c) < n:
            return
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B1) + c[n - 1 :]
        at = np.arange(len(h))
        mixed = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - p.bits)
        if n == 1:
            keep = codes != SPACE
            yield mixed[keep].astype(np.int64), at[keep]
        else:
            yield mixed.astype(np.int64), at


def grams(texts: list[str | None], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of all n-grams of texts, about `stretch` characters at a time.

    Short texts are hashed together; what crosses from one into the next is left out.  Long ones are hashed in stretches
    that share orders - 1 characters, so that every n-gram comes once.
    """
    codes, owner, size = [], [], 0

    def flush():
        c, o = np.concatenate(codes), np.concatenate(owner)
        for n, (feature, at) in enumerate(hashed(c, p), 1):
            inside = o[at] == o[at + n - 1]
            yield feature[inside], o[at][inside]

    for i, text in enumerate(texts):
        c = normal(text or "")
        if len(c) > p.stretch:
            for start in range(0, len(c), p.stretch):
                piece = c[start : start + p.stretch + p.orders - 1]
                for feature, at in hashed(piece, p):
                    own = at < p.stretch
                    yield feature[own], np.full(own.sum(), i)
        elif len(c):
            codes.append(c)
            owner.append(np.full(len(c), i))
            size += len(c)
        if size > p.stretch:
            yield from flush()
            codes, owner, size = [], [], 0
    if codes:
        yield from flush()


# -- Regression -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """weights: feature x language, IDF and gain within; bias by language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    params: Params = field(default_factory=Params)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits by text and language, and the numbers of n-grams."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for feature, text in grams(texts, self.params):
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            if len(starts):
                sums[text[starts]] += np.add.reduceat(self.weights[feature], starts, axis=0)
                n += np.bincount(text, minlength=len(texts))
        return self.bias + sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, n = self.logits(texts)
        share = softmax(logits / self.temperature)
        best = share.argmax(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, share.max(axis=1, initial=0.0), 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """FTRL-proximal of multinomial logistic regression; weights exist only where a gradient has left the L1 ball."""

    def __init__(self, features: int, classes: int, p: Params):
        self.p = p
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        share = softmax((x @ w)[None, :])[0]
        share[label] -= 1.0
        g = x[:, None] * share[None, :]
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.p.alpha * w
        self.n[at] = more


def temperature(logits: np.ndarray, label: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """What to divide logits by so that the labels are likeliest; golden section over its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(label)), label]).mean())

    a, b, r = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


# -- On Spark -------------------------------------------------------------------------------------------------------


def _frequencies(p: Params):
    """Per task: feature, and the number of texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]):
        df, mark = np.zeros(1 << p.bits, np.int64), np.zeros(1 << p.bits, bool)
        for b in batches:
            for i in range(b.num_rows):
                parts = [feature for feature, _ in grams([b["text"][i].as_py()], p)]
                if len(parts) > p.orders:  # a text of several stretches
                    for feature in parts:
                        mark[feature] = True
                    parts = [np.flatnonzero(mark)]
                    mark[:] = False
                if parts:
                    df[np.concatenate(parts)] += 1  # an indexed += counts a repeated index once
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], names=["feature", "n"])

    return run


def _counted(p: Params):
    """Of sampled texts: features with their counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                n = np.zeros(1 << p.bits, np.int64)
                for feature, _ in grams([b["text"][i].as_py()], p):
                    n += np.bincount(feature, minlength=len(n))
                at = np.flatnonzero(n)
                ends = pa.array([0, len(at)], pa.int32())
                yield pa.RecordBatch.from_arrays([b["lang"].slice(i, 1), b["h"].slice(i, 1), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n[at], pa.int32()))], names=["lang", "h", "feature", "n"])

    return run


def fit(docs: DataFrame, p: Params = Params(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learns from all rows of docs that have a text and a language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang <> ''")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(p.languages + 1).collect()}
    if len(shares) > p.languages:
        raise ValueError(f"more than {p.languages} languages")
    if not shares:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0, p)
    languages = list(shares)
    df = np.zeros(1 << p.bits)
    for r in rows.select("text").mapInArrow(_frequencies(p), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        df[r["feature"]] = r["n"]
    idf = np.log((1 + sum(shares.values())) / (1 + df)) + 1
    with Scratch(spark) as scratch:
        # A language's rows are taken by a bound on their hash, which its count gives: nothing is shuffled.
        most = max(1, p.sample // len(languages))
        bound = F.create_map(*[F.lit(x) for k, n in shares.items() for x in (k, most / n)])[F.col("lang")]
        unit = (F.shiftrightunsigned("h", 11) / F.lit(2.0**53)).cast("double")
        picked = rows.filter(unit < bound).limit(4 * p.sample)
        sample = scratch.table(picked.mapInArrow(_counted(p), "lang string, h long, feature array<int>, n array<int>"), "sample").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    label = np.array([languages.index(x) for x in sample["lang"].to_pylist()])
    at, x = [], []
    for f, n in zip(sample["feature"], sample["n"], strict=True):
        f, n = f.values.to_numpy(), n.values.to_numpy().astype(float)
        at.append(f)
        x.append(p.gain * n / max(n.sum(), 1.0) * idf[f])
    # Training sees the rows that calibration does not; with few rows calibration sees all.
    apart = np.arange(len(label)) % p.calibrate == 0
    model = Ftrl(1 << p.bits, len(languages), p)
    order = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(label))
    for _ in range(p.epochs):
        for i in order:
            model.learn(at[i], x[i], label[i])
    w = model.weights(slice(None))
    taught = np.bincount(label[order], minlength=len(languages))
    share = np.array([shares[k] for k in languages], float)
    bias = np.log(share / share.sum()) - np.log((taught + 0.5) / (taught.sum() + 0.5 * len(languages)))
    held = np.flatnonzero(apart)
    logits = np.array([x[i] @ w[at[i]] for i in held]).reshape(len(held), len(languages)) + bias
    return Model(languages, w * idf[:, None] * p.gain, bias, temperature(logits, label[held]), p)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns `keep`, default all) with the language and its probability.  One pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            told, how = shared.value.predict(b[text].to_pylist())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(told, pa.string()), pa.array(how, pa.float64())], names=[*names, lang, score])

    return docs.mapInArrow(run, schema)

