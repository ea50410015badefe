"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of learned rotations (iterative quantisation of the principal axes, one rotation
for every `dim` bits).  A code is split into m substrings, each with its own index: a table of postings (substring,
value, code).  Two codes within radius r = m * t + a differ by t at most in one of the first a + 1 substrings, or by
t - 1 at most in one of the others (pigeonhole).  So a query asks for these values of its substrings, an equi-join on
(substring, value) retrieves every code within r, codes beyond the radius `rerank` are dropped, and the rest is ranked by
cosine on the vectors.  Buckets of more than `bucket` postings are split and their probes sent to every part.

Equal vectors share a posting, which keeps the k + 1 smallest of their ids: no more of them can be among the k nearest,
so a vector that stands in a third of all rows is one posting.  Rotations are fitted on at most `sample` rows; number of
substrings and radii on at most `probes` of these, whose true neighbours among all rows are found in one pass: of all
settings that keep a share `cover` of them, that with the least probes and postings met.  A query for which fewer than k
are found is compared with all vectors, in blocks.

Cases: vectors that are null, zero, of another length than most sampled ones or hold null or non-finite components take
no part, nor do rows without an id; rows with the query's own id are no candidates; repeated ids among queries are asked
once (least vector), among candidates they count once (best score); equal scores are ordered by id; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.session import materialize


@dataclass(frozen=True)
class Params:
    """bits must be a multiple of 64; substrings are `shortest` to `longest` bits long."""

    k: int = 5
    bits: int = 256
    sample: int = 8_192
    probes: int = 512
    cover: float = 0.97
    shortest: int = 8
    longest: int = 20
    most_probes: int = 20_000
    bucket: int = 4_096
    block: int = 4_096
    queries: int = 256
    rounds: int = 25
    seed: int = 1


@dataclass
class Model:
    """rotation: dim x bits; radius: what is retrieved for certain; rerank: code distance up to which vectors are
    compared; reach: distance asked for in each substring; share: of all pairs, those that meet in a bucket."""

    rotation: np.ndarray
    radius: int = -1
    rerank: int = 0
    reach: list[int] = field(default_factory=list)
    share: float = 0.0

    def bits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.rotation > 0

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        return substrings(bits, max(1, len(self.reach)))


def substrings(bits: np.ndarray, m: int) -> np.ndarray:
    """Rows of bits as rows of m numbers."""
    return np.stack([part @ (1 << np.arange(part.shape[1])) for part in np.array_split(bits.astype(np.int64), m, axis=1)], axis=1)


def quantiser(x: np.ndarray, p: Params) -> np.ndarray:
    """Rotations by iterative quantisation: signs are fixed, then the rotation that brings the vectors closest to them."""
    rng = np.random.default_rng(p.seed)
    dim = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    y, out = x @ axes, []
    for at in range(0, p.bits, dim):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(p.rounds):
            u, _, v = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ v).T
        out.append((axes @ r)[:, : p.bits - at])
    return np.concatenate(out, axis=1)


def reaches(radius: int, m: int) -> list[int]:
    """Distance to ask for in each of m substrings; -1: none need be asked for."""
    t, a = divmod(radius, m)
    return [t if j <= a else t - 1 for j in range(m)]


def tune(near: np.ndarray, other: np.ndarray, rows: int, p: Params) -> tuple[int, int, list[int], float]:
    """Radius, rerank, reach and share of the cheapest setting; near [probe, neighbour, bit] and other [probe, row, bit]
    tell where the codes of true neighbours and of any rows differ from the probes'."""
    full = near.sum(axis=2)
    rerank = int(np.quantile(full, (1 + p.cover) / 2, method="higher"))
    best = None
    for m in sorted({round(p.bits / s) for s in range(p.shortest, p.longest + 1)}):
        d, e = (np.stack([x.sum(axis=2) for x in np.array_split(z, m, axis=2)]) for z in (near, other))
        sizes = [len(x) for x in np.array_split(np.arange(p.bits), m)]
        for radius in range(0, p.bits):
            reach = np.array(reaches(radius, m))
            probes = sum(comb(n, i) for n, t in zip(sizes, reach, strict=True) for i in range(t + 1))
            if probes > p.most_probes:
                break
            if ((d <= reach[:, None, None]).any(axis=0) & (full <= rerank)).mean() >= p.cover:
                met = e <= reach[:, None, None]
                # A probe is a row to shuffle, a posting that it meets is compared in place.
                cost = 8 * probes + met.sum(axis=0).mean() * rows
                if best is None or cost < best[0]:
                    best = cost, radius, reach.tolist(), float(met.any(axis=0).mean())
                break
    return (best[1], rerank, best[2], best[3]) if best else (-1, rerank, [], 0.0)


def _true_neighbours(distinct: DataFrame, probe: np.ndarray, k: int) -> list[tuple[int, list[float]]]:
    """(probe, vector) of the k nearest other vectors of each probe: a task returns its own k best, of which k stay."""

    def run(batches: Iterator[pa.RecordBatch]):
        score, kept = np.full((len(probe), k), -2.0), np.zeros((len(probe), k, probe.shape[1]))
        for x in (y[at : at + 2_048] for b in batches for y in [_matrix(b["embedding"], probe.shape[1])[1]] for at in range(0, len(y), 2_048)):
            cos = probe @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            cos[cos > 1 - 1e-12] = -2  # the probe itself
            at = np.argsort(-np.concatenate([score, cos], axis=1), axis=1)[:, :k]
            rows = np.arange(len(probe))[:, None]
            kept = np.where((at < k)[:, :, None], kept[rows, np.minimum(at, k - 1)], x[np.maximum(at - k, 0)])
            score = np.concatenate([score, cos], axis=1)[rows, at]
        i, j = np.nonzero(score > -2)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(score[i, j]), pa.array(list(kept[i, j]), pa.list_(pa.float64()))], names=["probe", "score", "vector"])

    found = distinct.select("embedding").mapInArrow(run, "probe int, score double, vector array<double>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score")))
    return [(r[0], r[1]) for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).select("probe", "vector").collect()]


def fit(distinct: DataFrame, p: Params = Params()) -> Model | None:
    """distinct: node, embedding (valid ones).  Learns from the p.sample rows with the smallest hashes."""
    rows = distinct.count()
    taken = _sampled(distinct, rows, p.sample)
    if not taken:
        return None
    dim = Counter(len(r[0]) for r in taken).most_common(1)[0][0]
    x = np.array([r[0] for r in taken if len(r[0]) == dim], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = Model(quantiser(x, p))
    probe = x[: p.probes]
    pairs = _true_neighbours(distinct, probe, p.k)
    if pairs:
        bits = model.bits(probe)
        # Probes with fewer than k neighbours count with those they have.
        near = np.stack([bits[i] ^ model.bits(np.array(v)) for i, v in pairs])[None, :, :]
        others = model.bits(x[-min(len(x), 256) :])
        model.radius, model.rerank, model.reach, model.share = tune(near, bits[:128, None, :] ^ others[None, :, :], rows, p)
    return model


def _sampled(distinct: DataFrame, rows: int, n: int) -> list[tuple[list[float]]]:
    """embedding of the n rows with the smallest hashes.  A bound on the hashes lets little more than n rows come to the
    driver; a limit would bring n of every task there."""
    some = distinct.select(F.xxhash64("node").alias("h"), "node", "embedding")
    share = (n + 10 * n**0.5 + 100) / max(1, rows)
    found = some if share >= 1 else some.filter(F.col("h") < int(-(2**63) + share * 2**64))
    taken = found.toArrow().sort_by([("h", "ascending"), ("node", "ascending")]).slice(0, n)
    return [(x,) for x in taken["embedding"].to_pylist()]


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, embedding (floats if they are, else doubles) of the rows that take part."""
    kind = vectors.schema[embedding].dataType.simpleString()
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    v = v.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return v.filter(F.exists("embedding", lambda x: x != 0))


def _node() -> Column:
    """128 bits of hash of a vector."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), "embedding")), 16, "0") for i in (1, 2)])).alias("node")


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `dim` components, and those rows."""
    ends = column.offsets.to_numpy()
    keep = np.diff(ends) == dim
    flat, start = column.values.to_numpy(zero_copy_only=False).astype(float), ends[:-1][keep]
    return keep, flat[start[:, None] + np.arange(dim)[None, :]] if len(start) else np.empty((0, dim))


def coded(distinct: DataFrame, model: Model) -> DataFrame:
    """node, embedding of the rows of the right length -> the same with code (longs) and subs (substrings)."""
    dim, words = model.rotation.shape

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keep, x = _matrix(b["embedding"], dim)
            bits = model.bits(x)
            code = np.packbits(bits, axis=1).view(np.int64) if len(x) else np.empty((0, words // 64), np.int64)
            some = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some["node"], some["embedding"], pa.array(list(code), pa.list_(pa.int64())), pa.array(list(model.substrings(bits).astype(np.int32)), pa.list_(pa.int32()))], names=["node", "embedding", "code", "subs"])

    kind = distinct.schema["embedding"].dataType.simpleString()
    return distinct.select("node", "embedding").mapInArrow(run, f"node binary, embedding {kind}, code array<long>, subs array<int>")


def flips(bits: int, reach: int) -> np.ndarray:
    """All numbers of so many bits of which `reach` at most are set."""
    return np.array([sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(bits), n)], np.int32)


def probed(asked: DataFrame, model: Model) -> DataFrame:
    """node, code, subs of queries -> node, code, sub, value for every value to ask for."""
    bits = model.rotation.shape[1]
    masks = [flips(len(x), t) for x, t in zip(np.array_split(np.arange(bits), max(1, len(model.reach))), model.reach, strict=False)]
    sub = np.concatenate([np.full(len(x), j, np.int32) for j, x in enumerate(masks)] or [np.empty(0, np.int32)])
    mask = np.concatenate(masks or [np.empty(0, np.int32)])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                subs = b["subs"][i].values.to_numpy()
                row = pa.array(np.full(len(sub), i))
                yield pa.RecordBatch.from_arrays([b["node"].take(row), b["code"].take(row), pa.array(sub), pa.array(subs[sub] ^ mask)], names=["node", "code", "sub", "value"])

    return asked.select("node", "code", "subs").mapInArrow(run, "node binary, code array<long>, sub int, value int")


def retrieved(index: DataFrame, asked: DataFrame, model: Model, p: Params) -> DataFrame:
    """q, node: codes that share a bucket with a query and are within model.rerank of it."""
    postings = index.select("node", "code", F.posexplode("subs").alias("sub", "value"))
    hot = postings.groupBy("sub", "value").agg(F.count("*").alias("n")).filter(F.col("n") > p.bucket).select("sub", "value", F.ceil(F.col("n") / p.bucket).cast("int").alias("parts"))
    hot = materialize(hot, "hot-buckets")
    one = F.coalesce("parts", F.lit(1))
    postings = postings.join(hot, ["sub", "value"], "left").withColumn("part", F.pmod(F.xxhash64("node"), one).cast("int"))
    probes = probed(asked, model).withColumnsRenamed({"node": "q", "code": "q_code"}).join(hot, ["sub", "value"], "left")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), one - 1)))
    apart = sum((F.bit_count(F.col("code")[i].bitwiseXOR(F.col("q_code")[i])) for i in range(p.bits // 64)), F.lit(0))
    # Merged: a plan takes the probes for as small as the queries that they come from, and would send them all to the driver.
    return postings.join(probes.hint("merge"), ["sub", "value", "part"]).filter(apart <= model.rerank).select("q", "node").distinct()


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _scan(index: DataFrame, asked: DataFrame, k: int, p: Params) -> DataFrame:
    """q, node, score of each query's k best of all vectors: every block of queries meets every block of vectors through
    a shard key, and a meeting returns k rows a query."""
    spark = index.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        many = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64("node"), F.lit(many)).cast("int").alias("block")).agg(F.collect_list(F.struct("node", "embedding")).alias(name))

    x = packed(index, p.block, "xs").withColumn("shard", F.pmod("block", F.lit(shards)).cast("int")).drop("block")
    q = packed(asked, p.queries, "qs").drop("block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def opened(rows: pa.StructScalar) -> tuple[list[bytes], np.ndarray]:
        z = rows.values
        m = z.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(z), -1)
        return z.field("node"), m / np.linalg.norm(m, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                (xs, xm), (qs, qm) = opened(b["xs"][i]), opened(b["qs"][i])
                cos = qm @ xm.T
                best = np.argsort(-cos, axis=1)[:, : k + 8]  # some more than k, as the product is only good to rounding
                row = np.repeat(np.arange(len(qm)), best.shape[1])
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(row)), xs.take(pa.array(best.ravel()))], names=["q", "node"])

    return x.join(q.hint("merge"), "shard").drop("shard").mapInArrow(run, "q binary, node binary")


def _ranked(pairs: DataFrame, index: DataFrame, ids: DataFrame, asked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of pairs (q, node): the k best of each query, without its own id."""
    both = pairs.join(index.select("node", "embedding"), "node").join(asked.select(F.col("node").alias("q"), F.col("embedding").alias("e")), "q")
    score = _dot("embedding", "e") / (F.sqrt(_dot("embedding", "embedding")) * F.sqrt(_dot("e", "e")))
    scored = both.select("q", "node", score.alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = scored.join(ids, "node").select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    each = each.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = own.withColumnRenamed("node", "q").join(each, "q").filter("vec_id != query_id").withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(queries: DataFrame, vectors: DataFrame, p: Params = Params(), model: Model | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by cosine among those found."""
    spark = vectors.sparkSession
    small_batches(spark)
    data = valid(vectors, vec_id, embedding).select(_node(), "vec_id", "embedding")
    # The k + 1 smallest ids of each vector, by a limit in the map tasks first: copies do not meet in one task.
    nth = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = data.select("node", "vec_id").distinct().withColumn("n", nth).filter(F.col("n") <= p.k + 1)
    ids = materialize(few.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ids")
    distinct = materialize(data.groupBy("node").agg(F.first("embedding").alias("embedding")), "vectors")
    asked = valid(queries, vec_id, embedding).select("vec_id", F.col("embedding").cast(data.schema["embedding"].dataType).alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(_node(), F.col("vec_id").alias("query_id"), "embedding")
    model = model or fit(distinct, p)
    if model is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    asked = materialize(asked, "asked")
    index = materialize(coded(distinct, model), "index")
    probes = materialize(coded(asked.groupBy("node").agg(F.first("embedding").alias("embedding")), model), "probes")
    own = asked.select("node", "query_id").join(probes.select("node"), "node", "left_semi")
    found = materialize(_ranked(retrieved(index, probes, model, p), index, ids, probes, own, p.k), "found")
    served = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= p.k).select("query_id")
    rest = materialize(own.join(served, "query_id", "left_anti"), "rest")
    if not rest.limit(1).count():
        return found
    again = probes.join(rest, "node", "left_semi")
    return found.join(served, "query_id", "left_semi").unionByName(_ranked(_scan(index, again, p.k, p), index, ids, again, rest, p.k))
