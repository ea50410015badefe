"""Exact nearest keys by cosine, with bounds from pivots.

Keys are dealt to cells: to the pivot that is closest, and within it by their angle to it.  The angle between a query and
any key of a cell is at least what the query's angle to the pivot and the cell's range of angles leave between them (the
triangle inequality on the sphere), so a cell whose bound lies below the K-th best score that a bounded sample of keys
already gives cannot hold an answer, and the query does not meet it.

Every task holds some blocks of queries, of bounded bytes, and all blocks of keys pass through it, one at a time, those
aside which none of its queries can reach.  A meeting is a matrix product; of it stays what is among a query's K best so far.
So the shuffles carry each key, each query and each answer, never pairs: disk grows with the tables and the answer, not with
their product.

The driver holds the pivots, the sample and one row a cell or pivot, all bounded by Params.  Full cells are split by a hash
of the ids, so one vector may stand in a third of all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

#: Scores are rounded to so many decimals, so that equal ones compare equal; bounds leave more room.
DIGITS, ROOM = 12, 1e-7


@dataclass(frozen=True)
class Params:
    """At most `pivots` times `shells` cells; a cell's part has about `block` keys, a block about `queries` queries at most,
    a task about `held` bytes of them."""

    sample: int = 4_096
    pivots: int = 128
    shells: int = 16
    block: int = 1_024
    least_block: int = 256
    queries: int = 1_024
    held: int = 16 << 20
    rounds: int = 6


def units(vec: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of unit length; a vector of length 0 stays 0."""
    m = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


@dataclass
class Cells:
    """pivots: rows of unit length; edges[p]: angles at which the shells of pivot p end; sample: unit rows of some keys.
    low, high, n: by cell, pivot * shells + shell; the last cell holds the keys of length 0."""

    pivots: np.ndarray
    edges: list[np.ndarray]
    sample: np.ndarray
    shells: int
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    parts: np.ndarray

    @property
    def none(self) -> int:
        return len(self.pivots) * self.shells

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and angle of each unit row."""
        cos = x @ self.pivots.T
        p = cos.argmax(axis=1)
        angle = angles(cos[np.arange(len(x)), p])
        cell = p * self.shells
        for j in np.unique(p):
            cell[p == j] += np.searchsorted(self.edges[j], angle[p == j])
        return np.where((x * x).sum(axis=1) > 0, cell, self.none), angle

    def least(self, q: np.ndarray, k: int) -> np.ndarray:
        """What the k-th best key of each unit query has at least."""
        sampled = q @ self.sample.T
        return np.partition(sampled, -k, axis=1)[:, -k].copy() if sampled.shape[1] >= k else np.full(len(q), -np.inf)

    def reach(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which cells can hold one of a unit query's best keys: query x cell."""
        at = np.repeat(angles(q @ self.pivots.T), self.shells, axis=1)
        apart = np.maximum(0.0, np.maximum(at - self.high[:-1], self.low[:-1] - at))
        bound = np.where((q * q).sum(axis=1, keepdims=True) > 0, np.cos(np.minimum(apart, np.pi)), 0.0)
        bound = np.concatenate([bound, np.zeros((len(q), 1))], axis=1)
        return (bound + ROOM >= least[:, None]) & (self.n > 0)


def centres(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k unit directions among unit rows x: each first one far from those before, then means of what is closest."""
    at = [0]
    best = x @ x[0]
    while len(at) < min(k, len(x)):
        new = int(best.argmin())
        if best[new] > 1 - 1e-9:  # all rows stand on a pivot
            break
        at.append(new)
        best = np.maximum(best, x @ x[new])
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            mean = x[near == j].sum(axis=0) if (near == j).any() else c[j]
            c[j] = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else c[j]
    return c


def fitted(keys: DataFrame, ids: list[str], vec: str, n: int, p: Params) -> Cells | None:
    """Pivots and shells from a bounded sample of the keys; None where no key has a length."""
    picked = keys.select(*ids, vec).orderBy(F.xxhash64(*ids), *ids).limit(p.sample).toArrow()
    x = units(picked[vec].combine_chunks(), picked.num_rows) if picked.num_rows else np.zeros((0, 1))
    lengthy = x[(x * x).sum(axis=1) > 0]
    if not len(lengthy):
        return None
    block = min(p.block, max(p.least_block, n // 16))
    c = centres(lengthy, max(1, min(p.pivots, n // block)), p.rounds)
    cos = lengthy @ c.T
    near = cos.argmax(axis=1)
    edges = []
    for j in range(len(c)):
        a = np.sort(angles(cos[near == j, j]))
        shells = min(p.shells, max(1, round(len(a) / len(lengthy) * n / block)))
        edges.append(np.quantile(a, np.arange(1, shells) / shells) if len(a) else np.empty(0))
    cells = len(c) * p.shells + 1
    return Cells(c, edges, x, p.shells, np.zeros(cells), np.zeros(cells), np.zeros(cells, np.int64), np.ones(cells, np.int64))


def dealt(keys: DataFrame, ids: list[str], vec: str, cells: Cells, p: Params) -> DataFrame:
    """Every key in its cell, and the cells' ranges measured over all keys: cell, part, x (ids, vec_)."""
    fields = [keys.schema[c] for c in ids]
    schema = T.StructType([*fields, T.StructField("vec_", keys.schema[vec].dataType), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                cell, angle = cells.place(units(b[vec], b.num_rows))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ids), b[vec], pa.array(cell, pa.int32()), pa.array(angle)], names=[f.name for f in schema])

    rows = materialize(keys.select(*ids, vec).mapInArrow(run, schema), "keys")
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a cell
        cells.low[r["cell"]], cells.high[r["cell"]], cells.n[r["cell"]] = r["low"], r["high"], r["n"]
    cells.parts = np.maximum(1, -(-cells.n // (2 * p.block)))
    parts = F.element_at(F.lit(cells.parts.tolist()), F.col("cell") + 1)
    some = rows.withColumn("part", F.pmod(F.xxhash64(*ids), parts).cast("int"))
    return some.groupBy("cell", "part").agg(F.collect_list(F.struct(*ids, "vec_")).alias("x"))


def packed(groups: DataFrame, group: str, ids: list[str], name: str, cells: Cells, k: int = 0) -> DataFrame:
    """group, name (unit rows as bytes, in order of ids), name0 .. (ids); with k also the cells that its rows can reach.

    groups: group, x (ids, vec_)."""
    kinds = groups.schema["x"].dataType.elementType
    more = [T.StructField("cells", T.ArrayType(T.IntegerType()))] if k else []
    schema = T.StructType([groups.schema[group], T.StructField(name, T.BinaryType()), *[T.StructField(f"{name}{j}", T.ArrayType(kinds[c].dataType)) for j, c in enumerate(ids)], *more])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                rows = b["x"][i].values
                rows = rows.take(pa.array(np.lexsort([rows.field(c).to_numpy(zero_copy_only=False) for c in reversed(ids)])))
                x = units(rows.field("vec_"), len(rows))
                one = pa.array([0, len(rows)], pa.int32())
                cols = [b[group].slice(i, 1), pa.array([x.tobytes()], pa.binary()), *(pa.ListArray.from_arrays(one, rows.field(c)) for c in ids)]
                if k:
                    at = np.flatnonzero(cells.reach(x, cells.least(x, k)).any(axis=0))
                    cols.append(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return groups.select(group, "x").mapInArrow(run, schema)


def asked(queries: DataFrame, ids: list[str], vec: str, cells: Cells, k: int, p: Params) -> DataFrame:
    """Queries in blocks, packed(), those close to one pivot together; a partition has about p.held bytes of them."""
    fields = [queries.schema[c] for c in ids]
    schema = T.StructType([*fields, T.StructField("vec_", queries.schema[vec].dataType), T.StructField("pivot", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                near = (units(b[vec], b.num_rows) @ cells.pivots.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ids), b[vec], pa.array(near, pa.int32())], names=[f.name for f in schema])

    near = queries.select(*ids, vec).mapInArrow(run, schema)
    n = np.zeros(len(cells.pivots), np.int64)
    for r in near.groupBy("pivot").agg(F.count("*").alias("n")).collect():  # a row a pivot
        n[r["pivot"]] = r["n"]
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-int(n.sum()) * cells.pivots.shape[1] * 8 // p.held))
    parts = np.maximum(1, -(-n // max(1, min(p.queries, int(n.sum()) // (2 * tasks)))))
    first = np.cumsum(parts) - parts
    of = lambda x: F.element_at(F.lit(x.tolist()), F.col("pivot") + 1)
    block = (of(first) + F.pmod(F.xxhash64(*ids, "vec_"), of(parts))).cast("int")
    # Blocks are dealt to the tasks in turn, and gathered where they are.
    dealt_ = near.withColumn("block", block).withColumn("task", (F.col("block") % tasks).cast("int")).repartitionById(tasks, "task")
    return packed(dealt_.groupBy("task", "block").agg(F.collect_list(F.struct(*ids, "vec_")).alias("x")), "block", ids, "q", cells, k)


class Best:
    """A block of unit queries and the k best of the keys that they have met.

    New ones are kept aside until there are as many as answers, and then all but the best go; what falls below the k-th
    best by then is not taken at all."""

    def __init__(self, q: np.ndarray, ids: list[pa.Array], cells: Cells, k: int, also: Callable | None):
        self.q, self.ids, self.k, self.also = q, ids, k, also
        # Single precision errs by half a unit in every factor, product and sum at most.
        self.short, self.room = q.astype(np.float32), (q.shape[1] + 4) * 6e-8 + 1e-11
        self.least = cells.least(q, k)
        self.can = np.packbits(cells.reach(q, self.least), axis=0)
        self.aside: list[list[np.ndarray]] = []
        self.n = self.limit = len(q) * k

    def meet(self, x: np.ndarray, ids: list[np.ndarray], cell: int) -> None:
        """x: unit keys of one cell, in order of ids.  Single precision tells what need not be computed in double."""
        reached, y = np.flatnonzero(np.unpackbits(self.can[:, cell], count=len(self.q))), x.astype(np.float32)
        for at in (reached[i : i + 256] for i in range(0, len(reached), 256)):
            low = (self.least[at] - self.room).astype(np.float32)
            found = np.flatnonzero(self.short[at] @ y.T >= low[:, None])
            if not len(found):
                continue
            row, col = np.divmod(found, len(y))
            many = np.bincount(row, minlength=len(at)) > self.k  # mostly equal ones, of which the first ids stay
            if many.any():
                top_ = [np.argsort(-np.round(x @ self.q[at[i]], DIGITS), kind="stable")[: self.k] for i in np.flatnonzero(many)]
                few = ~many[row]
                row = np.concatenate([row[few], np.repeat(np.flatnonzero(many), [len(z) for z in top_])])
                col = np.concatenate([col[few], *top_])
            qs, xs = self.q[at[row]], x[col]
            got = [at[row], np.round((qs * xs).sum(axis=1), DIGITS), *(z[col] for z in ids)]
            self.aside.append([*got, self.also(qs, xs)] if self.also else got)
            self.n -= len(row)
            if self.n < 0:
                self.settle()

    def settle(self) -> list[np.ndarray]:
        """Query, score, key ids, what `also` gives: best first."""
        if not self.aside:
            return []
        row, score, *rest = (np.concatenate(z) for z in zip(*self.aside, strict=True))
        ids = rest[:-1] if self.also else rest
        best = np.lexsort((*reversed(ids), -score, row))
        row = row[best]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        last = np.arange(len(row)) - first == self.k - 1
        out = [row[keep], *(z[best][keep] for z in (score, *rest))]
        self.least[row[last]] = np.maximum(self.least[row[last]], score[best][last])
        self.aside, self.n = [out], self.limit
        return out


def top(queries: DataFrame, keys: DataFrame, k: int, query_ids: list[str], key_ids: list[str], query_vec: str, key_vec: str, p: Params = Params(), also: tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None, by: list[str] | None = None) -> DataFrame:
    """query_ids, key_ids, coarse, rk: each query's k nearest keys, ties by key_ids.

    also: a further column of doubles and what gives it for rows of unit queries and of the unit keys found for them (0
    where all keys have length 0).  by: some of query_ids, by which the rows are partitioned for what comes next.
    """
    n = keys.count()
    cells = fitted(keys, key_ids, key_vec, n, p)
    if cells is None:  # nothing but keys of length 0, which all have cosine 0
        out = _all(queries, keys, k, query_ids, key_ids)
        return out.withColumn(also[0], F.lit(0.0)) if also else out
    # One partition, which every task reads from its beginning to its end and no task holds.
    blocks = packed(dealt(keys, key_ids, key_vec, cells, p), "cell", key_ids, "x", cells).repartition(1)
    held = asked(queries, query_ids, query_vec, cells, k, p)
    both = blocks.hint("shuffle_replicate_nl").join(held, F.array_contains("cells", F.col("cell"))).drop("cells")
    dim = cells.pivots.shape[1]
    out = [queries.schema[c] for c in query_ids] + [keys.schema[c] for c in key_ids] + [T.StructField("coarse", T.DoubleType())]
    schema = T.StructType(out + ([T.StructField(also[0], T.DoubleType())] if also else []))

    def run(batches: Iterator[pa.RecordBatch]):
        states: dict[int, Best] = {}
        matrix = lambda x: np.frombuffer(x.as_buffer(), float).reshape(-1, dim)
        for b in batches:
            for i in range(b.num_rows):
                block = b["block"][i].as_py()
                if block not in states:
                    q = matrix(b["q"][i]).copy()  # the batch goes
                    ids = [b[f"q{j}"][i].values.take(pa.array(np.arange(len(q)))) for j in range(len(query_ids))]
                    states[block] = Best(q, ids, cells, k, also and also[1])
                xs = [b[f"x{j}"][i].values.to_numpy(zero_copy_only=False) for j in range(len(key_ids))]
                states[block].meet(matrix(b["x"][i]), xs, b["cell"][i].as_py())
        for s in states.values():
            if got := s.settle():
                row, score, *rest = got
                cols = [c.take(pa.array(row)) for c in s.ids]
                cols += [pa.array(z, pa_type, from_pandas=True) for z, pa_type in zip(rest, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score), *(pa.array(z) for z in rest[len(kinds) :])], names=[f.name for f in schema])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(keys.schema[c].dataType) for c in key_ids]
    found = both.mapInArrow(run, schema)
    order = Window.partitionBy(*query_ids).orderBy(F.desc("coarse"), *key_ids)
    return (found.repartition(*by) if by else found).withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def _all(queries: DataFrame, keys: DataFrame, k: int, query_ids: list[str], key_ids: list[str]) -> DataFrame:
    """Every query with the first k keys, for keys without a length."""
    few = keys.select(*key_ids).orderBy(*key_ids).limit(k)
    order = Window.partitionBy(*query_ids).orderBy(F.desc("coarse"), *key_ids)
    return queries.select(*query_ids).join(F.broadcast(few)).withColumn("coarse", F.lit(0.0)).withColumn("rk", F.row_number().over(order))


def share_met(queries: DataFrame, keys: DataFrame, k: int, query_ids: list[str], key_ids: list[str], query_vec: str = "cls", key_vec: str = "cls", p: Params = Params()) -> float:
    """Of all pairs of a query and a key, those that are compared."""
    n = keys.count()
    cells = fitted(keys, key_ids, key_vec, n, p)
    if cells is None:
        return 0.0
    dealt(keys, key_ids, key_vec, cells, p)

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                x = units(whole[query_vec].slice(at, 512), len(whole[query_vec].slice(at, 512)))
                yield pa.RecordBatch.from_arrays([pa.array([int((cells.reach(x, cells.least(x, k)) * cells.n).sum())])], names=["met"])

    met = queries.select(query_vec).mapInArrow(run, "met long").agg(F.sum("met")).first()[0]
    return float((met or 0) / max(1, n * queries.count()))
