"""Coarse and fine matching of vectors and token sets.

Vectors of a table have one length and no null components; vectors of length 0 have cosine 0 with all; equal scores are
ordered by ids; repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vector import dot, norm, shift, unit
from tessera.operators import pivots


def top_cosine(queries: DataFrame, keys: DataFrame, k: int, query_ids: list[str], key_ids: list[str], query_vec: str = "cls", key_vec: str = "cls", block: int | None = None, p: pivots.Params = pivots.Params(), fine: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Each query's k nearest keys by cosine: query_ids, key_ids, coarse, rk; ties by key_ids.

    Queries meet the cells of keys that their bounds leave, see pivots; block: keys of a block, if not p's.  Vectors of
    length 0 have cosine 0.  fine: size of a token, for max_sim() of the pairs found, taken where their vectors meet, so
    that none are joined to pairs.  by: some of query_ids, by which the rows are partitioned for what comes next.
    """
    p = p if block is None else replace(p, block=block, least_block=min(block, p.least_block))
    also = None if fine is None else ("fine", partial(max_sims, size=fine))
    return pivots.top(queries, keys, k, query_ids, key_ids, query_vec, key_vec, p, also, by)


def max_sims(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """max_sim() of rows of vectors, whose tokens are consecutive slices of `size`."""

    def cut(v: np.ndarray) -> np.ndarray:
        t = v[:, : v.shape[1] // size * size].reshape(len(v), -1, size)
        n = np.linalg.norm(t, axis=2, keepdims=True)
        return t / np.where(n > 0, n, 1.0)

    if x.shape[1] < size:
        return np.full(len(x), np.nan)
    return np.clip(np.matmul(cut(x), cut(y).transpose(0, 2, 1)).max(axis=2).mean(axis=1), 0.0, 1.0)


def rotations(pieces: DataFrame, vec: str = "cls") -> DataFrame:
    """Four rows a piece: rot in degrees, vector shifted by a quarter of its length a step."""
    turns = F.explode(F.array(*[F.lit(r).cast("long") for r in (0, 90, 180, 270)]))
    return pieces.withColumn("rot", turns).withColumn(vec, shift(F.col(vec), F.col("rot") / 90 * F.size(vec) / 4))


def tokens(df: DataFrame, ids: list[str], vec: str = "cls", size: int = 8) -> DataFrame:
    """Consecutive slices of a vector as its token set: ids, tok, vec."""
    n = F.floor(F.size(vec) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(F.col(vec), t * size + 1, size))
    return df.select(*ids, F.posexplode(parts).alias("tok", "vec")).withColumn("tok", F.col("tok").cast("long"))


def normalised(token_rows: DataFrame) -> DataFrame:
    return token_rows.withColumn("vec", unit(F.col("vec")))


def mean_pool(token_rows: DataFrame, ids: list[str]) -> DataFrame:
    """Mean of a set's tokens, made unit length: ids, dim, val."""
    mean = token_rows.select(*ids, F.posexplode("vec").alias("dim", "x")).groupBy(*ids, "dim").agg(F.avg("x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*ids)))
    return mean.withColumn("val", F.when(length > 0, F.col("x") / length).otherwise(F.col("x"))).drop("x").withColumn("dim", F.col("dim").cast("long"))


def max_sim(pairs: DataFrame, left: DataFrame, right: DataFrame, left_ids: list[str], right_ids: list[str]) -> DataFrame:
    """pairs with `fine`: mean over the left set's tokens of the largest cosine with a token of the right set, in [0, 1].

    Token sets are gathered once a side and meet only for the shortlisted pairs; a batch of pairs is one product of
    matrices.  A side's sets hold the same number of tokens, of the same length.  Pairs without a token set give no row.
    """

    def gathered(df: DataFrame, ids: list[str], name: str) -> DataFrame:
        return normalised(df).groupBy(*ids).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tok", "vec"))), lambda s: s["vec"])).alias(name), F.max(F.size("vec")).alias(f"{name}dim"))

    joined = pairs.join(gathered(left, left_ids, "l_"), left_ids).join(gathered(right, right_ids, "r_").drop("r_dim"), right_ids)
    kept = [f for f in joined.schema.fields if f.name not in ("l_", "l_dim", "r_")]
    schema = T.StructType([*kept, T.StructField("fine", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            dim = b["l_dim"][0].as_py()
            x, y = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1, dim) for c in ("l_", "r_"))
            fine = np.clip(np.matmul(x, y.transpose(0, 2, 1)).max(axis=2).mean(axis=1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), pa.array(fine)], names=[*(f.name for f in kept), "fine"])

    return joined.mapInArrow(run, schema)


def token_windows(n_rows: int | Column, n_cols: int | Column, height: int | Column, width: int | Column, df: DataFrame) -> DataFrame:
    """row, col, r0, r1, c0, c1: token ranges of each cell with an overlap of a tenth; df is the frame of row, col."""
    def ends(i, n: int | Column, size: int | Column):
        size = size if isinstance(size, Column) else F.lit(size)
        step = size / n
        over = F.greatest(F.lit(1), F.floor(step * 0.10))
        lo = F.greatest(F.lit(0), F.floor(i * step) - over)
        return lo.cast("long"), F.least(size, F.floor((i + 1) * step) + over).cast("long")

    (r0, r1), (c0, c1) = ends(F.col("row"), n_rows, height), ends(F.col("col"), n_cols, width)
    return df.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1})


def pca(df: DataFrame, vec: str, k: int):
    """Fitted (mean, components) of at most k principal axes; the covariance is summed on the executors."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    from pyspark.ml.feature import PCA

    v = df.select(array_to_vector(vec).alias("v"))
    mean = v.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    model = PCA(k=min(k, len(mean)), inputCol="v", outputCol="p").fit(v)
    return mean, model.pc.toArray()


def project(df: DataFrame, vec: str, mean: np.ndarray, components: np.ndarray, out: str = "reduced") -> DataFrame:
    """Vectors less the mean, on the components: expressions only."""
    centred = F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    axes = [F.array(*[F.lit(float(x)) for x in components[:, j]]) for j in range(components.shape[1])]
    return df.withColumn("c_", centred).withColumn(out, F.array(*[dot(F.col("c_"), a) for a in axes])).drop("c_")


def save_pca(spark: SparkSession, mean: np.ndarray, components: np.ndarray, path: str) -> None:
    """Writes a fitted model as a table of one row an axis, the mean first."""
    rows = [(-1, mean.tolist())] + [(j, components[:, j].tolist()) for j in range(components.shape[1])]
    spark.createDataFrame(rows, "axis int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_pca(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, components) of a saved model; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path).orderBy("axis").collect()  # one row an axis
    except AnalysisException:
        return None
    return np.array(rows[0]["weights"]), np.array([r["weights"] for r in rows[1:]]).T.reshape(len(rows[0]["weights"]), len(rows) - 1)


def cell_vectors(token_grid: DataFrame, cells: DataFrame, n_rows: int, n_cols: int, shape: DataFrame, mean: np.ndarray | None = None, components: np.ndarray | None = None) -> DataFrame:
    """row, col, n_tokens, cls of each cell: the mean of the unit tokens in its window, made unit length.

    token_grid: y, x, v; shape: one row of n_rows, n_cols of that grid; with a model, tokens are projected first.  A token
    is sent to the cells whose windows hold it, four at most.
    """
    t = token_grid if components is None else project(token_grid, "v", mean, components, "v")
    t = t.join(F.broadcast(shape.select(F.col("n_rows").alias("h"), F.col("n_cols").alias("w"))))
    windows = cells.select("row", "col").join(F.broadcast(shape.select(F.col("n_rows").alias("h"), F.col("n_cols").alias("w"))))
    windows = token_windows(n_rows, n_cols, F.col("h"), F.col("w"), windows)
    at = windows.select("row", "col", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("y"), "c0", "c1").select("row", "col", "y", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("x"))
    each = t.select("y", "x", F.posexplode(unit(F.col("v"))).alias("dim", "e")).join(at, ["y", "x"])
    sums = each.groupBy("row", "col", "dim").agg(F.avg("e").alias("e"), F.count("*").alias("n"))
    out = sums.groupBy("row", "col").agg(F.max("n").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "e"))), lambda s: s["e"]).alias("cls"))
    return out.withColumn("cls", unit(F.col("cls")))


__all__ = ["cell_vectors", "dot", "load_pca", "max_sim", "mean_pool", "norm", "normalised", "pca", "project", "rotations", "save_pca", "token_windows", "tokens", "top_cosine"]
