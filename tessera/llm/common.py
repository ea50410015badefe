"""Shared helpers: words, tables, hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same for str.translate and bytes.translate.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bounds the Arrow batches that carry texts to and from Python by their bytes, unless the session has a lower bound.
    Plans take the limit when they run, so it stays; it changes no result, and batches of numbers hardly reach it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= megabytes << 20:
        spark.conf.set(key, f"{megabytes}m")


def _bytes(size: str) -> int:
    """A size as Spark's settings write it."""
    n, unit = size.strip().lower().removesuffix("b"), 0
    if n[-1:] in "kmgt":
        n, unit = n[:-1], 1 + "kmgt".index(n[-1])
    return int(n) << 10 * unit


def n_words(text: Column) -> Column:
    """Number of words, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
