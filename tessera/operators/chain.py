"""Images to vectors: tokens of a provider, reduced by fitted axes, unit lengths, and their mean as the image's vector.

The reduction is one stage of the chain: on with `k` axes, fitted once on tokens and saved as a table, or off, when tokens
pass as they are.  Asking for vectors before a fit is an error, as is a model that does not suit the tokens.  Images that
give no tokens give no vector; a token of length 0 stays 0; repeated images are images of their own by path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.providers import embed
from tessera.functions.vector import unit
from tessera.operators import vectors


@dataclass
class Chain:
    """make builds the token provider in a worker, decode reads bytes; k: axes of the reduction, None for none."""

    make: object
    decode: object
    k: int | None = None
    mean: np.ndarray | None = field(default=None, repr=False)
    axes: np.ndarray | None = field(default=None, repr=False)

    def tokens(self, files: DataFrame) -> DataFrame:
        """path, rot, tok, vec in the images' four orientations, not reduced."""
        return embed(files.filter("content IS NOT NULL"), self.make, self.decode)

    def fit(self, files: DataFrame) -> Chain:
        """Axes of all tokens of files; nothing to do where the reduction is off."""
        if self.k is not None:
            self.mean, self.axes = vectors.pca(self.tokens(files), "vec", self.k)
        return self

    def reduced(self, tokens: DataFrame) -> DataFrame:
        """Tokens on the fitted axes, of unit length."""
        if self.k is not None:
            if self.axes is None:
                raise RuntimeError("the axes have not been fitted or loaded")
            size = tokens.select(F.size("vec").alias("n")).limit(1).collect()
            if size and size[0]["n"] != len(self.mean):
                raise ValueError(f"tokens of {size[0]['n']} components, a model of {len(self.mean)}")
            tokens = vectors.project(tokens, "vec", self.mean, self.axes, "vec")
        return tokens.withColumn("vec", unit(F.col("vec")))

    def vectors(self, files: DataFrame) -> DataFrame:
        """path, rot, cls: the mean of an image's tokens, made unit length."""
        each = self.reduced(self.tokens(files)).select("path", "rot", F.posexplode("vec").alias("dim", "x"))
        mean = each.groupBy("path", "rot", "dim").agg(F.avg("x").alias("x")).groupBy("path", "rot")
        return mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("cls")).withColumn("cls", unit(F.col("cls")))

    def cells(self, token_grid: DataFrame, cells: DataFrame, n_rows: int, n_cols: int, shape: DataFrame) -> DataFrame:
        """row, col, n_tokens, cls of a reference image's cells, reduced by the same axes; token_grid: y, x, v."""
        if self.k is not None and self.axes is None:
            raise RuntimeError("the axes have not been fitted or loaded")
        on = (self.mean, self.axes) if self.k is not None else (None, None)
        return vectors.cell_vectors(token_grid, cells, n_rows, n_cols, shape, *on)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.axes is None:
            raise RuntimeError("nothing has been fitted")
        vectors.save_pca(spark, self.mean, self.axes, path)

    def load(self, spark: SparkSession, path: str) -> bool:
        """Whether a model was there; it replaces the fitted one."""
        found = vectors.load_pca(spark, path)
        if found is not None:
            self.mean, self.axes = found
            self.k = self.axes.shape[1]
        return found is not None
