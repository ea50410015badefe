"""The chain from images to vectors against NumPy; distances against the kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.providers import BlockTokens
from tessera.operators import raster
from tessera.operators.chain import Chain
from tessera.sources import images, png


def unit(x):
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def test_images_to_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    pictures = {f"p{i}": rng.integers(0, 256, (20 + i, 24, 3)).astype(np.uint8) for i in range(4)}
    files = spark.createDataFrame([(k, png.encode(x)) for k, x in pictures.items()] + [("none", None)], "path string, content binary")
    tokens = {(k, 90 * r): BlockTokens().tokens(np.rot90(x, r)).reshape(-1, 12) for k, x in pictures.items() for r in range(4)}
    off = Chain(BlockTokens, png.decode)
    got = {(r["path"], r["rot"]): np.array(r["cls"]) for r in off.fit(files).vectors(files).collect()}
    assert set(got) == set(tokens) and all(np.allclose(got[k], unit(unit(t).mean(axis=0))) for k, t in tokens.items())

    on = Chain(BlockTokens, png.decode, k=3)
    for early in (lambda: on.vectors(files), lambda: on.save(spark, str(tmp_path / "m")), lambda: on.cells(files, files, 1, 1, files)):
        with pytest.raises(RuntimeError):
            early()
    on.fit(files)
    every = np.concatenate(list(tokens.values()))
    axes = np.linalg.svd(every - every.mean(axis=0), full_matrices=False)[2][:3]
    want = {k: unit(unit((t - every.mean(axis=0)) @ axes.T).mean(axis=0)) for k, t in tokens.items()}
    got = {(r["path"], r["rot"]): np.array(r["cls"]) for r in on.vectors(files).collect()}
    names = sorted(want)
    a, b = (np.array([x[k] for k in names]) for x in (got, want))
    assert np.allclose(a @ a.T, b @ b.T) and a.shape[1] == 3  # the axes' signs are free

    on.save(spark, str(tmp_path / "m"))
    again = Chain(BlockTokens, png.decode, k=3)
    assert again.load(spark, str(tmp_path / "m")) and not Chain(BlockTokens, png.decode).load(spark, str(tmp_path / "no"))
    same = {(r["path"], r["rot"]): np.array(r["cls"]) for r in again.vectors(files).collect()}
    assert all(np.allclose(same[k], got[k]) for k in got)
    with pytest.raises(ValueError):
        again.reduced(spark.createDataFrame([("p", 0, 0, [1.0, 2.0])], "path string, rot int, tok int, vec array<double>"))
    grid = spark.createDataFrame([(y, x, rng.standard_normal(12).tolist()) for y in range(4) for x in range(4)], "y long, x long, v array<double>")
    cells = spark.createDataFrame([(r, c) for r in range(2) for c in range(2)], "row long, col long")
    out = again.cells(grid, cells, 2, 2, spark.createDataFrame([(4, 4)], "n_rows long, n_cols long")).collect()
    assert len(out) == 4 and all(len(r["cls"]) == 3 and abs(np.linalg.norm(r["cls"]) - 1) < 1e-9 for r in out)
    assert off.vectors(files.limit(0)).count() == 0


def test_inner_distances(spark):
    rng = np.random.default_rng(3)
    masks = {i: rng.random((11, 14)) < p for i, p in enumerate((0.5, 0.85, 0.97, 1.0))}
    rows = [(i, r, c) for i, m in masks.items() for r, c in np.argwhere(m).tolist()]
    got = raster.inner_distance(spark.createDataFrame(rows + rows[:5] + [(0, None, 1), (None, 1, 1)], "image long, row long, col long")).collect()
    want = {i: kernels.inner_distance(m) for i, m in masks.items()}
    assert len(got) == len(rows) and all(want[r["image"]][r["row"], r["col"]] == r["distance"] for r in got)
