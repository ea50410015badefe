"""Model outputs behind an interface: segmentation masks and patch tokens.

A provider is loaded once a worker and maps images to rows.  No weights come with this package; `BlockTokens` stands in
for a vision model where none is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import kernels


class TokenProvider(Protocol):
    dim: int

    def tokens(self, image: np.ndarray) -> np.ndarray:
        """(rows, cols, dim) tokens of an image."""


class MaskProvider(Protocol):
    def masks(self, image: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """(mask, confidence) of each part of an image; a mask is as large as the image."""


class ThresholdMasks:
    """Stands in for a segmentation model: 8-connected regions that are brighter than the image's mean, of `least` pixels
    or more; the confidence is the share of a region in its bounding box."""

    def __init__(self, least: int = 4):
        self.least = least

    def masks(self, image: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        gray = image.reshape(*image.shape[:2], -1).mean(axis=2)
        labels = kernels.labelled(gray > gray.mean())
        for i in range(1, labels.max() + 1):
            m = labels == i
            y, x = np.nonzero(m)
            if len(y) >= self.least:
                yield m, len(y) / ((np.ptp(y) + 1) * (np.ptp(x) + 1))


class BlockTokens:
    """Mean colours of a grid of blocks, repeated to `dim` and centred."""

    def __init__(self, side: int = 4, dim: int = 12):
        self.side, self.dim = side, dim

    def tokens(self, image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        rows, cols = np.array_split(np.arange(h), self.side), np.array_split(np.arange(w), self.side)
        mean = np.array([[image[np.ix_(r, c)].reshape(-1, image.shape[2]).mean(axis=0) if len(r) and len(c) else np.zeros(image.shape[2]) for c in cols] for r in rows])
        return np.resize(np.tile(mean / 127.5 - 1, -(-self.dim // image.shape[2])), (self.side, self.side, self.dim))


_LOADED: dict = {}


def _model(kind: str, make):
    """One model a worker, made when its first image comes."""
    if kind not in _LOADED:
        _LOADED[kind] = make()
    return _LOADED[kind]


def segment(files: DataFrame, make, decode) -> DataFrame:
    """path, mask_id (from 0 within an image), row, col, confidence: a row for each place of a mask; make() builds the
    provider, decode reads bytes.  Null contents give no rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        model = _model("masks", make)
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                for i, (m, confidence) in enumerate(model.masks(decode(data)) if data else ()):
                    y, x = np.nonzero(m)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(y)), pa.array(np.full(len(y), i, np.int32)), pa.array(y.astype(np.int64)), pa.array(x.astype(np.int64)), pa.array(np.full(len(y), float(confidence)))], names=["path", "mask_id", "row", "col", "confidence"])

    return files.select("path", "content").mapInArrow(run, "path string, mask_id int, row long, col long, confidence double")


def embed(files: DataFrame, make, decode) -> DataFrame:
    """path, rot, tok, vec of each image in its four orientations; make() builds the provider, decode reads bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        model = _model("tokens", make)
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                image = decode(data)
                for k in range(4):
                    t = model.tokens(np.rot90(image, k)).reshape(-1, model.dim)
                    n = len(t)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([90 * k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(t.astype(float)), pa.list_(pa.float64()))], names=["path", "rot", "tok", "vec"])

    return files.select("path", "content").mapInArrow(run, "path string, rot int, tok int, vec array<double>")
