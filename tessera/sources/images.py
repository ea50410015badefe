"""Images as files and as pixel tables.

PNG, baseline JPEG and binary PPM are built in, see png and jpeg; others, like WebP, need a decoder that is registered by
the bytes that files begin with.  Files are read by Spark's binary source, so from any store that Spark reaches, and decoded
where their partition is.  Null, empty and broken files give no pixels and a row of `inspected` that says why.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.validate import error_code, http_code, image_format
from tessera.sources import jpeg, png

Decoder = Callable[[bytes], np.ndarray]
DECODERS: dict[bytes, Decoder] = {}


def decode_ppm(data: bytes) -> np.ndarray:
    m = re.match(rb"P6\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data)
    if not m:
        raise ValueError("not a binary PPM of 8 bits")
    w, h = int(m[1]), int(m[2])
    return np.frombuffer(data, np.uint8, w * h * 3, m.end()).reshape(h, w, 3)


def encode_ppm(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


DECODERS[b"P6"] = decode_ppm
DECODERS[png.SIGNATURE] = png.decode
DECODERS[b"\xff\xd8\xff"] = jpeg.decode


def _decoded(data: bytes | None, decoders: dict[bytes, Decoder]) -> np.ndarray | None:
    """The image; None where no decoder takes it or the file is broken."""
    decode = next((f for magic, f in decoders.items() if data and data.startswith(magic)), None)
    try:
        return None if decode is None else decode(data)
    except (ValueError, IndexError, struct.error):
        return None


def register_decoder(magic: bytes, decode: Decoder) -> None:
    """decode is called in the workers for files that begin with magic."""
    DECODERS[magic] = decode


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content, fmt of the files under a folder; Spark's file sources leave out empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", image_format(F.col("content")).alias("fmt"))


def stream_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same for files as they land."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", image_format(F.col("content")).alias("fmt"))


def checked(files: DataFrame) -> DataFrame:
    """files with error_code and http_code of the tests that need no decoding."""
    unknown = F.lit(64)
    code = error_code(F.col("length"), F.col("fmt"), F.lit(3), unknown, unknown)
    return files.withColumn("error_code", code).withColumn("http_code", http_code(F.col("error_code")))


#: Content types of uploads that are taken.
CONTENT_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")


def land(uploads: DataFrame, folder: str) -> DataFrame:
    """Uploads (job_id, name, content_type, content) through the checks of type, size and format: those that pass are
    appended to a table of files by job in `folder`; returned are all, without contents, with error_code and http_code."""
    u = uploads.withColumns({"length": F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"), "fmt": image_format(F.col("content"))})
    bad_type = ~F.coalesce(F.lower("content_type"), F.lit("")).isin(*CONTENT_TYPES)
    u = checked(u).withColumn("error_code", F.when(bad_type, "format").otherwise(F.col("error_code")))
    u = u.withColumn("http_code", http_code(F.col("error_code")))
    passed = u.filter("error_code IS NULL").select("job_id", "name", "length", "fmt", "content")
    passed.write.mode("append").partitionBy("job_id").parquet(folder)
    return u.drop("content")


def pixels(files: DataFrame, rows: int = 65_536) -> DataFrame:
    """path, y, x, c, v of every pixel; files that no decoder takes give none."""

    decoders = dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                image = _decoded(data, decoders)
                if image is None:
                    continue
                y, x, c = (a.ravel() for a in np.indices(image.shape, np.int32))
                for at in range(0, image.size, rows):
                    s = slice(at, at + rows)
                    n = len(y[s])
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(y[s]), pa.array(x[s]), pa.array(c[s]), pa.array(image.ravel()[s].astype(np.int32))], names=["path", "y", "x", "c", "v"])

    return files.select("path", "content").mapInArrow(run, "path string, y int, x int, c int, v int")


def inspected(files: DataFrame) -> DataFrame:
    """path, length, fmt, height, width, channels, error_code, http_code: every file decoded, its size null where that
    fails, and all tests of an upload."""
    decoders = dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            shapes = []
            for data in b["content"].to_pylist():
                image = _decoded(data, decoders)
                shapes.append((None, None, None) if image is None else image.shape)
            h, w, c = (pa.array([s[i] for s in shapes], pa.int32()) for i in range(3))
            yield pa.RecordBatch.from_arrays([b["path"], b["length"], b["fmt"], h, w, c], names=["path", "length", "fmt", "height", "width", "channels"])

    u = files.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("length"), image_format(F.col("content")).alias("fmt"), "content")
    u = u.mapInArrow(run, "path string, length long, fmt string, height int, width int, channels int")
    u = u.withColumn("error_code", error_code(F.col("length"), F.col("fmt"), F.col("channels"), F.col("height"), F.col("width")))
    return u.withColumn("http_code", http_code(F.col("error_code")))


#: By format: what makes a file of an image and a quality.
ENCODERS = {"png": lambda image, quality: png.encode(image), "jpeg": lambda image, quality: jpeg.encode(image, quality), "ppm": lambda image, quality: encode_ppm(image)}


def encoded(pixels: DataFrame, fmt: str = "jpeg", quality: int = 92) -> DataFrame:
    """path, content: a file for each image of a pixel table (path, y, x, c, v); places without a pixel are 0.

    An image is one group, as is its file."""
    encode = ENCODERS[fmt]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((p.y.max() + 1, p.x.max() + 1, 3), np.uint8)
        image[p.y, p.x, p.c] = p.v.clip(0, 255)
        return pd.DataFrame({"path": [key[0]], "content": [encode(image, quality)]})

    return pixels.select("path", "y", "x", "c", "v").groupBy("path").applyInPandas(run, "path string, content binary")
