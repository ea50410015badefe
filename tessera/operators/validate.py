"""Checks of uploaded files as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MIN_SIDE, MAX_SIDE = 50 * 1024 * 1024, 64, 16_000
HTTP = {"job_not_found": 404, "conflict": 409, "not_implemented": 501, "pipeline": 500}


def image_format(content: Column) -> Column:
    """jpeg, png or webp by the first bytes of a binary column; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")


def error_code(size: Column, fmt: Column, channels: Column, height: Column, width: Column) -> Column:
    """The first test that fails, null for a valid image; unknown dimensions mean that decoding failed."""
    side_lo, side_hi = F.least(height, width), F.greatest(height, width)
    return (
        F.when(size == 0, "empty").when(size > MAX_BYTES, "too_large").when(fmt.isNull(), "format")
        .when(height.isNull() | width.isNull(), "decode").when(channels != 3, "channels")
        .when(side_lo < MIN_SIDE, "too_small").when(side_hi > MAX_SIDE, "too_wide")
    )


def http_code(error: Column) -> Column:
    """422 for a failed test, or the code of a named error; 200 without one."""
    out = F.when(error.isNull(), 200)
    for name, code in HTTP.items():
        out = out.when(error == name, code)
    return out.otherwise(422).cast("long")


ALLOWED = (".jpg", ".jpeg", ".png", ".json", ".webp")


def guarded(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with allowed and reason (traversal, extension, ok): no segment may lead upwards or to the root."""
    p = F.col(path)
    segments = F.split(F.translate(p, "\\", "/"), "/")
    bad = F.exists(segments, lambda s: s == "..") | p.startswith("/") | p.contains("\x00") | p.rlike(r"^[A-Za-z]:")
    name = F.element_at(segments, -1)
    ext = F.lower(F.when(F.instr(F.substring(name, 2, 1_000_000), ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(""))
    reason = F.when(bad, "traversal").when(~ext.isin(*ALLOWED), "extension").otherwise("ok")
    return paths.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok")


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of a manifest that no file has."""
    return wanted.join(files, "path", "left_anti")
