"""Byte-level BPE with chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes hits a pattern, so equal passages give equal chunks wherever
they stand.  A worker encodes each chunk once and keeps its ids (least recently added go first, within `cache_mb`).
Joins of chunks are then repaired: from the last place before the cut where the tokenizer must begin a new word to the
first one after it, the text is encoded again; the chunks' ids must end and begin exactly there, else the segment (a text
between special tokens) is encoded whole.  The result is that of encoding the whole text.

Cases: null and empty texts have no ids; very long texts are cut like others; special tokens' strings become their ids
and come back on decoding; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import mix64, small_batches

#: Fixed value: the published pattern by which byte-level BPE splits texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GEAR = mix64(np.arange(1, 257).astype(np.uint64)).astype(np.uint32)


@dataclass(frozen=True)
class Params:
    """path: a tokenizers JSON file of the byte-level kind; sizes in bytes; mask must be a power of two less one."""

    path: str
    least: int = 64
    mask: int = 511
    most: int = 8_192
    cache_mb: int = 64


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves, the
    others follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[chr(256 + i)] = b
    return out


def cut_points(b: np.ndarray, mask: int) -> np.ndarray:
    """Positions after which a chunk may end: the hash of the last 16 bytes hits, and a character begins."""
    h = GEAR[b]
    for n in (1, 2, 4, 8):
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    at = np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == mask) + 1
    at = at[at < len(b)]
    return at[(b[at] & 0xC0) != 0x80]


def word_starts(b: np.ndarray) -> np.ndarray:
    """Positions at which any byte-level tokenizer begins a new word: white space after a visible ASCII character."""
    white = (b == 32) | ((b >= 9) & (b <= 13))
    seen = (b > 32) & (b < 127)
    return np.flatnonzero(white[1:] & seen[:-1]) + 1


class Encoder:
    def __init__(self, p: Params):
        import tiktoken

        self.p = p
        with open(p.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        chars = byte_characters()
        self.bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.digits = [str(i).encode() for i in range(size)]
        # Ids are ranks of merges, so the two libraries agree; this one is several times faster on new words.
        ranks = {self.bytes[i]: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.lib = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, np.ndarray] = {}
        self.held = 0

    def _encode_all(self, parts: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.lib.encode_ordinary(x.decode()), np.int32) for x in parts]

    def _ensure(self, parts: set[bytes]) -> None:
        """Encodes what is not yet in the cache."""
        new = [x for x in parts if x not in self.cache]
        for x, ids in zip(new, self._encode_all(new), strict=True):
            self.cache[x] = ids
            self.held += len(x) + 4 * len(ids) + 300

    def _trim(self) -> None:
        while self.held > self.p.cache_mb * 1_000_000:
            x = next(iter(self.cache))
            self.held -= len(x) + 4 * len(self.cache.pop(x)) + 300

    def _segments(self, text: str) -> list[bytes | int]:
        """Parts between special tokens, and those tokens' ids."""
        out: list[bytes | int] = [text.encode()]
        for token, i in self.special.items():
            t, cutted = token.encode(), []
            for x in out:
                if isinstance(x, int) or t not in x:
                    cutted.append(x)
                    continue
                for k, y in enumerate(x.split(t)):
                    cutted += [i, y] if k else [y]
            out = cutted
        return [x for x in out if x != b""]

    def _plan(self, t: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Chunks of a segment, and the stretches around their joins that are encoded again."""
        b = np.frombuffer(t, np.uint8)
        chunks, start, n = [], 0, len(t)
        points = cut_points(b, self.p.mask).tolist()
        while n - start > self.p.least:
            k = bisect_left(points, start + self.p.least)
            end = points[k] if k < len(points) else n
            if end - start > self.p.most:
                end = start + self.p.most
                while end < n and t[end] & 0xC0 == 0x80:
                    end += 1
            chunks.append((start, end))
            start = end
        if start < n:
            chunks.append((start, n))
        starts = word_starts(b).tolist()
        joins: list[tuple[int, int]] = []
        for _, end in chunks[:-1]:
            k = bisect_right(starts, end)
            if k and starts[k - 1] == end:
                continue
            lo, hi = starts[k - 1] if k else 0, starts[k] if k < len(starts) else n
            if joins and lo < joins[-1][1]:
                lo, hi = joins[-1][0], max(hi, joins[-1][1])
                joins[-1] = (lo, hi)
            else:
                joins.append((lo, hi))
        return chunks, joins

    def _assemble(self, t: bytes, chunks: list[tuple[int, int]], joins: list[tuple[int, int]]) -> np.ndarray:
        out, j = [], 0
        for a, e in chunks:
            while j < len(joins) and joins[j][1] <= a:
                j += 1
            ids = self.cache[t[a:e]]
            ends = None
            lo = a
            k = j
            while lo < e:
                lo_join, hi_join = joins[k] if k < len(joins) else (e, e)
                if lo_join <= lo < hi_join:
                    # The stretch belongs to the chunk in which it begins.
                    if lo_join >= a:
                        out.append(self.cache[t[lo_join:hi_join]])
                    lo, k = hi_join, k + 1
                    continue
                hi = min(e, lo_join)
                if lo == a and hi == e:
                    out.append(ids)
                else:
                    ends = np.concatenate([[0], np.cumsum(self.sizes[ids])]) if ends is None else ends
                    x, y = np.searchsorted(ends, (lo - a, hi - a))
                    if ends[min(x, len(ids))] != lo - a or ends[min(y, len(ids))] != hi - a:
                        return self._encode_all([t])[0]  # no agreement short of the whole segment
                    out.append(ids[x:y])
                lo = hi
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        plans, wanted = [], set()
        for text in texts:
            row = []
            for x in self._segments(text or ""):
                if isinstance(x, int):
                    row.append(x)
                    continue
                chunks, joins = self._plan(x)
                wanted.update(x[a:e] for a, e in chunks)
                wanted.update(x[a:e] for a, e in joins)
                row.append((x, chunks, joins))
            plans.append(row)
        self._ensure(wanted)
        out = []
        for row in plans:
            parts = [np.array([x], np.int32) if isinstance(x, int) else self._assemble(*x) for x in row]
            out.append(np.concatenate(parts) if parts else np.empty(0, np.int32))
        self._trim()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[Params, Encoder] = {}


def encoder(p: Params) -> Encoder:
    """One encoder a worker, so chunks are shared by all the tasks that it runs."""
    if p not in _ENCODERS:
        _ENCODERS[p] = Encoder(p)
    return _ENCODERS[p]


def _mapped(docs: DataFrame, fields: list[T.StructField], row, p: Params, column: str, drop: bool) -> DataFrame:
    """docs with new columns; row(encoder, values) gives a list of Arrow arrays for a slice of the column."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if not (drop and f.name == column) and f.name not in {x.name for x in fields}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(p)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *row(enc, part[column].to_pylist())], names=[*names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*kept, *fields]))


def encode(docs: DataFrame, p: Params, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids; an existing column of that name is replaced."""
    return _mapped(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], lambda enc, v: [pa.array(enc.encode(v), pa.list_(pa.int32()))], p, text, False)


def decode(docs: DataFrame, p: Params, ids: str = "ids", out: str = "text") -> DataFrame:
    """docs with the text of a column of token ids (null: null)."""
    return _mapped(docs, [T.StructField(out, T.StringType())], lambda enc, v: [pa.array([None if x is None else enc.decode(x) for x in v], pa.string())], p, ids, False)


def digests(docs: DataFrame, p: Params, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256 of encoding it and decoding the ids."""

    def row(enc: Encoder, values: list) -> list[pa.Array]:
        n, a, d = [], [], []
        for ids in enc.encode(values):
            ids = ids.tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(b",".join(map(enc.digits.__getitem__, ids))).hexdigest())
            d.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, fields, row, p, text, True)


def encode_checked(docs: DataFrame, p: Params, text: str = "text") -> DataFrame:
    """docs without the text, with ids, n_tokens and round_trip: whether decoding the ids gives the text (null: empty)."""

    def row(enc: Encoder, values: list) -> list[pa.Array]:
        ids = enc.encode(values)
        same = [enc.decode(x.tolist()) == (v or "") for x, v in zip(ids, values, strict=True)]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same)]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return _mapped(docs, fields, row, p, text, True)
