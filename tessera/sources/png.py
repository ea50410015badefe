"""PNG files as arrays of red, green, blue: the five row filters, all bit depths and colour types, interlaced or not.

Transparency is left out; depths of 16 keep their upper half.  Anything broken (signature, checksum, missing or short
data) is a ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Interlacing: first row, first column, row step and column step of each pass.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def chunks(data: bytes):
    """(kind, content) of each chunk up to the end."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("broken chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def header(data: bytes) -> tuple[int, int, int, int, int]:
    """Width, height, depth, colour type, interlacing."""
    kind, body = next(chunks(data[:33]), (b"", b""))
    if kind != b"IHDR" or len(body) != 13:
        raise ValueError("no header")
    w, h, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", body)
    if not w or not h or depth not in DEPTHS.get(colour, ()) or packing or filtering or interlaced > 1:
        raise ValueError("unknown header")
    return w, h, depth, colour, interlaced


def unfiltered(raw: np.ndarray, height: int, line: int, step: int) -> np.ndarray:
    """Rows of bytes from filtered ones, each led by the number of its filter; step: bytes of a pixel."""
    rows = raw.reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        kind, x, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            new = x
        elif kind == 1:
            wide = np.concatenate([x, np.zeros(-line % step, np.uint8)]).reshape(-1, step)
            new = np.cumsum(wide, axis=0, dtype=np.uint8).ravel()[:line]
        elif kind == 2:
            new = x + up
        elif kind in (3, 4):
            new = bytearray(line)
            value, above = x.tolist(), up.tolist()
            for i in range(line):
                a, c = (new[i - step], above[i - step]) if i >= step else (0, 0)
                b = above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                new[i] = (value[i] + guess) & 255
            new = np.frombuffer(bytes(new), np.uint8)
        else:
            raise ValueError("unknown filter")
        out[y + 1] = new
    return out[1:]


def samples(rows: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    """height x width x n samples from rows of bytes."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    return rows[:, : width * n].reshape(len(rows), width, n)


def decode(data: bytes) -> np.ndarray:
    """height x width x 3."""
    w, h, depth, colour, interlaced = header(data)
    palette, packed = None, []
    for kind, body in chunks(data):
        if kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if len(body) % 3 == 0 else None
        elif kind == b"IDAT":
            packed.append(body)
    n, bits = SAMPLES[colour], SAMPLES[colour] * depth
    passes = [(r, c, dr, dc) for r, c, dr, dc in PASSES if r < h and c < w] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(h - r) // dr), -(-(w - c) // dc)) for r, c, dr, dc in passes]
    want = sum(hh * (-(-ww * bits // 8) + 1) for hh, ww in sizes)
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), want), np.uint8)
    except zlib.error as e:
        raise ValueError("broken data") from e
    if len(raw) != want:
        raise ValueError("short data")
    out, at = np.zeros((h, w, n), np.uint8), 0
    for (r, c, dr, dc), (hh, ww) in zip(passes, sizes, strict=True):
        line = -(-ww * bits // 8)
        part = unfiltered(raw[at : at + hh * (line + 1)], hh, line, max(1, bits // 8))
        out[r::dr, c::dc] = samples(part, ww, n, depth)
        at += hh * (line + 1)
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("no such colour")
        return palette[out[:, :, 0]]
    if colour in (0, 4):
        gray = out[:, :, :1] if depth >= 8 else (out[:, :, :1].astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        return np.repeat(gray, 3, axis=2)
    return out[:, :, :3]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit file of a height x width x 3 array; each row takes the filter, of none, left and up, with the least sum."""
    h, w = image.shape[:2]
    x = np.ascontiguousarray(image, np.uint8).reshape(h, w * 3)
    left, up = x.copy(), x.copy()
    left[:, 3:] -= x[:, :-3]
    up[1:] -= x[:-1]
    ways = np.stack([x, left, up])
    best = np.minimum(ways, 0 - ways).sum(axis=2, dtype=np.int64).argmin(axis=0)
    rows = np.concatenate([best.astype(np.uint8)[:, None], ways[best, np.arange(h)]], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")
