"""Baseline JPEG files as arrays of red, green, blue, and back.

Read: sequential Huffman coding of 8 bits, one or three components, any sampling, restarts.  Written: three components,
colours at full or half resolution, Huffman codes made for the image.  Progressive and arithmetic coding are a ValueError,
as is anything broken.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

#: Place of the k-th coefficient: along the antidiagonals, every other one upwards.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))]
#: Rows are the cosines of each frequency.
COSINES = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def segments(data: bytes):
    """(marker, content, where the next one begins) up to the start of the scan."""
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("not a JPEG")
    at = 2
    while True:
        while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("truncated")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if at + 2 + size > len(data) or size < 2:
            raise ValueError("truncated segment")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


def frame(body: bytes) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """Height, width, and (id, horizontal and vertical sampling, table) of the components."""
    if len(body) < 6 or len(body) != 6 + 3 * body[5]:
        raise ValueError("broken frame")
    depth, h, w, n = struct.unpack_from(">BHHB", body)
    parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if depth != 8 or not h or not w or n not in (1, 3) or any(not 1 <= s <= 4 for p in parts for s in p[1:3]):
        raise ValueError("unknown frame")
    return h, w, parts


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and components, from whatever kind of frame there is."""
    for marker, body, _ in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(body) < 6:
                raise ValueError("broken frame")
            _, h, w, n = struct.unpack_from(">BHHB", body)
            return w, h, n
    raise ValueError("no frame")


def lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """By the next 16 bits: (length, symbol); length 0 where no code begins so."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            first, last = code << (16 - size), (code + 1) << (16 - size)
            if last > 65536 or k >= len(symbols):
                raise ValueError("broken code")
            out[first:last] = [(size, symbols[k])] * (last - first)
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    """Reads a stretch between restarts; behind its end there are ones, as the standard has it, up to a block's worth."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek(self) -> int:
        if self.n < 16:
            more = self.data[self.at : self.at + 32]
            self.at += 32
            if self.at > len(self.data) + 96:
                raise ValueError("scan ends early")
            more += b"\xff" * (32 - len(more))
            self.bits = (self.bits << 256) | int.from_bytes(more)
            self.n += 256
        return (self.bits >> (self.n - 16)) & 0xFFFF

    def skip(self, n: int) -> None:
        self.n -= n
        self.bits &= (1 << self.n) - 1

    def number(self, size: int) -> int:
        """A signed value of `size` bits: those that begin with 0 are negative."""
        if not size:
            return 0
        x = self.peek() >> (16 - size)
        self.skip(size)
        return x if x >> (size - 1) else x - (1 << size) + 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        size, symbol = table[self.peek()]
        if not size:
            raise ValueError("no such code")
        self.skip(size)
        return symbol


def block(bits: Bits, dc: list, ac: list, before: int, out: np.ndarray) -> int:
    """Reads 64 coefficients into out, in the order of the file; returns the first one's level."""
    level = before + bits.number(bits.symbol(dc))
    out[0], k = level, 1
    while k < 64:
        x = bits.symbol(ac)
        run, size = x >> 4, x & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("too many coefficients")
        out[k] = bits.number(size)
        k += 1
    return level


def stretches(data: bytes, at: int) -> list[bytes]:
    """The scan from `at` on, cut at restarts."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no end of scan")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            at = begin = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, data[begin:at]]


def decode(data: bytes) -> np.ndarray:
    """height x width x 3."""
    tables, codes, every, shape, scan, begin = {}, {}, 0, None, b"", 0
    for marker, body, end in segments(data):
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 64 << wide
                if len(body) < 1 + size:
                    raise ValueError("broken table")
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("broken code")
                codes[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            shape = frame(body)
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0] if len(body) == 2 else 0
        elif marker == 0xDA:
            scan, begin = body, end
    if shape is None or not scan or scan[0] != len(shape[2]):
        raise ValueError("no frame or a partial scan")
    h, w, parts = shape
    by_id = {scan[1 + 2 * i]: scan[2 + 2 * i] for i in range(scan[0])}
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, across, down = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    wide, high = -(-w // (8 * across)), -(-h // (8 * down))
    try:
        use = [(codes[by_id[i] >> 4], codes[16 + (by_id[i] & 15)], tables[t]) for i, _, _, t in parts]
    except KeyError as e:
        raise ValueError("missing table") from e
    planes = [np.zeros((high * v, wide * u, 64)) for _, u, v, _ in parts]
    units, todo = wide * high, iter(stretches(data, begin))
    for first in range(0, units, every or units):
        bits = Bits(next(todo, b""))
        level = [0] * len(parts)
        for m in range(first, min(units, first + (every or units))):
            row, col = divmod(m, wide)
            for i, (_, u, v, _) in enumerate(parts):
                for y in range(v):
                    for x in range(u):
                        level[i] = block(bits, use[i][0], use[i][1], level[i], planes[i][row * v + y, col * u + x])
    out = []
    for plane, (_, u, v, _), (_, _, table) in zip(planes, parts, use, strict=True):
        square = np.zeros_like(plane)
        square[:, :, ZIGZAG] = plane * table
        square = COSINES.T @ square.reshape(*plane.shape[:2], 8, 8) @ COSINES + 128
        flat = square.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        out.append(np.repeat(np.repeat(flat, down // v, axis=0), across // u, axis=1)[:h, :w])
    if len(out) == 1:
        rgb = [out[0]] * 3
    else:
        y, cb, cr = out[0], out[1] - 128, out[2] - 128
        rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.round(np.stack(rgb, axis=2)), 0, 255).astype(np.uint8)


# -- Writing --------------------------------------------------------------------------------------------------------


def steps(quality: int) -> np.ndarray:
    """Quantisation by a rule: coarser with the frequency; 100 keeps every level."""
    scale = (100 - quality) / 50
    u = np.arange(8)
    return np.clip(np.round(1 + scale * (6 + 5 * (u[:, None] + u[None, :]))), 1, 255).astype(int)


def code_lengths(freq: Counter) -> dict[int, int]:
    """Huffman code lengths of 16 bits at most; one code of the longest is left free, so that none is all ones."""
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(freq.items()))] + [(0, -1, (-1,))]
        heapq.heapify(heap)
        size = dict.fromkeys([*freq, -1], 0)
        tie = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                size[s] += 1
            heapq.heappush(heap, (a + b, tie, x + y))
            tie += 1
        if max(size.values()) <= 16:
            return {s: n for s, n in size.items() if s >= 0}
        freq = Counter({s: n // 2 + 1 for s, n in freq.items()})


def codes_of(size: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table's segment and (code, length) by symbol."""
    order = sorted(size, key=lambda s: (size[s], s))
    out, code, last = {}, 0, 0
    for s in order:
        code <<= size[s] - last
        last = size[s]
        out[s] = code, last
        code += 1
    counts = Counter(size.values())
    return bytes(counts[i] for i in range(1, 17)) + bytes(order), out


def _symbols(levels: np.ndarray, before: int) -> list[tuple[int, int, int, int]]:
    """(0 for the first coefficient or 1, symbol, extra bits, their number) of a block in the order of the file."""
    def extra(x: int) -> tuple[int, int]:
        size = int(abs(x)).bit_length()
        return (x if x > 0 else x + (1 << size) - 1), size

    bits, size = extra(int(levels[0]) - before)
    out, last = [(0, size, bits, size)], 0
    for k in np.flatnonzero(levels[1:]) + 1:
        run = int(k) - last - 1
        out += [(1, 0xF0, 0, 0)] * (run // 16)
        bits, size = extra(int(levels[k]))
        out.append((1, (run % 16) << 4 | size, bits, size))
        last = int(k)
    return out if last == 63 else [*out, (1, 0, 0, 0)]


def encode(image: np.ndarray, quality: int = 92, half: bool = False) -> bytes:
    """A baseline file of a height x width x 3 array; half: colours at half the resolution."""
    h, w = image.shape[:2]
    side = 16 if half else 8
    x = np.pad(np.asarray(image, float), ((0, -h % side), (0, -w % side), (0, 0)), mode="edge")
    r, g, b = x[:, :, 0], x[:, :, 1], x[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    if half:
        planes[1:] = [p.reshape(p.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)) for p in planes[1:]]
    table = steps(quality)
    blocks = []
    for p in planes:
        sq = (p - 128).reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        levels = np.round(COSINES @ sq @ COSINES.T / table).astype(int)
        blocks.append(levels.reshape(*levels.shape[:2], 64)[:, :, ZIGZAG])
    n = 2 if half else 1
    told, level = [], [0, 0, 0]
    for row in range(blocks[1].shape[0]):
        for col in range(blocks[1].shape[1]):
            for i in range(3):
                for v in range(n if i == 0 else 1):
                    for u in range(n if i == 0 else 1):
                        q = blocks[i][(row * n + v, col * n + u) if i == 0 else (row, col)]
                        told += [(kind, i > 0, *rest) for kind, *rest in _symbols(q, level[i])]
                        level[i] = int(q[0])
    made = {(kind, of): codes_of(code_lengths(Counter(s for k, o, s, _, _ in told if (k, o) == (kind, of)))) for kind in (0, 1) for of in (False, True)}
    acc, size, body = 0, 0, bytearray()
    for kind, of, symbol, bits, more in told:
        code, length = made[kind, of][1][symbol]
        acc, size = (acc << length | code) << more | bits, size + length + more
        if size >= 512:
            body += (acc >> size % 8).to_bytes(size // 8)
            acc, size = acc & ((1 << size % 8) - 1), size % 8
    pad = -size % 8
    body += (acc << pad | (1 << pad) - 1).to_bytes((size + pad) // 8)
    segment = lambda marker, content: struct.pack(">BBH", 0xFF, marker, len(content) + 2) + content
    out = b"\xff\xd8" + segment(0xDB, b"\x00" + bytes(table.ravel()[ZIGZAG].astype(np.uint8)))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, n << 4 | n, 0, 2, 0x11, 0, 3, 0x11, 0]))
    for (kind, of), (content, _) in made.items():
        out += segment(0xC4, bytes([kind << 4 | of]) + content)
    return out + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + bytes(body).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
