"""PNG and JPEG readers against files built here, broken files, the sink, and drawing against loops."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import drawing
from tessera.sources import images, jpeg, png
from tessera.sources.sink import FileSink, FileWriter


def filtered(rows, step, kinds):
    """Rows of bytes led by their filter's number, filtered byte by byte."""
    out, prior = bytearray(), [0] * rows.shape[1]
    for y, row in enumerate(rows.tolist()):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, prior[i], prior[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - v), n, v) for n, v in enumerate((a, b, c)))[2]
            out.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        prior = row
    return bytes(out)


def packed(x, depth):
    h = x.shape[0]
    if depth == 16:
        return np.stack([x, x // 3], axis=-1).reshape(h, -1).astype(np.uint8)
    flat = x.reshape(h, -1)
    if depth == 8:
        return flat.astype(np.uint8)
    bits = (flat[:, :, None] >> np.arange(depth)[::-1]) & 1
    return np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)


def build(x, colour, depth, interlaced=0, palette=None, kinds=(0, 1, 2, 3, 4)):
    h, w, n = x.shape
    raw = b""
    for r, c, dr, dc in png.PASSES if interlaced else ((0, 0, 1, 1),):
        part = x[r::dr, c::dc]
        if part.size:
            raw += filtered(packed(part, depth), max(1, n * depth // 8), kinds)
    body = zlib.compress(raw)
    chunk = png._chunk
    out = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + chunk(b"tEXt", b"k\0v")
    out += chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return out + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize("colour,depth", [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
def test_every_kind_of_png(colour, depth, interlaced):
    rng = np.random.default_rng(colour * 100 + depth)
    for h, w in ((1, 1), (3, 2), (9, 13), (17, 8)):
        x = rng.integers(0, 1 << min(depth, 8), (h, w, png.SAMPLES[colour]))
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
        got = png.decode(build(x, colour, depth, interlaced, palette))
        if colour == 3:
            want = palette[x[:, :, 0]]
        elif colour in (0, 4):
            want = np.repeat(x[:, :, :1] * 255 // ((1 << min(depth, 8)) - 1), 3, axis=2)
        else:
            want = x[:, :, :3]
        assert (got == want).all()


def test_png_round_trip_and_broken_files():
    rng = np.random.default_rng(1)
    smooth = np.add.outer(np.arange(40), np.arange(61))[:, :, None] * np.array([1, 2, 3]) % 256
    for x in (smooth, rng.integers(0, 256, (5, 7, 3))):
        assert (png.decode(png.encode(x)) == x).all()
    assert len(png.encode(smooth)) < smooth.size / 5
    good = png.encode(smooth)
    for bad in (b"", good[:8], good[:20], good[:-15], good[:60], good[:50] + b"x" + good[51:], b"BM" + good):
        with pytest.raises(ValueError):
            png.decode(bad)


def picture(h, w):
    y, x = np.mgrid[:h, :w]
    wave = np.sin(y / 9)[:, :, None] * np.cos(x / 11)[:, :, None]
    return (128 + 90 * wave * np.array([1, 0.6, -0.7])).astype(np.uint8)


@pytest.mark.parametrize("h,w", [(8, 8), (1, 1), (33, 70), (16, 48)])
@pytest.mark.parametrize("half", [False, True])
def test_jpeg_round_trip(h, w, half):
    x = picture(h, w)
    assert jpeg.header(jpeg.encode(x)) == (w, h, 3)
    for quality, most in ((100, 14 if half else 3), (92, 18 if half else 9)):
        assert np.abs(jpeg.decode(jpeg.encode(x, quality, half)).astype(int) - x).max() <= most
    noise = np.random.default_rng(2).integers(0, 256, (h, w, 3))
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise).max() <= 4


def test_jpeg_of_one_component_and_restarts():
    """A gray file with a restart after each block, coded by hand: every block's first level has 8 bits, nothing follows."""
    levels = [-128, 127, 64, -30, 0, 90]
    dc = jpeg.codes_of({8: 1, 0: 2, 7: 3, 5: 4, 6: 5})
    ac = jpeg.codes_of({0: 1})
    scan = b""
    for i, level in enumerate(levels):
        level = max(-127, min(127, level))
        size = abs(level).bit_length()
        code, n = dc[1][size]
        bits = f"{code:0{n}b}" + (f"{level if level > 0 else level + (1 << size) - 1:0{size}b}" if size else "") + f"{ac[1][0][0]:0{ac[1][0][1]}b}"
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + i % 8]) if i < len(levels) - 1 else b"")
    segment = lambda marker, content: struct.pack(">BBH", 0xFF, marker, len(content) + 2) + content
    data = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x00" + bytes([8] * 64)) + segment(0xDD, struct.pack(">H", 1)) + segment(0xC0, struct.pack(">BHHB", 8, 16, 24, 1) + bytes([1, 0x22, 0]))
    data += segment(0xC4, b"\x00" + dc[0]) + segment(0xC4, b"\x10" + ac[0]) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    got = jpeg.decode(data)
    for i, level in enumerate(levels):
        r, c = divmod(i, 3)
        want = min(255, max(0, 128 + max(-127, min(127, level))))
        assert (got[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] == want).all()


def test_broken_jpegs():
    good = jpeg.encode(picture(40, 40))
    for bad in (b"", b"\xff\xd8\xff\xe0", good[:100], good[:-2], good[: len(good) * 2 // 3], good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xc4", b"\xff\xfe"), b"BM" + good):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_files_to_pixels_and_back(spark, tmp_path):
    x = picture(70, 66)
    rows = [("a.png", png.encode(x)), ("b.jpg", jpeg.encode(x)), ("c.png", png.encode(x)[:400]), ("d.jpg", b"\xff\xd8\xff\xe0"), ("e.png", b""), ("f.gif", b"GIF89a"), ("g.png", png.encode(x[:20])), ("h.webp", b"RIFF1234WEBP"), ("i.png", None)]
    spark.dataSource.register(FileSink)
    spark.createDataFrame(rows, "name string, content binary").write.format("tessera_files").option("path", str(tmp_path)).mode("append").save()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(r[0] for r in rows)
    files = images.read_files(spark, str(tmp_path))
    told = {r["path"].rsplit("/", 1)[1]: (r["error_code"], r["height"], r["http_code"]) for r in images.inspected(files).collect()}
    want = {"a.png": (None, 70, 200), "b.jpg": (None, 70, 200), "c.png": ("decode", None, 422), "d.jpg": ("decode", None, 422), "f.gif": ("format", None, 422), "g.png": ("too_small", 20, 422), "h.webp": ("decode", None, 422)}
    assert {k: told[k] for k in want} == want and all(told[k][0] == "empty" for k in told if k not in want)
    pixels = images.pixels(files.filter(F.col("path").endswith("a.png") | F.col("path").endswith("c.png")))
    got = np.zeros_like(x)
    for r in pixels.collect():
        got[r["y"], r["x"], r["c"]] = r["v"]
    assert (got == x).all()
    again = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for fmt in ("png", "jpeg", "ppm") for r in images.encoded(pixels.withColumn("path", F.lit(f"/{fmt}")), fmt).collect()}
    assert (png.decode(again["png"]) == x).all() and (images.decode_ppm(again["ppm"]) == x).all() and np.abs(jpeg.decode(again["jpeg"]).astype(int) - x).max() < 10
    assert images.pixels(files.limit(0)).count() == images.inspected(files.limit(0)).count() == 0


def test_names_stay_within_the_folder(tmp_path):
    w = FileWriter(str(tmp_path))
    for bad in ("../x", "", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            w.target(bad)
    done = w.write(iter([{"name": "sub/a.bin", "content": b"1"}]))
    assert not (tmp_path / "sub" / "a.bin").exists()
    w.abort([done, None])
    assert list((tmp_path / "sub").iterdir()) == []
    w.commit([w.write(iter([{"name": "sub/a.bin", "content": b"2"}])), None])
    assert (tmp_path / "sub" / "a.bin").read_bytes() == b"2"


def test_drawing(spark):
    rows = [("line", 0, 3, 9, 3, None, "grid"), ("line", 2, 1, 7, 8, None, "blue"), ("line", 9, 9, 4, 7, None, "blue"), ("dot", 4, 4, 4, 4, None, "red"), ("dot", 50, 50, 50, 50, None, "red"), ("text", 1, 1, 1, 1, "8", "white"), ("blob", 0, 0, 1, 1, None, "red"), ("line", None, 0, 1, 1, None, "red"), ("text", 0, 0, 0, 0, "?", "white")]
    c = spark.createDataFrame(rows + rows[:2], "kind string, x0 long, y0 long, x1 long, y1 long, text string, colour string")
    got = {(r["row"], r["col"]): r["colour"] for r in drawing.drawn(c, 10, 10, radius=2).collect()}
    want = {}
    for _, x0, y0, x1, y1, _, colour in [rows[0], *sorted(rows[1:3], key=lambda r: (r[2], r[1]))]:
        n = max(abs(x1 - x0), abs(y1 - y0))
        for t in range(n + 1):
            want[y0 + (2 * (y1 - y0) * t + n) // (2 * n), x0 + (2 * (x1 - x0) * t + n) // (2 * n)] = colour
    want |= {(4 + a, 4 + b): "red" for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4}
    want |= {(1 + y, 1 + x): "white" for y in range(9) for x in range(5) if y in (0, 4, 8) or x in (0, 4)}
    assert {k: v for k, v in got.items() if want.get(k) in ("red", "white")} == {k: v for k, v in want.items() if v in ("red", "white") and max(k) < 10}
    assert set(got) == {k for k in want if 0 <= min(k) and max(k) < 10}
    ground = spark.createDataFrame([("p", y, x, ch, 7) for y in range(2) for x in range(2) for ch in range(3)], "path string, y int, x int, c int, v int")
    over = spark.createDataFrame([("p", 0, 1, "red"), ("p", 1, 1, "no such")], "path string, row int, col int, colour string")
    painted = {(r["y"], r["x"], r["c"]): r["v"] for r in drawing.painted(over, ground, {"red": (255, 1, 2)}).collect()}
    assert painted[0, 1, 0] == 255 and painted[0, 1, 2] == 2 and painted[1, 1, 0] == 7 and painted[0, 0, 0] == 7 and len(painted) == 12
