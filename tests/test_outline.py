"""Borders on hand-made shapes and against a walk along the pixels; list ranking against loops."""

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import outline, raster

SHAPES = {
    "ring": ["#####", "#...#", "#.#.#", "#...#", "#####"],
    "corner": ["##..", "##..", "..##", "..##"],
    "diagonal ring": [".#.", "#.#", ".#."],
    "dot": ["#"],
    "line": ["#######"],
    "two": ["##.##", "##.##"],
    "tab": ["......", ".####.", ".####.", "..##..", "......"],
    "nothing": ["..."],
}


def mask_of(spark, rows, component=1):
    return spark.createDataFrame([(component, r, c) for r, row in enumerate(rows) for c, ch in enumerate(row) if ch == "#"], "component long, row long, col long")


def walk(m):
    """Borders of a boolean array as lists of corners, region on the right, each from its first side on."""
    there = lambda r, c: 0 <= r < m.shape[0] and 0 <= c < m.shape[1] and m[r, c]
    step, left = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(-1, 1), (1, 1), (1, -1), (-1, -1)]
    beyond, corner = [(-1, 0), (0, 1), (1, 0), (0, -1)], [(0, 0), (0, 1), (1, 1), (1, 0)]
    todo = {(r, c, s) for r, c in np.argwhere(m).tolist() for s in range(4) if not there(r + beyond[s][0], c + beyond[s][1])}
    out = []
    while todo:
        at, loop = min(todo), []
        while at in todo:
            todo.remove(at)
            r, c, s = at
            loop.append((r + corner[s][0], c + corner[s][1]))
            if there(r + left[s][0], c + left[s][1]):
                at = (r + left[s][0], c + left[s][1], (s + 3) % 4)
            elif there(r + step[s][0], c + step[s][1]):
                at = (r + step[s][0], c + step[s][1], s)
            else:
                at = (r, c, (s + 1) % 4)
        out.append(loop)
    return sorted(out)


def loops(df):
    by = {}
    for r in df.orderBy("loop", "idx").collect():
        by.setdefault((r["component"], r["loop"]), (r["outer"], []))[1].append((r["y"], r["x"]))
    return by


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_hand_made_shapes(spark, name):
    m = np.array([[ch == "#" for ch in row] for row in SHAPES[name]])
    got = loops(outline.outlines(mask_of(spark, SHAPES[name])))
    assert sorted(p for _, p in got.values()) == walk(m)
    holes = {"ring": 1, "diagonal ring": 1}.get(name, 0)
    assert sum(not outer for outer, _ in got.values()) == holes
    d = outline.described(mask_of(spark, SHAPES[name])).collect()
    assert [(r["pixels"], r["holes"]) for r in d] == ([(int(m.sum()), holes)] if m.any() else [])


def test_descriptors_are_those_of_the_polygon(spark):
    d = outline.described(mask_of(spark, SHAPES["tab"])).first()
    # The polygon through the centres: a bar of 3 x 1 and the trapezoid below, down to a line of 1.
    assert d["area"] == pytest.approx(3 * 1 + (3 + 1) / 2) and d["perimeter"] == pytest.approx(3 + 1 + 1 + 1 + 2 * 2**0.5)
    assert d["solidity"] == pytest.approx(1.0) and d["compactness"] == pytest.approx(4 * np.pi * 5 / d["perimeter"] ** 2)
    line = outline.described(mask_of(spark, SHAPES["line"])).first()
    assert (line["area"], line["perimeter"], line["solidity"]) == (0.0, 12.0, 0.0)


def test_drawn_masks_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    m = rng.random((24, 31)) < 0.55
    rows = [(1, r, c) for r, c in np.argwhere(m).tolist()]
    rows += rows[:9] + [(1, None, 3), (1, 2, None), (None, 4, 4)]
    df = spark.createDataFrame(rows, "component long, row long, col long")
    assert sorted(p for _, p in loops(outline.outlines(df)).values()) == walk(m)
    # Regions that touch keep their own outlines.
    halves = {(1 + (c >= 15), r, c) for _, r, c in [x for x in rows if None not in x]}
    both = loops(outline.outlines(spark.createDataFrame(sorted(halves), df.schema)))
    assert sorted(p for (k, _), (_, p) in both.items() if k == 1) == walk(np.where(np.arange(31) < 15, m, False))
    assert sorted(p for (k, _), (_, p) in both.items() if k == 2) == walk(np.where(np.arange(31) >= 15, m, False))
    labels = raster.labelled(df.filter("component = 1 AND row IS NOT NULL AND col IS NOT NULL").select("row", "col"))
    for r in outline.described(labels).collect():
        p = np.array([(x["row"], x["col"]) for x in labels.filter(f"component = {r['component']}").collect()], float)
        assert r["pixels"] == len(p)
        hull = kernels.polygon_area(kernels.convex_hull(p)) if len(kernels.convex_hull(p)) > 2 else 0.0
        assert r["solidity"] == pytest.approx(r["area"] / hull if hull else 0.0)


def test_ranks_along_long_and_short_loops(spark):
    rng = np.random.default_rng(6)
    names, want, at = rng.permutation(4000), {}, 0
    links = []
    for n in (1, 2, 3, 700, 3001, 293):
        loop = names[at : at + n].tolist()
        at += n
        first = loop.index(min(loop))
        for i, e in enumerate(loop):
            links.append((e, loop[(i + 1) % n]))
            want[e] = (min(loop), (i - first) % n, n)
    got = outline.ranked(spark.createDataFrame(links, "e long, nxt long")).collect()
    assert {r["e"]: (r["loop"], r["idx"], r["n"]) for r in got} == want


def test_crops_hold_their_piece_alone(spark):
    image = spark.createDataFrame([(r, c, 10 * r + c) for r in range(6) for c in range(7)], "row long, col long, v long")
    mask = spark.createDataFrame([(1, 2, 2), (1, 2, 3), (2, 4, 4)], "component long, row long, col long")
    boxes = spark.createDataFrame([(0, 1, 1, 1, 4, 5), (1, 2, 3, 3, 6, 6)], "piece_id long, component long, y0 long, x0 long, y1 long, x1 long")
    got = {(r["piece_id"], r["y"], r["x"]): (r["v"], r["alpha"]) for r in outline.crops(image, mask, boxes).collect()}
    assert len(got) == 3 * 4 + 3 * 3
    assert got[0, 1, 1] == (22, 255) and got[0, 1, 2] == (23, 255) and got[0, 0, 0] == (11, 0) and got[1, 1, 1] == (44, 255) and got[1, 0, 0] == (33, 0)
    assert sum(a > 0 for _, a in got.values()) == 3


def test_dents_against_the_kernel(spark):
    from tessera.operators import contour

    rng = np.random.default_rng(8)
    shapes = {1: [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)], 2: [(0, 0), (4, 0), (4, 4), (0, 4)], 3: [(0, 0), (1, 1)], 4: [(2, 2)], 5: [(0, 0), (1, 1), (2, 2)], 6: [(5, 4), (0, 10), (0, 0), (10, 0), (10, 10)]}
    shapes |= {10 + i: [tuple(x) for x in rng.integers(0, 30, (rng.integers(3, 40), 2)).tolist()] for i in range(30)}
    rows = [(k, i, float(x), float(y)) for k, p in shapes.items() for i, (x, y) in enumerate(p)]
    got = {r["id"]: r for r in contour.dents(spark.createDataFrame(rows, "id long, idx long, x double, y double").repartition(7), "id").collect()}
    assert set(got) == set(shapes)
    for k, p in shapes.items():
        p = np.array(p, float)
        assert got[k]["solidity"] == pytest.approx(kernels.solidity(p)), k
        assert got[k]["merged"] == kernels.has_deep_defect(p), k
    assert got[1]["dent"] == got[6]["dent"] == pytest.approx(6.0)
