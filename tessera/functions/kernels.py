"""NumPy kernels for what columns cannot express; operators call them per image or contour from Python workers."""

from __future__ import annotations

import heapq

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the lowest x; collinear points are left out."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p
    halves = []
    for q in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for x in q:
            while len(chain) > 1 and np.cross(np.append(chain[-1] - chain[-2], 0), np.append(x - chain[-2], 0))[2] <= 0:
                chain.pop()
            chain.append(x)
        halves.append(chain[:-1])
    return np.array(halves[0] + halves[1])


def polygon_area(p: np.ndarray) -> float:
    x, y = np.asarray(p, float).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def perimeter(p: np.ndarray) -> float:
    return float(np.linalg.norm(np.roll(p, -1, axis=0) - p, axis=1).sum())


def solidity(p: np.ndarray) -> float:
    """Area over that of the hull; 0 for a hull without area."""
    hull = polygon_area(convex_hull(p)) if len(p) >= 3 else 0.0
    return polygon_area(p) / hull if hull else 0.0


def has_deep_defect(p: np.ndarray, share: float = 0.08) -> bool:
    """Whether some point lies deeper below the edge of the hull that bridges it than that share of the perimeter."""
    p = np.asarray(p, float)
    hull = {tuple(x) for x in convex_hull(p)}
    at = [i for i, x in enumerate(p) if tuple(x) in hull]
    if len(hull) < 3:
        return False
    deepest = 0.0
    for i, j in zip(at, [*at[1:], at[0] + len(p)], strict=True):
        if j - i > 1:
            a, edge = p[i], p[j % len(p)] - p[i]
            mid = p[np.arange(i + 1, j) % len(p)] - a
            n = np.linalg.norm(edge)
            d = np.abs(edge[0] * mid[:, 1] - edge[1] * mid[:, 0]) / n if n else np.linalg.norm(mid, axis=1)
            deepest = max(deepest, d.max())
    return bool(deepest > share * perimeter(p))


def simplified(p: np.ndarray, eps: float) -> np.ndarray:
    """Indexes of a closed contour's points that remain when none strays more than eps (Douglas and Peucker)."""
    p = np.asarray(p, float)
    far = int(np.argmax(np.linalg.norm(p - p[0], axis=1)))
    keep, work = {0, far}, [(0, far), (far, len(p))]
    while work:
        i, j = work.pop()
        if j - i < 2:
            continue
        a, b = p[i], p[j % len(p)]
        mid, edge = p[i + 1 : j], b - a
        n = np.linalg.norm(edge)
        d = np.abs(edge[0] * (mid[:, 1] - a[1]) - edge[1] * (mid[:, 0] - a[0])) / n if n else np.linalg.norm(mid - a, axis=1)
        k = int(np.argmax(d))
        if d[k] > eps:
            keep.add(i + 1 + k)
            work += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.array(sorted(keep))


def sharpest(angles: np.ndarray, count: int, apart: int) -> np.ndarray:
    """Indexes of up to `count` smallest inner angles, no two of which stand `apart` or less from each other; the ends of
    the list are not neighbours."""
    out: list[int] = []
    for i in np.argsort(angles, kind="stable"):
        if all(abs(i - j) > apart for j in out):
            out.append(int(i))
            if len(out) == count:
                break
    return np.array(sorted(out), int)


def corners(p: np.ndarray, share: float = 0.02) -> np.ndarray:
    """Four corners of a piece: by simplification if that leaves four, else the sharpest angles."""
    p = np.asarray(p, float)
    if len(p) < 4:
        return np.arange(len(p))
    at = simplified(p, share * perimeter(p))
    if len(at) == 4:
        return at
    a, b = np.roll(p, 1, axis=0) - p, np.roll(p, -1, axis=0) - p
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cos = np.where(size > 0, (a * b).sum(axis=1) / np.where(size > 0, size, 1), 1)
    return sharpest(np.degrees(np.arccos(np.clip(cos, -1, 1))), 4, max(1, len(p) // 8))


def rotated(image: np.ndarray, degrees: float, ground: int = 128) -> np.ndarray:
    """The image turned counter-clockwise on a canvas that holds it, by nearest neighbours; outside is `ground`."""
    h, w = image.shape[:2]
    t = np.radians(degrees)
    c, s = np.cos(t), np.sin(t)
    hh, ww = int(np.ceil(abs(h * c) + abs(w * s) - 1e-9)), int(np.ceil(abs(w * c) + abs(h * s) - 1e-9))
    y, x = np.mgrid[0:hh, 0:ww]
    dy, dx = y - (hh - 1) / 2, x - (ww - 1) / 2
    sx, sy = np.rint(c * dx - s * dy + (w - 1) / 2).astype(int), np.rint(s * dx + c * dy + (h - 1) / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((hh, ww, *image.shape[2:]), ground, image.dtype)
    out[ok] = image[sy[ok], sx[ok]]
    return out


def inner_distance(mask: np.ndarray) -> np.ndarray:
    """City-block distance of each set pixel to the nearest unset one or the border."""
    d = np.pad(mask.astype(int) * (mask.size + 1), 1)
    for view in (d, d[::-1], d.T, d.T[::-1]):
        for i in range(1, len(view)):
            view[i] = np.minimum(view[i], view[i - 1] + 1)
    return d[1:-1, 1:-1]


def labelled(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected regions of a mask, in order of their first pixel; 0 outside."""
    out = np.zeros(mask.shape, int)
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start], work = n, [start]
        while work:
            y, x = work.pop()
            near = (slice(max(0, y - 1), y + 2), slice(max(0, x - 1), x + 2))
            fresh = mask[near] & (out[near] == 0)
            out[near][fresh] = n
            work += [(near[0].start + a, near[1].start + b) for a, b in zip(*np.nonzero(fresh), strict=True)]
    return out


def watershed(mask: np.ndarray, share: float = 0.4) -> np.ndarray:
    """Labels of a mask split at its necks: cores beyond `share` of the largest inner distance are flooded outwards,
    deepest pixels first; a mask with fewer than two cores is one region."""
    d = inner_distance(mask)
    label = labelled(d > share * d.max()) if mask.any() else np.zeros(mask.shape, int)
    if label.max() < 2:
        return mask.astype(int)
    queue = [(-d[y, x], y, x) for y, x in zip(*np.nonzero(label), strict=True)]
    heapq.heapify(queue)
    while queue:
        _, y, x = heapq.heappop(queue)
        for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = label[y, x]
                heapq.heappush(queue, (-d[a, b], a, b))
    return label
