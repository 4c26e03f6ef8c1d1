"""Pixel functions in numpy on uint8 arrays (height, width[, channels]), BGR."""

from __future__ import annotations

import numpy as np


def image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    shape = (int(height), int(width)) if int(channels) == 1 else (int(height), int(width), int(channels))
    return np.frombuffer(data, np.uint8).reshape(shape)


def crop(i: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    h, w = i.shape[:2]
    return i[max(0, y0) : min(h, max(y1, 0)), max(0, x0) : min(w, max(x1, 0))]


def mask(i: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    out = np.zeros_like(i)
    part = slice(max(0, y0), max(0, y1)), slice(max(0, x0), max(0, x1))
    out[part] = i[part]
    return out


def corners_blank(i: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    out = i.copy()
    out[:y0, :x0] = 0
    out[y1:, x1:] = 0
    return out


def black_out(i: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = i.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 0
    return out


def gray(i: np.ndarray) -> np.ndarray:
    """BT.601 luma of a BGR image."""
    if i.ndim == 2:
        return i
    return np.rint(i[..., 0] * 0.114 + i[..., 1] * 0.587 + i[..., 2] * 0.299).astype(np.uint8)


def expand(i: np.ndarray) -> np.ndarray:
    return np.repeat(i[..., None], 3, axis=2) if i.ndim == 2 else i


def quantize(i: np.ndarray, d: int) -> np.ndarray:
    return (np.floor(i * (d / 255)) * (255 / d)).astype(np.uint8)


def resize(i: np.ndarray, factor: float) -> np.ndarray:
    """Nearest neighbour."""
    h, w = max(1, int(i.shape[0] * factor)), max(1, int(i.shape[1] * factor))
    ys = np.minimum((np.arange(h) / factor).astype(int), i.shape[0] - 1)
    xs = np.minimum((np.arange(w) / factor).astype(int), i.shape[1] - 1)
    return i[ys][:, xs]


def gaussian(k: int) -> np.ndarray:
    """1-D kernel of odd size k, with the usual deviation for its size."""
    s = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.arange(k) - k // 2
    g = np.exp(-x * x / (2 * s * s))
    return g / g.sum()


def _along(i: np.ndarray, g: np.ndarray, axis: int) -> np.ndarray:
    r = len(g) // 2
    pad = [(0, 0)] * i.ndim
    pad[axis] = (r, r)
    p = np.pad(i.astype(float), pad, mode="reflect" if i.shape[axis] > r else "edge")
    n = i.shape[axis]
    return sum(c * np.take(p, np.arange(j, j + n), axis=axis) for j, c in enumerate(g))


def blur(i: np.ndarray, k: int = 5) -> np.ndarray:
    g = gaussian(k)
    return np.rint(_along(_along(i, g, 0), g, 1)).clip(0, 255).astype(np.uint8)


def gradients(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives by x and y."""
    s, d = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return _along(_along(i, s, 0), d, 1), _along(_along(i, s, 1), d, 0)


def canny(i: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: thin maxima of the gradient, strong ones and what touches them."""
    gx, gy = gradients(gray(i))
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    at = lambda dy, dx: p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    thin = np.zeros(m.shape, bool)
    for lo, hi, dy, dx in ((-22.5, 22.5, 0, 1), (22.5, 67.5, 1, 1), (67.5, 112.5, 1, 0), (112.5, 157.5, 1, -1), (157.5, 180.1, 0, 1)):
        thin |= (angle >= lo) & (angle < hi) & (m >= at(dy, dx)) & (m > at(-dy, -dx))
    weak, edges = thin & (m > low), thin & (m > high)
    while True:  # grow along weak edges
        g = np.pad(edges, 1)
        near = np.zeros_like(edges)
        for dy in range(3):
            for dx in range(3):
                near |= g[dy : dy + m.shape[0], dx : dx + m.shape[1]]
        grown = edges | (weak & near)
        if (grown == edges).all():
            return (edges * 255).astype(np.uint8)
        edges = grown


def changed(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    out = now.copy()
    out[now == before] = 0
    return out


def bilateral(i: np.ndarray, d: int = 9, colour: float = 150.0, space: float = 150.0) -> np.ndarray:
    r = d // 2
    x = i.astype(float)
    p = np.pad(x, [(r, r), (r, r)] + [(0, 0)] * (i.ndim - 2), mode="edge")
    total, weight = np.zeros_like(x), np.zeros(x.shape[:2])
    for dy in range(d):
        for dx in range(d):
            if (dy - r) ** 2 + (dx - r) ** 2 > r * r:
                continue
            q = p[dy : dy + x.shape[0], dx : dx + x.shape[1]]
            gap = np.abs(q - x).sum(2) if i.ndim == 3 else np.abs(q - x)
            w = np.exp(-((dy - r) ** 2 + (dx - r) ** 2) / (2 * space**2) - gap**2 / (2 * colour**2))
            total += q * (w[..., None] if i.ndim == 3 else w)
            weight += w
    return np.rint(total / (weight[..., None] if i.ndim == 3 else weight)).astype(np.uint8)


def regions(m: np.ndarray) -> list[np.ndarray]:
    """8-connected regions of a mask, as arrays of (y, x)."""
    label = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    while True:
        p = np.pad(label, 1)
        best = np.max([p[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
        new = np.where(m, best, 0)
        if (new == label).all():
            break
        label = new
    ys, xs = np.nonzero(label)
    names = label[ys, xs]
    order = np.argsort(names, kind="stable")
    cuts = np.flatnonzero(np.diff(names[order])) + 1
    return [np.stack([ys[k], xs[k]], 1) for k in np.split(order, cuts)] if len(order) else []


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of (y, x) points."""
    pts = sorted({(int(x), int(y)) for y, x in points})
    if len(pts) < 3:
        return 0.0
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = half(pts) + half(reversed(pts))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1], strict=True))) / 2


def key_points(i: np.ndarray, k: int = 5, low: float = 225, high: float = 250, least: float = 10) -> list[tuple[int, int]]:
    """Centres (x, y) of edge contours with an area above ``least``."""
    first = i if i.ndim == 2 else i[..., 0]
    found = [r for r in regions(canny(blur(first, k), low, high) > 0) if hull_area(r) > least]
    return [(int(r[:, 1].mean()), int(r[:, 0].mean())) for r in found]


def moving_boxes(now: np.ndarray, before: np.ndarray, least: float) -> list[tuple[tuple[int, int, int, int], float]]:
    """Bounding boxes and areas of regions whose edges moved."""
    m = canny(now, 225, 250) != canny(before, 225, 250)
    out = []
    for r in regions(m):
        if (a := hull_area(r)) > least:
            out.append(((int(r[:, 1].min()), int(r[:, 0].min()), int(r[:, 1].max()), int(r[:, 0].max())), a))
    return out


def corner_points(i: np.ndarray, n: int, quality: float = 0.3, apart: float = 3) -> np.ndarray:
    """Up to n (x, y) corners by smaller eigenvalue of the gradient matrix."""
    gx, gy = gradients(gray(i))
    g = np.ones(3)
    a, b, c = (_along(_along(m, g, 0), g, 1) for m in (gx * gx, gx * gy, gy * gy))
    least = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    ys, xs = np.nonzero(least > max(quality * least.max(), 1e-9))
    order = np.lexsort((xs, ys, -least[ys, xs]))
    out: list[tuple[int, int]] = []
    for k in order:
        if all((xs[k] - x) ** 2 + (ys[k] - y) ** 2 >= apart * apart for x, y in out):
            out.append((int(xs[k]), int(ys[k])))
            if len(out) == n:
                break
    return np.array(out, float).reshape(-1, 2)


def flow(before: np.ndarray, now: np.ndarray, corners: int, r: int = 7, rounds: int = 10) -> list[tuple[float, float, float, float]]:
    """Lucas-Kanade displacement of corners as (x0, y0, x1, y1)."""
    a, b = before.astype(float), now.astype(float)
    gx, gy = (g / 8 for g in gradients(before))
    h, w = a.shape
    out = []
    for x, y in corner_points(before, corners):
        ys, xs = (v.ravel() for v in np.mgrid[max(0, int(y) - r) : min(h, int(y) + r + 1), max(0, int(x) - r) : min(w, int(x) + r + 1)])
        ix, iy = gx[ys, xs], gy[ys, xs]
        m = np.array([[ix @ ix, ix @ iy], [ix @ iy, iy @ iy]])
        if np.linalg.det(m) < 1e-6:
            continue
        d = np.zeros(2)
        for _ in range(rounds):
            it = sampled(b, ys + d[1], xs + d[0]) - a[ys, xs]
            step = -np.linalg.solve(m, [ix @ it, iy @ it])
            d += step
            if np.hypot(*step) < 0.01:
                break
        out.append((float(x), float(y), float(x + d[0]), float(y + d[1])))
    return out


def sampled(i: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values, clamped at the border."""
    y, x = y.clip(0, i.shape[0] - 1.001), x.clip(0, i.shape[1] - 1.001)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = y - y0, x - x0
    return i[y0, x0] * (1 - fy) * (1 - fx) + i[y0, x0 + 1] * (1 - fy) * fx + i[y0 + 1, x0] * fy * (1 - fx) + i[y0 + 1, x0 + 1] * fy * fx


def foreground(stack: np.ndarray, threshold: float, share: float) -> tuple[int, int, int, int] | None:
    """Extent (x0, y0, x1, y1) of pixels that change by more than ``threshold`` in
    at least ``share`` of the steps of a batch; None if it has no area."""
    gap = np.abs(np.diff(stack.astype(int), axis=0))
    if gap.ndim == 4:
        gap = gap.max(3)
    ys, xs = np.nonzero((gap > threshold).sum(0) >= max(1, len(stack) * share))
    if not len(ys) or xs.min() == xs.max() or ys.min() == ys.max():
        return None
    return int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())


def mean_change(now: np.ndarray, before: np.ndarray) -> float:
    """Mean absolute difference of blurred gray images."""
    return float(np.abs(blur(gray(now)).astype(int) - blur(gray(before)).astype(int)).mean())


def hog(i: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Unit vectors of gradient orientations, one per cell."""
    gx, gy = gradients(gray(i))
    m, angle = np.hypot(gx, gy), (np.rad2deg(np.arctan2(gy, gx)) % 180) / (180 / bins)
    h, w = m.shape[0] // cell, m.shape[1] // cell
    out = np.zeros((h, w, bins))
    ys, xs = np.mgrid[: h * cell, : w * cell] // cell
    np.add.at(out, (ys, xs, angle[: h * cell, : w * cell].astype(int) % bins), m[: h * cell, : w * cell])
    norm = np.linalg.norm(out, axis=2, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).reshape(-1, bins)
