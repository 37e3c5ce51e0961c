"""Image arithmetic on NumPy arrays: grey levels, filters, runs, connected regions, resampling."""

from __future__ import annotations

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    """Grey levels of a BGR image; one of two dimensions stays as it is."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3].astype(np.float32) @ np.float32([0.114, 0.587, 0.299])).astype(np.uint8)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, bool).astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def blurred(image: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Convolution with one kernel along both axes."""
    x, r = image.astype(np.float32), len(kernel) // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(x, pad, mode=mode if x.shape[axis] > r else "edge")
        x = sum(w * np.take(p, range(i, i + x.shape[axis]), axis) for i, w in enumerate(kernel))
    return x


def bell(size: int) -> np.ndarray:
    """A Gaussian kernel with the usual deviation for its size."""
    if size in (3, 5):
        return np.float32([1, 2, 1]) / 4 if size == 3 else np.float32([1, 4, 6, 4, 1]) / 16
    s = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * s * s))
    return (k / k.sum()).astype(np.float32)


def bright(grey: np.ndarray, block: int = 15, above: float = 6) -> np.ndarray:
    """Pixels brighter than their surroundings by more than `above`."""
    soft = np.rint(blurred(grey, bell(5)))
    return soft > np.rint(blurred(soft, bell(block), "edge")) + above


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Pixels in horizontal runs of at least `least`."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    keep = end - start >= least
    marks = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(marks, (row[keep], start[keep]), 1)
    np.add.at(marks, (row[keep], end[keep]), -1)
    return np.cumsum(marks, axis=1)[:, :-1] > 0


def line_masks(grey: np.ndarray, across: float = 0.35, down: float = 0.20) -> tuple[np.ndarray, np.ndarray]:
    """Long horizontal and long vertical strokes."""
    h, w = grey.shape
    mask = bright(grey)
    return long_runs(mask, max(12, int(w * across))), long_runs(mask.T, max(12, int(h * down))).T


def grown(mask: np.ndarray, size: int) -> np.ndarray:
    """Dilation with a square."""
    n = np.cumsum(np.pad(mask.astype(np.int32), ((size // 2 + 1, size // 2), (size // 2 + 1, size // 2))), axis=0).cumsum(axis=1)
    return n[size:, size:] - n[:-size, size:] - n[size:, :-size] + n[:-size, :-size] > 0


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Opening with a square; outside counts as set for the erosion."""
    return grown(~grown(~mask, size), size)


def closed_cross(mask: np.ndarray) -> np.ndarray:
    """Closing with a cross of three pixels each way."""

    def spread(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, 1)
        return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]

    return ~spread(~spread(mask))


def regions(mask: np.ndarray) -> list[dict]:
    """box (x, y, w, h), area, centre and points of 8-connected regions, by first row, then column."""
    spans = [(y, a, b) for y in range(mask.shape[0]) for a, b in runs(mask[y])]
    parent = list(range(len(spans)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before, now, row = [], [], -1
    for i, (y, a, b) in enumerate(spans):
        if y != row:
            before, now, row = (now if y == row + 1 else []), [], y
        for j in before:
            if spans[j][1] <= b and a <= spans[j][2]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
        now.append(i)
    groups: dict[int, list] = {}
    for i, s in enumerate(spans):
        groups.setdefault(root(i), []).append(s)
    out = []
    for own in groups.values():
        y, a, b = np.array(own).T
        area = int((b - a).sum())
        box = (int(a.min()), int(y.min()), int(b.max() - a.min()), int(y.max() - y.min() + 1))
        centre = (float(((a + b - 1) / 2 * (b - a)).sum() / area), float((y * (b - a)).sum() / area))
        out.append({"box": box, "area": area, "centre": centre, "spans": own})
    return out


def area_weights(old: int, new: int) -> np.ndarray:
    """How much of each old pixel a new one covers."""
    edge = np.arange(new + 1) * (old / new)
    low, high = np.maximum(edge[:-1, None], np.arange(old)), np.minimum(edge[1:, None], np.arange(old) + 1)
    s = np.maximum(0, high - low)
    return (s / s.sum(axis=1, keepdims=True)).astype(np.float32)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over the area that each new pixel covers."""
    x = image.astype(np.float32)
    down, across = area_weights(x.shape[0], height), area_weights(x.shape[1], width)
    return np.einsum("yr,rc...,xc->yx...", down, x, across, optimize=True)


def otsu(grey: np.ndarray) -> int:
    """The level that splits grey levels into the two classes farthest apart."""
    n = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = (mass[-1] * below - mass * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(gap), gap, -1)))


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrix that takes four points to four others."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of four neighbours at a fraction, with the bicubic parameter -0.75."""
    a, d = -0.75, np.abs(t[..., None] - np.array([-1, 0, 1, 2]))
    near, far = ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.where(d <= 1, near, np.where(d < 2, far, 0)).astype(np.float32)


def warped(image: np.ndarray, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image under a perspective matrix, bicubic, black outside."""
    back = np.linalg.inv(matrix)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, w = np.einsum("ij,jyx->iyx", back, np.stack([x, y, np.ones_like(x)]))
    u, v = u / w, v / w
    iu, iv = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    wu, wv = _cubic(u - iu), _cubic(v - iv)
    p = np.pad(image.astype(np.float32), ((3, 3), (3, 3)) + ((0, 0),) * (image.ndim - 2))
    out = np.zeros((height, width, *image.shape[2:]), np.float32)
    lift = (lambda k: k[..., None]) if image.ndim == 3 else (lambda k: k)
    for j in range(4):
        r = np.clip(iv + j - 1 + 3, 0, p.shape[0] - 1)
        for i in range(4):
            out += lift(wv[..., j] * wu[..., i]) * p[r, np.clip(iu + i - 1 + 3, 0, p.shape[1] - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, float)

    def half(order):
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def smallest_rectangle(corners: np.ndarray) -> np.ndarray:
    """The rectangle of least area around a convex polygon; one side lies on an edge."""
    best = None
    for dx, dy in np.roll(corners, -1, axis=0) - corners:
        n = np.hypot(dx, dy)
        if not n:
            continue
        turn = np.array([[dx, dy], [-dy, dx]]) / n
        q = corners @ turn.T
        (a, b), (c, d) = q.min(axis=0), q.max(axis=0)
        if best is None or (c - a) * (d - b) < best[0]:
            best = ((c - a) * (d - b), np.array([[a, b], [c, b], [c, d], [a, d]]) @ turn)
    return best[1] if best else corners


def ordered(quad: np.ndarray) -> np.ndarray:
    """Corners of a convex outline clockwise from the top left one, by their direction from its middle."""
    z = (quad - quad.mean(axis=0)) @ np.array([1, 1j])
    return quad[np.argsort(np.angle(z), kind="stable")]


def skew(quad: np.ndarray) -> float:
    """Largest turn, in degrees, of the sides of an `ordered` outline against those of an upright rectangle."""
    sides = (np.roll(quad, -1, axis=0) - quad) @ np.array([1, 1j])
    return float(np.degrees(np.abs(np.angle(sides * np.array([1, -1j, -1, 1j])))).max())
