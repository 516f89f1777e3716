"""Detection of square 4 x 4-bit markers, in numpy alone."""

from __future__ import annotations

import numpy as np

from namewright.functions.geometry import fit_homography, project
from namewright.functions.kernels import adaptive_threshold_inv, bilinear, downscale, two_means

#: The 50 words of the public DICT_4X4_50 dictionary, row by row from the top left, 1 = white.
WORDS = [
    0xB532, 0x0F9A, 0x332D, 0x9946, 0x549E, 0x79CD, 0x9E2E, 0xC4F2, 0xFEDA, 0xCF56,
    0xF991, 0x11A7, 0x0EB7, 0x2A0F, 0x24B1, 0x263E, 0x4665, 0x6600, 0x6C5E, 0x76AF,
    0x868B, 0xB02B, 0xCCD5, 0xDD82, 0xFE47, 0x9471, 0xACE4, 0xA554, 0x2123, 0x346F,
    0x4415, 0x57B2, 0x9ECF, 0xF0CB, 0x08AE, 0x0929, 0x1875, 0x04FF, 0x0DF6, 0x1C5A,
    0x1718, 0x2A28, 0x328C, 0x38B2, 0x24E8, 0x2EEB, 0x2D3F, 0x4B64, 0x502E, 0x5013,
]
GRID = 6
WORK_SIZE, RADII, DARKER, LEAST_SIDE, BORDER_ERRORS = 1600, (7, 15), 7.0, 0.015, 2
_WORDS = np.array(WORDS, np.uint16)


def lookup(code: int, max_errors: int = 0) -> tuple[int, int] | None:
    """(id, Hamming distance) of the one nearest word within max_errors; None if there is none or a tie."""
    errors = np.bitwise_count(_WORDS ^ np.uint16(code))
    least = int(errors.min())
    nearest = np.flatnonzero(errors == least)
    return (int(nearest[0]), least) if least <= max_errors and len(nearest) == 1 else None


def payload(bits: np.ndarray) -> int:
    """The inner cells of a grid, first cell in the highest bit."""
    return int(bits[1:-1, 1:-1].astype(np.int64).ravel() @ (1 << np.arange(15, -1, -1)))


def render(marker: int, cell: int = 8, quiet: int = 2) -> np.ndarray:
    """A marker as an image with a white quiet zone of ``quiet`` cells."""
    grid = np.zeros((GRID, GRID), np.uint8)
    grid[1:-1, 1:-1] = np.array([WORDS[marker] >> (15 - k) & 1 for k in range(16)]).reshape(4, 4)
    return np.kron(np.pad(grid, quiet, constant_values=1), np.ones((cell, cell), np.uint8)) * 255


# --- shapes -----------------------------------------------------------------------------------------------------


def outlines(mask: np.ndarray, least: int) -> list[np.ndarray]:
    """Outline points (x, y) of each connected dark shape at least ``least`` pixels wide and high.

    Shapes are joined from runs of pixels, row by row; a shape's outline is its first and last pixel of each row and column.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    edges = np.diff(padded, axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1] - 1
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # A run touches those of the row above that overlap it, corners included.
    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        above, here = slice(first[y - 1], first[y]), slice(first[y], first[y + 1])
        lo = np.searchsorted(end[above], start[here] - 1) + first[y - 1]
        hi = np.searchsorted(start[above], end[here] + 1, side="right") + first[y - 1]
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True), first[y]):
            for j in range(a, b):
                p, q = root(int(k)), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    label = np.array([root(i) for i in range(len(row))], np.int64)
    out = []
    order = np.argsort(label, kind="stable")
    for runs in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if not len(runs) or row[runs[-1]] - row[runs[0]] + 1 < least or end[runs].max() - start[runs].min() + 1 < least:
            continue
        y0, x0 = row[runs].min(), start[runs].min()
        height, width = row[runs].max() - y0 + 1, end[runs].max() - x0 + 1
        left, right = np.full(height, width), np.full(height, -1)
        np.minimum.at(left, row[runs] - y0, start[runs] - x0)
        np.maximum.at(right, row[runs] - y0, end[runs] - x0)
        top, low = np.full(width, height), np.full(width, -1)
        for k in runs:
            span = slice(start[k] - x0, end[k] - x0 + 1)
            top[span] = np.minimum(top[span], row[k] - y0)
            low[span] = np.maximum(low[span], row[k] - y0)
        rows, cols = np.arange(height), np.arange(width)
        points = np.concatenate([np.column_stack(p) for p in ((left, rows), (right, rows), (cols, top), (cols, low))])
        out.append(np.unique(points, axis=0).astype(np.float64) + (x0, y0))
    return out


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def fit_quad(points: np.ndarray, least_side: float) -> np.ndarray | None:
    """The convex quadrilateral (clockwise on screen) that the outline follows, or None."""
    far = lambda p: points[np.hypot(*(points - p).T).argmax()]
    a = far(points.mean(axis=0))
    b = far(a)
    across = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
    if across.max() <= 0 or across.min() >= 0:
        return None
    quad = np.array([a, points[across.argmin()], b, points[across.argmax()]])
    sides = np.hypot(*(np.roll(quad, -1, axis=0) - quad).T)
    if sides.min() < least_side or sides.max() > 4 * sides.min():
        return None
    turns = [_turn(quad[i], quad[(i + 1) % 4], quad[(i + 2) % 4]) for i in range(4)]
    if min(turns) <= 0:
        return None
    step = np.roll(quad, -1, axis=0) - quad
    along = np.clip(((points[:, None] - quad) * step).sum(axis=2) / (step**2).sum(axis=1), 0, 1)
    off = np.hypot(*np.moveaxis(points[:, None] - (quad + along[..., None] * step), 2, 0)).min(axis=1)
    return quad if (off <= max(0.06 * sides.min(), 1.5)).all() else None


# --- reading ----------------------------------------------------------------------------------------------------


def decode(image: np.ndarray, quad: np.ndarray, border_errors: int = BORDER_ERRORS, payload_errors: int = 0) -> tuple[int, np.ndarray, int] | None:
    """(id, corners from the printed top left on, wrong cells) of the marker inside ``quad``, or None."""
    unit = np.array([(0, 0), (GRID, 0), (GRID, GRID), (0, GRID)], np.float64)
    m = fit_homography(unit, quad)
    if m is None:
        return None
    at = (np.arange(GRID)[:, None] + 0.2 * np.arange(1, 5)).ravel()
    u, v = np.meshgrid(at, at)
    places = project(m, np.column_stack([u.ravel(), v.ravel()]))
    cells = bilinear(image, places[:, 0] - 0.5, places[:, 1] - 0.5).reshape(GRID, 4, GRID, 4).mean(axis=(1, 3))
    limit = two_means(cells)
    if limit is None:
        return None
    bits = cells > limit
    wrong = int(bits.sum() - bits[1:-1, 1:-1].sum())
    if wrong > border_errors:
        return None
    for k in range(4):
        if hit := lookup(payload(np.rot90(bits, k)), payload_errors):
            return hit[0], np.roll(quad, -k, axis=0), wrong + hit[1]
    return None


def refine(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Corners where lines through the strongest rises along each edge meet; the given ones where that fails."""
    sides = np.roll(quad, -1, axis=0) - quad
    cell = np.hypot(*sides.T).mean() / GRID
    reach = max(0.35 * cell, 2.0)
    lines = []
    for corner, side in zip(quad, sides, strict=True):
        along = side / np.hypot(*side)
        normal = np.array([along[1], -along[0]])
        base = corner + np.linspace(0.15, 0.85, 24)[:, None] * side
        d = np.arange(-reach, reach + 1e-9, 0.5)
        value = lambda shift: bilinear(image, base[:, :1] + normal[0] * shift - 0.5, base[:, 1:] + normal[1] * shift - 0.5)  # noqa: B023, E731
        rise = value(d + 0.5) - value(d - 0.5)
        best = rise.argmax(axis=1)
        n = np.arange(len(best))
        peak, good = d[best], rise[n, best] >= 10
        inner = (best > 0) & (best < len(d) - 1)
        g0, g1, g2 = (rise[n, np.clip(best + k, 0, len(d) - 1)] for k in (-1, 0, 1))
        curve = g0 - 2 * g1 + g2
        move = np.clip(0.5 * (g0 - g2) / np.where(np.abs(curve) > 1e-9, curve, 1), -1, 1)
        peak = peak + np.where(inner & (np.abs(curve) > 1e-9), 0.5 * move, 0)
        hits = (base + normal * peak[:, None])[good]
        if len(hits) < 6:
            return quad
        centre = hits.mean(axis=0)
        lines.append((centre, np.linalg.svd(hits - centre, full_matrices=False)[2][0]))
    out = []
    for i in range(4):
        (p, d), (q, e) = lines[i - 1], lines[i]
        both = np.column_stack([d, -e])
        if abs(np.linalg.det(both)) < 1e-9:
            return quad
        met = p + np.linalg.solve(both, q - p)[0] * d
        if np.hypot(*(met - quad[i])) >= 0.5 * cell:
            return quad
        out.append(met)
    return np.array(out)


def detect(image: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(id, 4 x 2 corners in pixels) of every marker in a gray photo; of detections of one id at one place the best stays."""
    factor = max(1, -(-max(image.shape) // WORK_SIZE))
    small = downscale(image, factor)
    least = LEAST_SIDE * max(small.shape)
    found: list[tuple[int, np.ndarray, int]] = []
    for radius in RADII:
        for points in outlines(adaptive_threshold_inv(small, radius, DARKER) > 0, int(least)):
            quad = fit_quad(points, least)
            if quad is None:
                continue
            # Pixel centres to pixel borders, outward by half a pixel, and to the whole image.
            centre = quad.mean(axis=0)
            away = quad - centre
            quad = (quad + 0.5 + away / np.hypot(*away.T)[:, None] * np.sqrt(2) * 0.5) * factor
            read = decode(image, quad)
            if read is not None:
                found.append((read[0], refine(image, read[1]), read[2]))
    kept: list[tuple[int, np.ndarray, int]] = []
    for marker, corners, wrong in sorted(found, key=lambda f: f[2]):
        side = np.hypot(*(np.roll(corners, -1, axis=0) - corners).T).mean()
        if not any(k == marker and np.hypot(*(c.mean(axis=0) - corners.mean(axis=0))) < 0.5 * side for k, c, _ in kept):
            kept.append((marker, corners, wrong))
    return [(m, c) for m, c, _ in kept]
