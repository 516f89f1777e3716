"""Array kernels over gray images (2-D uint8 arrays), for use inside Arrow-batched maps.

An image travels in DataFrames as BINARY pixels with its width and height; ``image_of`` and ``pixels_of`` convert.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the line finder, in millimetres.
PX_PER_MM = 12.0
TEXT_CENTER_BELOW_TOP, TEXT_SEARCH_MM, TEXT_CORE_MM, SECOND_LINE_MM = 5.4, 2.5, 3.0, 2.0
NAME_GAP_MM, COST_ZONE_MM = 3.5, 22.0
LEAST_CONTRAST, MEANS_ROUNDS = 30.0, 10


def image_of(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def pixels_of(image: np.ndarray) -> bytes:
    return np.ascontiguousarray(image, np.uint8).tobytes()


def luma(bgr: np.ndarray) -> np.ndarray:
    """Gray values of a (height, width, 1, 3 or 4) image whose channels are blue, green, red."""
    if bgr.shape[2] == 1:
        return bgr[:, :, 0]
    return np.floor(bgr[:, :, :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at fractional places, those beyond the border taken from it; integer places hit pixels."""
    h, w = image.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    v = image.astype(np.float64) if image.size < 1 << 16 else image
    top = v[y0, x0] + (v[y0, x1].astype(np.float64) - v[y0, x0]) * fx
    low = v[y1, x0] + (v[y1, x1].astype(np.float64) - v[y1, x0]) * fx
    return top + (low - top) * fy


def downscale(image: np.ndarray, factor: int) -> np.ndarray:
    """Means of factor x factor blocks, truncated; left-over rows and columns are dropped."""
    if factor == 1:
        return image
    h, w = image.shape[0] // factor, image.shape[1] // factor
    blocks = image[: h * factor, : w * factor].reshape(h, factor, w, factor)
    return (blocks.sum(axis=(1, 3), dtype=np.int64) // factor**2).astype(np.uint8)


def integral(image: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums with one more row and column."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    out[1:, 1:] = image.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    return out


def adaptive_threshold_inv(image: np.ndarray, radius: int, c: float) -> np.ndarray:
    """255 where a pixel is darker than the mean of its clipped window by more than ``c``."""
    h, w = image.shape
    sums = integral(image)
    y, x = np.arange(h), np.arange(w)
    y0, y1 = np.maximum(y - radius, 0), np.minimum(y + radius + 1, h)
    x0, x1 = np.maximum(x - radius, 0), np.minimum(x + radius + 1, w)
    rows = sums[y1] - sums[y0]
    total = rows[:, x1] - rows[:, x0]
    mean = total / ((y1 - y0)[:, None] * (x1 - x0))
    return np.where(image < mean - c, 255, 0).astype(np.uint8)


def warp_rect(image: np.ndarray, to_image: np.ndarray, rect: tuple[float, float, float, float], ppm: float) -> np.ndarray:
    """The rectangle (x0, y0, x1, y1) in millimetres, resampled at ``ppm`` pixels a millimetre; to_image is 3 x 3."""
    x0, y0, x1, y1 = rect
    w, h = max(1, int(np.floor((x1 - x0) * ppm + 0.5))), max(1, int(np.floor((y1 - y0) * ppm + 0.5)))
    u, v = np.meshgrid(x0 + (np.arange(w) + 0.5) / ppm, y0 + (np.arange(h) + 0.5) / ppm)
    x, y, z = (to_image[i, 0] * u + to_image[i, 1] * v + to_image[i, 2] for i in range(3))
    return np.floor(bilinear(image, x / z - 0.5, y / z - 0.5) + 0.5).astype(np.uint8)


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def clahe(image: np.ndarray, tiles_x: int, tiles_y: int, clip_limit: float) -> np.ndarray:
    """Histogram equalisation by tiles with clipped bins, blended between tile centres."""
    h, w = image.shape
    tiles_x, tiles_y = min(max(tiles_x, 1), max(w, 1)), min(max(tiles_y, 1), max(h, 1))
    tw, th = -(-w // tiles_x), -(-h // tiles_y)
    tables = np.zeros((tiles_y, tiles_x, 256))
    for ty in range(tiles_y):
        for tx in range(tiles_x):
            tile = image[ty * th : min((ty + 1) * th, h), tx * tw : min((tx + 1) * tw, w)]
            n = max(tile.size, 1)
            clip = max(int(clip_limit * n / 256), 1)
            bins = np.bincount(tile.ravel(), minlength=256)
            excess = int((bins - np.minimum(bins, clip)).sum())
            bins = np.minimum(bins, clip) + excess // 256 + (np.arange(256) < excess % 256)
            tables[ty, tx] = np.minimum(np.floor(bins.cumsum() * 255 / n + 0.5), 255)
    fy = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles_y - 1)
    fx = np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles_x - 1)
    ty, tx = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = (fy - ty)[:, None], fx - tx
    at = lambda i, j: tables[np.minimum(ty + i, tiles_y - 1)[:, None], np.minimum(tx + j, tiles_x - 1), image]
    top, low = at(0, 0) * (1 - ax) + at(0, 1) * ax, at(1, 0) * (1 - ax) + at(1, 1) * ax
    return np.floor(top * (1 - ay) + low * ay + 0.5).astype(np.uint8)


def two_means(values: np.ndarray) -> float | None:
    """The threshold half way between the means of the dark and the light values, or None for low contrast."""
    values = np.asarray(values, np.float64)
    if values.max() - values.min() < LEAST_CONTRAST:
        return None
    t = (values.max() + values.min()) / 2
    for _ in range(MEANS_ROUNDS):
        light = values > t
        if light.all() or not light.any():
            break
        t = (values[light].mean() + values[~light].mean()) / 2
    return float(t)


def text_rows(band: np.ndarray, band_y0: float, card_top: float, height_mm: float, ppm: float = PX_PER_MM) -> list[tuple[int, int, float]]:
    """(y0, y1, centre in mm) of the best text line near where a card's name is, and of a second one if there is.

    A line is where gradient energy along rows peaks; of equal peaks the last wins. The second must be a local maximum
    at least 2 mm from the first.
    """
    h = band.shape[0]
    energy = np.abs(np.diff(band.astype(np.int64), axis=1)).sum(axis=1)
    prefix = np.concatenate([[0], energy.cumsum()])
    row = lambda mm: int(np.floor(abs((mm - band_y0) * ppm) + 0.5) * np.sign(mm - band_y0))
    nominal = card_top + TEXT_CENTER_BELOW_TOP
    centres = np.arange(row(nominal - TEXT_SEARCH_MM), row(nominal + TEXT_SEARCH_MM) + 1)
    core, half = int(TEXT_CORE_MM / 2 * ppm), int(height_mm / 2 * ppm)
    found = prefix[np.clip(centres + core, 0, h)] - prefix[np.clip(centres - core, 0, h)]
    last_max = lambda at: int(at[len(at) - 1 - found[at][::-1].argmax()])
    best = last_max(np.arange(len(centres)))
    inner = np.arange(1, len(centres) - 1)
    peaks = inner[(found[inner] >= found[inner - 1]) & (found[inner] >= found[inner + 1]) & (np.abs(centres[inner] - centres[best]) >= int(SECOND_LINE_MM * ppm))]
    out = []
    for k in [best, *([last_max(peaks)] if len(peaks) else [])]:
        y0 = min(max(int(centres[k]) - half, 0), h - 1)
        out.append((y0, min(max(int(centres[k]) + half, y0 + 1), h), band_y0 + float(centres[k]) / ppm))
    return out


def text_right_end(crop: np.ndarray, ppm: float = PX_PER_MM) -> int:
    """The column after the name: left of a blank run of NAME_GAP_MM whose right end is in the rightmost COST_ZONE_MM.

    Without such a run, or where ink goes on left of that zone before one, the whole width is kept.
    """
    w = crop.shape[1]
    energy = np.concatenate([np.abs(np.diff(crop.astype(np.int64), axis=1)).sum(axis=0), [0]]).astype(np.float64)
    r = int(0.25 * ppm)
    sums = np.concatenate([[0.0], energy.cumsum()])
    lo, hi = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    smooth = (sums[hi] - sums[lo]) / (hi - lo)
    ordered = np.sort(smooth)
    floor, peak = (ordered[int((w - 1) * q)] for q in (0.1, 0.95))
    if peak - floor < 1e-9:
        return w
    blank = smooth <= floor + 0.2 * (peak - floor)
    gap, zone = int(NAME_GAP_MM * ppm), int(max(w - COST_ZONE_MM * ppm, 0))
    # Blank runs [start, end], from the right.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], blank.astype(np.int8), [0]])))
    runs = [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)][::-1]
    inked = np.flatnonzero(~blank)
    for start, end in runs:
        # Ink left of the zone and right of this run ends the search.
        if (inked[(inked > end)] < zone).any():
            return w
        if end - start + 1 >= gap and end >= zone:
            return w if start == 0 else max(min(start + int(ppm), w), 1)
    return w


def crop_variant(band: np.ndarray, band_y0: float, card_top: float, shift: float, variant: str, height_mm: float | None = 6.4, trim: bool = True, clahe_clip: float | None = None, tiles: tuple[int, int] = (8, 2)) -> tuple[np.ndarray, float] | None:
    """(crop, offset of its line in mm) of a slot's band, or None where the variant does not exist.

    Variants: primary, inverted, second (the other text line) and untrimmed (only where trimming cuts something).
    """
    offset, crop = shift, band
    if height_mm is not None:
        lines = text_rows(band, band_y0, card_top + shift, height_mm)
        place = 1 if variant == "second" else 0
        if place >= len(lines):
            return None
        y0, y1, centre = lines[place]
        offset, crop = centre - (card_top + TEXT_CENTER_BELOW_TOP), band[y0:y1]
    elif variant == "second":
        return None
    if trim:
        end = text_right_end(crop)
        if variant == "untrimmed":
            if end >= crop.shape[1]:
                return None
        else:
            crop = crop[:, :end]
    elif variant == "untrimmed":
        return None
    if clahe_clip is not None:
        crop = clahe(crop, *tiles, clahe_clip)
    return (invert(crop) if variant == "inverted" else crop), offset


def resize_triangle(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampling with a triangle filter whose support grows when shrinking."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m) + 0.5) * n / m
        far = np.abs((np.arange(n) + 0.5) - centre[:, None]) / scale
        w = np.maximum(1 - far, 0)
        return w / w.sum(axis=1, keepdims=True)

    out = weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def reader_input(lines: list[np.ndarray], height: int = 48, max_width: int = 640, width_scale: float = 1.0, channels: int = 3) -> np.ndarray:
    """A batch (n, channels, height, width) for a line reader: resized, scaled to [-1, 1] and padded to a multiple of 8."""
    sized = []
    for line in lines:
        w = int(np.floor(width_scale * line.shape[1] * height / max(line.shape[0], 1) + 0.5))
        sized.append(resize_triangle(line, min(max(w, height // 2), max_width), height))
    width = -(-max((s.shape[1] for s in sized), default=height) // 8) * 8
    out = np.zeros((len(lines), channels, height, width), np.float32)
    for k, s in enumerate(sized):
        out[k, :, :, : s.shape[1]] = s / np.float32(127.5) - 1
    return out


def ctc_greedy(probabilities: np.ndarray, letters: list[str]) -> tuple[str, float]:
    """(text, mean probability of what is emitted) from steps x classes, class 0 being blank; of equal classes the last wins."""
    classes = probabilities.shape[1]
    best = classes - 1 - probabilities[:, ::-1].argmax(axis=1)
    emits = (best > 0) & np.concatenate([[True], best[1:] != best[:-1]])
    text = "".join(letters[c - 1] if c - 1 < len(letters) else "" for c in best[emits])
    return text.strip(), float(probabilities[emits, best[emits]].mean()) if emits.any() else 0.0


def batch_sizes(n: int, workers: int, most: int = 4) -> int:
    """Lines per reader call: enough calls for all workers, at most ``most`` lines each."""
    return max(1, min(most, -(-n // max(workers, 1))))
