"""A pinhole camera over a flat scene, and a light and sensor model: test photos of markers and slots."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from namewright.functions import geometry as g
from namewright.functions import markers
from namewright.functions.kernels import bilinear

#: Bytes of the sensor's grid that are mapped at a time.
BAND_ROWS = 256
STAMP_OVERLAP = 0.45


def rotation(tilt: float, direction: float, yaw: float) -> np.ndarray:
    """World to camera, in degrees: a turn about the optical axis, then a tilt towards ``direction``."""

    def turn(axis: int, degrees: float) -> np.ndarray:
        a, (i, j) = np.deg2rad(degrees), [k for k in range(3) if k != axis]
        out = np.eye(3)
        out[[i, j], [i, j]] = np.cos(a)
        out[i, j], out[j, i] = -np.sin(a), np.sin(a)
        return out

    return turn(2, direction) @ turn(0, tilt) @ turn(2, -direction) @ turn(2, yaw)


@dataclass
class Camera:
    """Focal length in pixels, rotation, centre above the plane z = 0 (z < 0) in mm, and one radial distortion term."""

    width: int
    height: int
    focal: float
    turn: np.ndarray
    centre: np.ndarray
    k1: float = 0.0

    @classmethod
    def over(cls, target: tuple[float, float], distance: float, width: int, height: int, focal: float, tilt: float = 0.0, direction: float = 0.0, yaw: float = 0.0, k1: float = 0.0) -> Camera:
        """The camera whose optical axis meets the plane at ``target`` from ``distance`` mm above it."""
        turn = rotation(tilt, direction, yaw)
        axis = turn.T @ np.array([0.0, 0.0, 1.0])
        return cls(width, height, focal, turn, np.array([*target, 0.0]) - axis * (distance / axis[2]), k1)

    @property
    def middle(self) -> np.ndarray:
        return np.array([self.width / 2, self.height / 2])

    def plane(self, z: float = 0.0) -> np.ndarray:
        """The homography from the plane at depth z to undistorted pixels."""
        k = np.array([[self.focal, 0, self.width / 2], [0, self.focal, self.height / 2], [0, 0, 1]])
        return k @ np.column_stack([self.turn[:, 0], self.turn[:, 1], self.turn[:, 2] * z - self.turn @ self.centre])

    def project(self, points: np.ndarray) -> np.ndarray:
        """Points of the plane (n x 2) or of space (n x 3) to distorted pixels."""
        points = np.asarray(points, np.float64)
        space = np.column_stack([points, np.zeros(len(points))]) if points.shape[1] == 2 else points
        seen = (space - self.centre) @ self.turn.T
        flat = seen[:, :2] / seen[:, 2:]
        return flat * (1 + self.k1 * (flat**2).sum(axis=1, keepdims=True)) * self.focal + self.middle

    def undistorted(self, pixels: np.ndarray) -> np.ndarray:
        """Distorted to undistorted pixels, by six fixed-point steps."""
        seen = (np.asarray(pixels, np.float64) - self.middle) / self.focal
        flat = seen
        for _ in range(6 if self.k1 else 0):
            flat = seen / (1 + self.k1 * (flat**2).sum(axis=-1, keepdims=True))
        return flat * self.focal + self.middle

    def photograph(self, scene: np.ndarray, ppm: float, origin: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
        """The view of a gray scene that lies on the plane, ``ppm`` pixels a mm, its first pixel at ``origin``."""
        back = np.linalg.inv(self.plane())
        out = np.empty((self.height, self.width), np.uint8)
        for top in range(0, self.height, BAND_ROWS):
            v, u = np.mgrid[top : min(top + BAND_ROWS, self.height), 0 : self.width]
            flat = self.undistorted(np.stack([u, v], axis=-1))
            x, y, z = (back[i, 0] * flat[..., 0] + back[i, 1] * flat[..., 1] + back[i, 2] for i in range(3))
            out[top : top + BAND_ROWS] = np.floor(bilinear(scene, (x / z - origin[0]) * ppm - 0.5, (y / z - origin[1]) * ppm - 0.5) + 0.5)
        return out


def sample_camera(rng: np.random.Generator, size: tuple[int, int], frame_mm: float, target: tuple[float, float], points: np.ndarray, tilt: float, yaw: float, decentre: float, k1: float, tries: int = 200) -> Camera:
    """A random camera that has all points (mm) in its frame with 5 mm to spare; an error after ``tries``."""
    width, height = size
    for _ in range(tries):
        lens = rng.uniform(23.5, 27.5)
        focal, distance = width * lens / 34.6, round(frame_mm * lens / 34.6 / 10) * 10 + rng.uniform(-2, 2)
        at = tuple(t + rng.uniform(-decentre, decentre) for t in target)
        camera = Camera.over(at, distance, width, height, focal, rng.uniform(0, tilt), rng.uniform(0, 360), rng.uniform(-yaw, yaw), rng.uniform(-k1, k1))
        seen, edge = camera.project(points), 5 * focal / distance
        if (seen >= edge).all() and (seen <= np.array([width, height]) - edge).all():
            return camera
    raise RuntimeError("no camera has all points in its frame")


def expose(image: np.ndarray, rng: np.random.Generator, exposure: float = 1.0, gradient: tuple[float, float] = (0.0, 0.0), vignette: float = 0.0, glare: list[tuple[float, float, float, float]] | None = None, shot: float = 0.0, read: float = 0.0) -> np.ndarray:
    """Uneven light, darker corners, glare spots (x, y, radius, strength) and sensor noise on a gray image."""
    h, w = image.shape
    v, u = np.mgrid[-1 : 1 : h * 1j, -1 : 1 : w * 1j]
    corner = (u**2 * (w / h) ** 2 + v**2) / (1 + (w / h) ** 2) * 2
    light = image * exposure * (1 + gradient[0] * u + gradient[1] * v) * (1 - vignette * corner / 2)
    y, x = np.mgrid[0:h, 0:w]
    spots = sum((s * np.exp(-((x - gx) ** 2 + (y - gy) ** 2) / (2 * r * r)) for gx, gy, r, s in glare or []), np.zeros((h, w)))
    light = light + (255 - light) * np.minimum(spots, 0.95)
    noisy = light + rng.standard_normal((h, w)) * np.sqrt(read**2 + shot * np.maximum(light, 0))
    return np.clip(noisy + 0.5, 0, 255).astype(np.uint8)


def strip_scene(counts: list[int], stops: list[bool], ppm: float, hidden: set[int] | None = None, margin: float = 5.0) -> np.ndarray:
    """A flat scene of strips: header markers (those in ``hidden`` left out), a dark line per card and stop cards."""
    image = np.full((int(245 * ppm), int((len(counts) * g.STRIP_WIDTH + 2 * margin) * ppm)), 235, np.uint8)

    def put(marker: int, x: float, y: float, side: float) -> None:
        tile = markers.render(marker, cell=int(side * ppm / 6), quiet=0)
        row, col = int(y * ppm), int(x * ppm)
        image[row : row + len(tile), col : col + len(tile)] = tile

    for j, (n, stop) in enumerate(zip(counts, stops, strict=True)):
        left = j * g.STRIP_WIDTH + margin
        for k, side in enumerate(("left", "right")):
            if 2 * j + k not in (hidden or set()):
                put(2 * j + k, left + g.HEADER_X[side][0], g.HEADER_ROWS[0], g.HEADER_X[side][1] - g.HEADER_X[side][0])
        for slot in range(n):
            y = int((g.HEADER_Y + g.SLOT_PITCH * slot + 5.4) * ppm)
            image[y - 5 : y + 5, int((left + 8) * ppm) : int((left + 30) * ppm) : 3] = 30
        if stop:
            put(g.STOP_ID, left + g.STOP_CENTRE_X - g.STOP_SIZE / 2, g.HEADER_Y + g.SLOT_PITCH * n + g.STOP_OFFSET, g.STOP_SIZE)
    return image


def stamped(crop: np.ndarray, template: np.ndarray, least: int = 200) -> bool:
    """Whether the light pixels of a crop overlap a template (intersection over union) by more than STAMP_OVERLAP."""
    light = crop > least
    union = np.logical_or(light, template).sum()
    return bool(union and np.logical_and(light, template).sum() / union > STAMP_OVERLAP)
