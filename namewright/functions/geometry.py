"""Strip geometry and homographies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the printed layout, in millimetres.
STRIP_WIDTH, HEADER_Y, SLOT_PITCH, SLOT_X0, SLOT_X1, SLOT_INSET = 70.0, 25.0, 10.0, 4.5, 65.5, 0.5
STOP_ID, STOP_OFFSET, STOP_SIZE, STOP_CENTRE_X = 40, 3.0, 30.0, 35.0
HEADER_X = {"left": (6.0, 24.0), "right": (46.0, 64.0)}
HEADER_ROWS = (3.5, 21.5)


def marker_id(column: Column, side: str) -> Column:
    return 2 * (column - 1) + (0 if side == "left" else 1)


def marker_column(marker: Column) -> Column:
    return F.floor(marker / 2) + 1


def slot_box(slot: Column, pad: float = 0.0) -> Column:
    top = HEADER_Y + SLOT_PITCH * (slot - 1)
    return F.struct(F.lit(SLOT_X0).alias("x0"), (top + SLOT_INSET - pad).alias("y0"), F.lit(SLOT_X1).alias("x1"), (top + SLOT_PITCH - SLOT_INSET + pad).alias("y1"))


def stop_slot(y_top: Column) -> Column:
    """The slot of a stop card whose marker's top edge is at y_top; it ends the column before itself. Halves away from zero."""
    return F.round((y_top - STOP_OFFSET - HEADER_Y) / SLOT_PITCH).cast("long") + 1


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def header_corners(side: str) -> np.ndarray:
    (x0, x1), (y0, y1) = HEADER_X[side], HEADER_ROWS
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def fit_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The least-squares 3 x 3 homography of four or more pairs by the normalised direct linear transform, else None."""
    source, target = np.asarray(source, np.float64), np.asarray(target, np.float64)
    if len(source) < 4 or len(source) != len(target):
        return None
    frames = []
    for points in (source, target):
        centre = points.mean(axis=0)
        spread = np.hypot(*(points - centre).T).mean()
        if spread < 1e-12:
            return None
        s = np.sqrt(2) / spread
        frames.append((np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]]), (points - centre) * s))
    (ts, p), (td, q) = frames
    one, none = np.ones(len(p)), np.zeros((len(p), 3))
    homogeneous = np.column_stack([p, one])
    rows = np.concatenate([np.hstack([-homogeneous, none, q[:, :1] * homogeneous]), np.hstack([none, -homogeneous, q[:, 1:] * homogeneous])])
    h = np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 3)
    m = np.linalg.inv(td) @ h @ ts
    return None if abs(m[2, 2]) < 1e-12 else m / m[2, 2]


def project(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    points = np.asarray(points, np.float64)
    x, y, z = m @ np.column_stack([points, np.ones(len(points))]).T
    return np.column_stack([x / z, y / z])


def project_column(m: Column, x: Column, y: Column) -> Column:
    """A point through a row-major array of nine numbers."""
    at = lambda i: F.get(m, F.lit(i))
    z = at(6) * x + at(7) * y + at(8)
    return F.struct(((at(0) * x + at(1) * y + at(2)) / z).alias("x"), ((at(3) * x + at(4) * y + at(5)) / z).alias("y"))
