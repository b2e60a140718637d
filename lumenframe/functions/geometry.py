"""Matrices and orientations, worked out on the driver from constants; nothing here needs Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: The eight orientation codes.
CODES = ("RPI", "LPI", "RAI", "LAI", "RPS", "LPS", "RAS", "LAS")


def direction_signs(code: str) -> tuple[int, int, int]:
    """Diagonal of the direction matrix: L, P and S point along the axes, R, A and I against them."""
    if code not in CODES:
        raise ValueError(f"unknown orientation {code!r}")
    return tuple(1 if letter in "LPS" else -1 for letter in code)


def code_of(direction: Sequence[float], tolerance: float = 1e-6) -> str:
    """The code of a diagonal direction matrix (nine numbers, row by row); oblique ones are an error."""
    d = np.asarray(direction, float).reshape(3, 3)
    if np.abs(np.abs(d) - np.eye(3)).max() > tolerance:
        raise ValueError("an oblique direction has no orientation code")
    return "".join(pair[0 if s > 0 else 1] for pair, s in zip(("LR", "PA", "SI"), np.diag(d), strict=True))


def index_to_physical(spacing: Sequence[float], direction: Sequence[float]) -> np.ndarray:
    """Direction times diagonal spacing; zero spacing or a singular direction is an error."""
    m = np.asarray(direction, float).reshape(3, 3) @ np.diag(spacing)
    if 0 in list(spacing) or abs(np.linalg.det(m)) < 1e-300:
        raise ValueError("spacing and direction must not be singular")
    return m


def rotation(axis: int, degrees: float, direction: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> np.ndarray:
    """Rodrigues rotation by degrees about the image's axis 1, 2 or 3: a column of its direction."""
    k = np.asarray(direction, float).reshape(3, 3)[:, axis - 1]
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    a = math.radians(degrees)
    return np.eye(3) + math.sin(a) * cross + (1 - math.cos(a)) * cross @ cross


def homogeneous(m: np.ndarray, shift: Sequence[float] = (0, 0, 0)) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = m, shift
    return out


def affine_matrix(translation: Sequence[float] = (0, 0, 0), rotate: Sequence[float] = (0, 0, 0), scale: Sequence[float] = (1, 1, 1), shear: Sequence[float] = (0, 0, 0)) -> np.ndarray:
    """Translation * rotation * shear * scale; rotation is Rz * Ry * Rx in degrees, shear fills xy, xz and yz."""
    rx, ry, rz = (rotation(i + 1, a) for i, a in enumerate(rotate))
    sheared = np.array([[1, shear[0], shear[1]], [0, 1, shear[2]], [0, 0, 1.0]])
    return homogeneous(np.eye(3), translation) @ homogeneous(rz @ ry @ rx) @ homogeneous(sheared) @ homogeneous(np.diag(scale))


def compose(*matrices: np.ndarray) -> np.ndarray:
    """One matrix that applies the given ones in order, the first first: a chain of transforms samples once."""
    result = np.eye(4)
    for m in matrices:
        result = m @ result
    return result


def fixed_to_moving(fixed: tuple, moving: tuple) -> np.ndarray:
    """Pull-back matrix in positions counted from 1: a voxel of `fixed` to a place in `moving`. Each: (origin, spacing, direction)."""
    (of, sf, df), (om, sm, dm) = fixed, moving
    back = np.linalg.inv(index_to_physical(sm, dm))
    a = back @ index_to_physical(sf, df)
    t = back @ (np.asarray(of, float) - np.asarray(om, float))
    return homogeneous(a, t - a @ np.ones(3) + 1)
