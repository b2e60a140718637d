"""Chains of transforms that are worked out as one: nothing is sampled before the end, and then once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry
from lumenframe.operators.spatial import sampled
from lumenframe.operators.volumes import corners_median

#: dims, origin, spacing and direction of a grid.
Grid = tuple[tuple[int, ...], tuple[float, ...], tuple[float, ...], tuple[float, ...]]


def about(turn: np.ndarray, centre: Sequence[float]) -> np.ndarray:
    """A 4 x 4 matrix applied about a centre."""
    c = geometry.homogeneous(np.eye(3), centre)
    return c @ turn @ np.linalg.inv(c)


class Chain:
    """Pending transforms of image rows. Each step maps a grid to a new one and the new grid's positions (from 1) to the old one's.

    Steps are kept as functions of a row's own grid; done() multiplies their matrices and samples every volume once at the product, so no step rounds, cuts or
    interpolates what a later one needs. Steps have the rules of the functions of their name in `spatial`, which sample at each call.
    """

    def __init__(self, images: DataFrame, steps: tuple[Callable[[Grid], tuple[np.ndarray, Grid]], ...] = ()) -> None:
        self.images, self.steps = images, steps

    def then(self, step: Callable[[Grid], tuple[np.ndarray, Grid]]) -> Chain:
        """Any further step: grid -> (pull-back matrix, new grid)."""
        return Chain(self.images, (*self.steps, step))

    def rotate(self, axis: int, degrees: float) -> Chain:
        """About the physical centre, position size / 2 + 1."""

        def step(grid: Grid) -> tuple[np.ndarray, Grid]:
            dims, _, spacing, direction = grid
            m = geometry.index_to_physical(spacing, direction)
            return about(geometry.homogeneous(np.linalg.inv(m) @ geometry.rotation(axis, degrees, direction) @ m), [n / 2 + 1 for n in dims]), grid

        return self.then(step)

    def affine(self, matrix: np.ndarray, centre: Sequence[float] | None = None) -> Chain:
        """A matrix that maps old positions to new ones about size / 2 or the centre."""
        if abs(np.linalg.det(matrix)) < 1e-300:
            raise ValueError("the affine matrix is singular")
        back = np.linalg.inv(matrix)
        return self.then(lambda grid: (about(back, centre if centre is not None else [n / 2 for n in grid[0]]), grid))

    def scale(self, factors: Sequence[float]) -> Chain:
        """New size round(old * factor); spacing and origin are kept."""

        def step(grid: Grid) -> tuple[np.ndarray, Grid]:
            dims = tuple(int(n) for n in np.rint(np.array(grid[0]) * factors))
            return about(geometry.homogeneous(np.diag([1 / f for f in factors])), (1, 1, 1)), (dims, *grid[1:])

        return self.then(step)

    def resample(self, spacing: Sequence[float]) -> Chain:
        """New size ceil(old size * old / new spacing); origin and direction are kept."""

        def step(grid: Grid) -> tuple[np.ndarray, Grid]:
            dims, origin, old, direction = grid
            new = tuple(int(np.ceil(n * s / t)) for n, s, t in zip(dims, old, spacing, strict=True))
            return about(geometry.homogeneous(np.diag([t / s for s, t in zip(old, spacing, strict=True)])), (1, 1, 1)), (new, origin, tuple(map(float, spacing)), direction)

        return self.then(step)

    def crop(self, begin: Sequence[int], size: Sequence[int]) -> Chain:
        """The box of `size` voxels from `begin` (from 0); negative begins and long sizes pad."""

        def step(grid: Grid) -> tuple[np.ndarray, Grid]:
            _, origin, spacing, direction = grid
            moved = tuple(o + s * b * direction[4 * i] for i, (o, s, b) in enumerate(zip(origin, spacing, begin, strict=True)))
            return geometry.homogeneous(np.eye(3), begin), (tuple(size), moved, spacing, direction)

        return self.then(step)

    def translate(self, voxels: int, axis: int) -> Chain:
        """Moves the origin alone."""

        def step(grid: Grid) -> tuple[np.ndarray, Grid]:
            dims, origin, spacing, direction = grid
            return np.eye(4), (dims, tuple(o + (voxels * s if i == axis - 1 else 0.0) for i, (o, s) in enumerate(zip(origin, spacing, strict=True))), spacing, direction)

        return self.then(step)

    def plan(self) -> Column:
        """struct(matrix, dims, origin, spacing): the product of all steps for each row's grid, worked out once for rows of equal grids."""
        steps = self.steps

        @F.pandas_udf("struct<matrix: array<double>, dims: array<int>, origin: array<double>, spacing: array<double>>")
        def product(d: pd.Series, o: pd.Series, s: pd.Series, r: pd.Series) -> pd.DataFrame:
            known: dict[tuple, tuple] = {}
            rows = []
            for row in zip(d, o, s, r, strict=True):
                key = tuple(tuple(map(float, x)) for x in row)
                if key not in known:
                    matrix, grid = np.eye(4), (tuple(int(n) for n in key[0]), *key[1:])
                    for step in steps:
                        pull, grid = step(grid)
                        matrix = matrix @ pull
                    known[key] = matrix.reshape(-1).tolist(), list(grid[0]), list(map(float, grid[1])), list(map(float, grid[2]))
                rows.append(known[key])
            return pd.DataFrame(rows, columns=["matrix", "dims", "origin", "spacing"])

        return product("dims", "origin", "spacing", "direction")

    def done(self, mode: str = "linear", fill: Column | None = None, kind: str = "float") -> DataFrame:
        """The images on the last grid, each sampled once; outside stands the median of the image's own corners unless fill is given."""
        rows = self.images.withColumn("_p", self.plan())
        outside = fill if fill is not None else corners_median("voxels", "dims")
        zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        new = sampled(F.col("voxels"), F.col("dims"), F.col("_p.matrix"), zero, F.col("_p.dims"), outside, mode, kind)
        return rows.withColumns({"voxels": new, "dims": F.col("_p.dims"), "origin": F.col("_p.origin"), "spacing": F.col("_p.spacing")}).drop("_p")
