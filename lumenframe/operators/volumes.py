"""The data model: one row per image, or one row per voxel.

An image row holds image_id, dims (array of 3 ints), voxels (flat, x fastest), origin and spacing (arrays of 3 doubles, mm),
direction (array of 9 doubles, row by row), and any further metadata columns, which operators carry along.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def images_from_vectors(vectors: DataFrame, dims: Sequence[int] = (4, 4, 4), spacing: Sequence[float] = (1, 1, 1), origin: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Vectors of fixed length as small volumes; rows of another length or with a null vector are left out."""
    n = dims[0] * dims[1] * dims[2]
    fits = vectors.where(F.size("embedding") == n)
    return fits.select(F.col("vec_id").alias("image_id"), "label", ints(dims).alias("dims"), F.col("embedding").alias("voxels"), doubles(origin).alias("origin"), doubles(spacing).alias("spacing"), doubles(IDENTITY).alias("direction"))


def voxel_rows(images: DataFrame, *keep: str) -> DataFrame:
    """image_id, kept columns, x, y, z (from 1), f (flat, from 0), value double: one row per voxel, without a shuffle."""
    nx, ny = F.col("dims")[0], F.col("dims")[1]
    rows = images.select("image_id", *keep, "dims", F.posexplode("voxels").alias("f", "v"))
    at = {"x": F.col("f") % nx + 1, "y": F.floor(F.col("f") / nx) % ny + 1, "z": F.floor(F.col("f") / (nx * ny)) + 1}
    return rows.select("image_id", *keep, *(c.cast("int").alias(k) for k, c in at.items()), "f", F.col("v").cast("double").alias("value"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, also when the body uses it once per voxel."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(voxels: str | Column) -> Column:
    """Sum in double precision; nulls don't occur in volumes."""
    return F.aggregate(voxels, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def mean(voxels: str | Column) -> Column:
    return total(voxels) / F.size(voxels)


def sample_std(voxels: str | Column, centre: Column) -> Column:
    """Standard deviation with n - 1, around a given mean; null for fewer than two voxels."""
    squares = F.aggregate(voxels, F.lit(0.0), lambda acc, v: acc + (v.cast("double") - centre) * (v.cast("double") - centre))
    return F.sqrt(squares / F.nullif(F.size(voxels) - 1, F.lit(0)))


def corner_values(voxels: str, dims: str) -> Column:
    """The eight corners, x outermost and z innermost."""
    d = F.col(dims)
    flat = lambda x, y, z: x + d[0] * (y + d[1] * z)
    ends = [(F.lit(0), d[i] - 1) for i in range(3)]
    return F.array(*[F.element_at(voxels, flat(x, y, z) + 1) for x in ends[0] for y in ends[1] for z in ends[2]])


def corners_median(voxels: str, dims: str) -> Column:
    """Mean of the middle two corners: the default outside of a volume."""
    s = F.array_sort(corner_values(voxels, dims))
    return (s[3].cast("double") + s[4].cast("double")) / 2


def with_voxels(images: DataFrame, voxels: Column) -> DataFrame:
    """Replace the voxels, keep everything else."""
    return images.withColumn("voxels", voxels)


def with_geometry(images: DataFrame, **columns: Column) -> DataFrame:
    """Replace any of voxels, dims, origin, spacing and direction together, all from the old row."""
    return images.withColumns(columns)


def rounded_cast(voxels: str, kind: str) -> Column:
    """Cast to another element type; integers are rounded half to even first."""
    whole = kind in ("byte", "tinyint", "short", "smallint", "int", "integer", "long", "bigint")
    return F.transform(voxels, lambda v: (F.rint(v) if whole else v).cast(kind))
