"""Masks, regions and per-image reductions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import kernels


def nonzero(value: str | Column) -> Column:
    """The mask test: any value but zero, negative ones included."""
    return (F.col(value) if isinstance(value, str) else value) != 0


def of_volume(schema: str, measure: Callable[[np.ndarray], object], *columns: str | Column) -> Column:
    """measure(volumes) per row, volumes being (z, y, x) arrays in double precision of the flat columns; null where one is null.

    The last column is the shape. measure returns a number, a flat array or, for a struct, its values in order.
    """

    def each(series: tuple[pd.Series, ...]) -> list:
        out = []
        for *flat, dims in zip(*series, strict=True):
            there = dims is not None and all(x is not None for x in flat)
            out.append(measure(*(np.asarray(x, float).reshape([int(k) for k in reversed(dims)]) for x in flat)) if there else None)
        return out

    if schema.startswith("struct"):
        names = [part.split(":")[0].strip() for part in schema[7:-1].split(",")]

        @F.pandas_udf(schema)
        def measured(*series: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([[None] * len(names) if x is None else list(x) for x in each(series)], columns=names)

    else:

        @F.pandas_udf(schema)
        def measured(*series: pd.Series) -> pd.Series:
            return pd.Series(each(series), dtype=object)

    return measured(*columns)


def map_voxels(images: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Any function of whole volumes, (z, y, x) arrays, that keeps their shape: the library's door for a user's own operators."""
    return images.withColumn("voxels", of_volume("array<double>", lambda v: np.asarray(change(v), float).reshape(-1), "voxels", "dims"))


def barycenter(images: DataFrame, *by: str) -> DataFrame:
    """Per image (and channel, or whatever else `by` names) the mean position from 1, weighted by the mask's values, and the largest
    distance of a positive voxel from it: image_id, cx, cy, cz, radius. (0, 0, 0) if the values sum to zero; 0 for an empty mask."""
    found = of_volume("struct<cx: double, cy: double, cz: double, radius: double>", kernels.moments, "voxels", "dims")
    return images.select("image_id", *by, found.alias("_m")).select("image_id", *by, "_m.*")


def mask_points(images: DataFrame, most: int) -> DataFrame:
    """`most` points of each image's positive voxels, in flat order, evenly spread; missing ones are (-1, -1, -1).

    Rank round(1 + (k - 1) * (n - 1) / (most - 1)), half to even, of n points if there are more than `most`; the first one
    if most is 1. Works on image rows, without a shuffle.
    """
    hits = F.filter(F.transform("voxels", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    spread = lambda k, n: F.rint(1 + (k - 1) * (n - 1) / max(most - 1, 1)).cast("int")
    rows = images.select("image_id", "dims", hits.alias("hits")).select("*", F.size("hits").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    rank = F.when(F.col("n") > most, F.lit(1) if most == 1 else spread(F.col("k"), F.col("n"))).otherwise(F.col("k"))
    f = F.get("hits", rank - 1)
    nx, ny = F.col("dims")[0], F.col("dims")[1]
    at = {"x": f % nx + 1, "y": F.floor(f / nx) % ny + 1, "z": F.floor(f / (nx * ny)) + 1}
    return rows.select("image_id", "k", *(F.coalesce(c, F.lit(-1)).cast("int").alias(a) for a, c in at.items()))


def one_hot(images: DataFrame, classes: int) -> DataFrame:
    """A channel per class 1..classes: 1 where the rounded voxel is the class; class 0 is dropped."""
    plane = lambda c: F.struct(F.lit(c).alias("channel"), F.transform("voxels", lambda v: (F.rint(v) == c).cast("float")).alias("voxels"))
    planes = [plane(c) for c in range(1, classes + 1)]
    return images.withColumn("plane", F.explode(F.array(*planes))).withColumns({"channel": F.col("plane.channel"), "voxels": F.col("plane.voxels")}).drop("plane")


def region_volume(images: DataFrame) -> DataFrame:
    """cm3 of voxels above 0.5."""
    count = F.size(F.filter("voxels", lambda v: v > 0.5))
    return images.select("image_id", (count * F.col("spacing")[0] * F.col("spacing")[1] * F.col("spacing")[2] / 1000).alias("volume_cm3"))


def masked_stats(pairs: DataFrame, voxels: str, mask: str, factor: Column, strict: bool = False) -> DataFrame:
    """Total and mean of voxels under a mask (nonzero), times a factor; an empty mask gives zeros, a null factor nulls.

    strict raises where the factor is null. Arrays of different sizes are an error.
    """
    f = F.when(factor.isNull(), F.raise_error(F.lit("no uptake factor: metadata is missing")).cast("double")).otherwise(factor) if strict else factor

    @F.pandas_udf("struct<n: int, total: double>")
    def summed(v: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = []
        for x, k in zip(v, m, strict=True):
            if x is None or k is None:
                rows.append((None, None))
                continue
            if len(x) != len(k):
                raise ValueError("image and mask differ in shape")
            inside = np.asarray(k) != 0
            rows.append((int(inside.sum()), float(np.asarray(x, float)[inside].sum())))
        return pd.DataFrame(rows, columns=["n", "total"]).astype({"n": "Int64"})

    n, total = F.col("_s.n"), F.col("_s.total") * f
    rows = pairs.withColumn("_s", summed(voxels, mask))
    return rows.withColumns({"n_voxels": n, "total": F.when(n == 0, 0.0).otherwise(total), "mean": F.when(n == 0, 0.0).otherwise(total / n)}).drop("_s")


def projection(images: DataFrame, along: int = 2) -> DataFrame:
    """Maximum-intensity projection along axis 1, 2 or 3, divided by its 99.5th percentile and clamped to [0, 1]; that axis keeps one voxel."""

    def mip(volume: np.ndarray) -> np.ndarray:
        flat = volume.max(3 - along)
        return np.clip(flat / max(float(np.percentile(flat, 99.5)), 1e-12), 0, 1).reshape(-1)

    dims = F.transform("dims", lambda n, i: F.when(i == along - 1, 1).otherwise(n).cast("int"))
    return images.withColumns({"voxels": of_volume("array<double>", mip, "voxels", "dims"), "dims": dims})


def busiest_slice(images: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Adds z and activity: the slice with the largest positive sum among those from floor(low * depth) to floor(high * depth)
    (counted from 0; z counts from 1); the first of equals, to nine digits."""

    def busiest(volume: np.ndarray) -> tuple[int, float]:
        sums = np.maximum(volume, 0).sum((1, 2)).round(9)
        a, b = int(low * len(sums)), int(high * len(sums))
        z = a + int(sums[a : b + 1].argmax())
        return z + 1, float(sums[z])

    found = of_volume("struct<z: int, activity: double>", busiest, "voxels", "dims")
    return images.withColumn("_b", found).withColumns({"z": F.col("_b.z"), "activity": F.col("_b.activity")}).drop("_b")


def gradient_magnitude(images: DataFrame, eps: float = 1e-8) -> DataFrame:
    """sqrt(gx^2 + gy^2 + gz^2 + eps), central differences inside, 0 on the border of each axis."""
    return map_voxels(images, lambda v: kernels.gradient_magnitude(v, eps))


def one_sided_gradient(images: DataFrame, eps: float = 1e-6) -> DataFrame:
    """The size of directional_flux: sqrt(gx^2 + gy^2 + gz^2 + eps)."""
    return map_voxels(images, lambda v: np.sqrt(sum(kernels.flux(v, k) ** 2 for k in range(3)) + eps))


def directional_flux(images: DataFrame) -> DataFrame:
    """Adds flat arrays flux_x, flux_y and flux_z: the next voxel less the one before along each axis, the end voxel standing for what lies beyond."""
    found = of_volume("struct<flux_x: array<double>, flux_y: array<double>, flux_z: array<double>>", lambda v: tuple(kernels.flux(v, k).reshape(-1) for k in range(3)), "voxels", "dims")
    return images.withColumn("_f", found).select(*images.columns, "_f.*")


def endpoints(images: DataFrame, above: float = 0.1) -> DataFrame:
    """image_id and both ends (x1, y1, z1, x2, y2, z2, from 0) of the voxels above a threshold along their principal axis."""
    names = [f"{a}{k}" for k in (1, 2) for a in "xyz"]
    found = of_volume(f"struct<{', '.join(f'{n}: double' for n in names)}>", lambda v: kernels.endpoints(v, above), "voxels", "dims")
    return images.select("image_id", found.alias("_e")).select("image_id", "_e.*")


def split_channels(images: DataFrame) -> DataFrame:
    """One row per channel (from 1) of images whose voxels hold several volumes one after another; `channels` columns are dropped."""
    n = F.col("dims")[0] * F.col("dims")[1] * F.col("dims")[2]
    rows = images.withColumn("channel", F.explode(F.sequence(F.lit(1), F.floor(F.size("voxels") / n).cast("int"))))
    return rows.withColumn("voxels", F.slice("voxels", (F.col("channel") - 1) * n + 1, n)).drop("channels")


def join_channels(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """The inverse: an image's channels one after another again. An image's channels meet in one task, as its row is whole there."""
    others = [c for c in rows.columns if c not in (key, "channel", "voxels")]
    held = F.array_sort(F.collect_list(F.struct("channel", "voxels")))
    joined = rows.groupBy(key).agg(held.alias("_c"), *(F.min_by(c, "channel").alias(c) for c in others))
    return joined.withColumns({"channels": F.size("_c"), "voxels": F.flatten(F.transform("_c", lambda c: c["voxels"]))}).drop("_c")
