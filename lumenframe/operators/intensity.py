"""Intensity normalization and histogram operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import kernels


def of_flat(change: Callable[..., np.ndarray], *columns: str | Column) -> Column:
    """change(flat voxels in double precision, values of the other columns) per row; null where the voxels are."""

    @F.pandas_udf("array<double>")
    def changed(v: pd.Series, *more: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else change(np.asarray(x, float), *others) for x, *others in zip(v, *more, strict=True)], dtype=object)

    return changed(*columns)


def z_score(images: DataFrame, mask: str | None = None, eps: float = 1e-8) -> DataFrame:
    """(v - mean) / (sample std + eps) for all voxels; a mask column restricts the statistics to its nonzero voxels. NaN where fewer than two are left."""

    def scaled(x: np.ndarray, m: np.ndarray | None = None) -> np.ndarray:
        chosen = x if m is None else x[np.asarray(m) != 0]
        if len(chosen) < 2:
            return np.full(len(x), np.nan)
        return (x - chosen.mean()) / (chosen.std(ddof=1) + eps)

    return images.withColumn("voxels", of_flat(scaled, "voxels", *([mask] if mask else [])))


def min_max(images: DataFrame, low: float = 0.0, high: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Linearly from the least and largest voxel to low and high."""

    def scaled(x: np.ndarray) -> np.ndarray:
        return (x - x.min()) / (x.max() - x.min() + eps) * (high - low) + low if len(x) else x

    return images.withColumn("voxels", of_flat(scaled, "voxels"))


def rescale(images: DataFrame, slope: Column, intercept: Column) -> DataFrame:
    """v * slope + intercept; null parameters stand for 1 and 0."""
    line = [F.coalesce(slope, F.lit(1.0)).cast("double"), F.coalesce(intercept, F.lit(0.0)).cast("double")]
    return images.withColumn("voxels", of_flat(lambda x, a, b: x * a + b, "voxels", *line))


def histogram_match(source: Column, target: Column) -> Column:
    """Source voxels with the target's distribution: by rank, interpolated where sizes differ."""

    @F.pandas_udf("array<double>")
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernels.histogram_match(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)], dtype=object)

    return match(source, target)


def nyul_landmarks(images: DataFrame) -> DataFrame:
    """(image_id, marks): percentiles 1 to 99 of each image's positive voxels, or of all if it has none."""

    @F.pandas_udf("array<double>")
    def marks(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            x = np.asarray(x, float)
            out.append(np.percentile(x[x > 0] if (x > 0).any() else x, range(1, 100)) if len(x) else None)
        return pd.Series(out, dtype=object)

    return images.select("image_id", marks("voxels").alias("marks"))


def nyul_standard(landmarks: DataFrame) -> DataFrame:
    """(k, mark): the landmarks' average over images, k from 1: 99 rows."""
    return landmarks.select(F.posexplode("marks").alias("p", "m")).groupBy((F.col("p") + 1).alias("k")).agg(F.avg("m").alias("mark"))


def nyul_transform(images: DataFrame, landmarks: DataFrame, standard: DataFrame) -> DataFrame:
    """Map voxels piecewise linearly from the image's own landmarks to the standard ones, clamped at both ends."""
    all_marks = standard.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mark"))), lambda s: s["mark"]).alias("goal"))

    @F.pandas_udf("array<double>")
    def mapped(v: pd.Series, own: pd.Series, goal: pd.Series) -> pd.Series:
        out = []
        for x, s, t in zip(v, own, goal, strict=True):
            x, s, t = (np.asarray(a, float) for a in (x, s, t))
            slope = np.diff(t) / (np.diff(s) + 1e-8)
            i = np.clip(np.searchsorted(s, x, "left") - 1, 0, len(slope) - 1)
            y = slope[i] * x + (t[:-1] - slope * s[:-1])[i]
            out.append(np.where(x <= s[0], t[0], np.where(x >= s[-1], t[-1], y)))
        return pd.Series(out, dtype=object)

    return images.join(landmarks, "image_id").crossJoin(F.broadcast(all_marks)).withColumn("voxels", mapped("voxels", "marks", "goal")).drop("marks", "goal")
