"""Dose estimates and patch pipelines."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import kernels
from lumenframe.operators import spatial
from lumenframe.operators.masks import of_volume
from lumenframe.operators.volumes import let

# Energy per decay for local deposition (keV), and Gy per count of the analytical estimate.
ENERGY_KEV = 0.969 * 249.8 + 2 * 511 * 0.969
GRAY = 8.478e-8


def density(hu: Column) -> Column:
    """CT numbers to g/cm3: 1 + 0.001 hu up to 0 (at least 0.01), 1 + 0.0007 hu above."""
    return F.when(hu <= 0, F.greatest(F.lit(0.01), 1 + 0.001 * hu)).otherwise(1 + 0.0007 * hu)


def analytical_dose(counts: Column, rho: Column, voxel_volume: float) -> Column:
    return counts * GRAY / (voxel_volume * rho + 1e-4)


def local_dose(suv: Column, rho: Column) -> Column:
    """Activity (not below 0) times energy over density clamped to [0.01, 3]."""
    return F.greatest(suv, F.lit(0.0)) * ENERGY_KEV / F.greatest(F.lit(0.01), F.least(F.lit(3.0), rho))


def standardize(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + 1e-6)


def patch_starts(size: int, patch: int, stride: int) -> list[int]:
    """Starts from 1 at each stride, and the last position that fits."""
    return sorted({*range(1, max(size - patch, 0) + 2, stride), max(size - patch, 0) + 1})


def cosine_window(patch: int) -> list[float]:
    """cos at `patch` even steps from -pi/2 to pi/2, both ends included; 1 for a single voxel."""
    return np.cos(np.linspace(-np.pi / 2, np.pi / 2, patch)).tolist() if patch > 1 else [1.0]


def blend_patches(images: DataFrame, patch: int, stride: int, predict: Callable[..., np.ndarray], rest: Callable[..., np.ndarray] = lambda cube, *_: cube, skip_below: float = 1e-3, others: Sequence[str] = ()) -> DataFrame:
    """Predict on overlapping cubes and blend by cosine windows: sum(prediction * w) / (sum(w) + 1e-8).

    predict maps a (z, y, x) cube, and the same cubes of the flat columns `others` (a density, say), to a cube of its shape. Where a cube's maximum is below
    skip_below `rest` of the same cubes stands instead, such as an analytical dose; the cube itself if none is given.
    """
    line = np.array(cosine_window(patch))

    def blend(volume: np.ndarray, *more: np.ndarray) -> np.ndarray:
        total, weight = np.zeros(volume.shape), np.zeros(volume.shape)
        for at in itertools.product(*(patch_starts(n, patch, stride) for n in volume.shape)):
            box = tuple(slice(a - 1, min(a - 1 + patch, n)) for a, n in zip(at, volume.shape, strict=True))
            cubes = [v[box] for v in (volume, *more)]
            w = np.einsum("i,j,k->ijk", *(line[:n] for n in cubes[0].shape))
            total[box] += (rest if cubes[0].max() < skip_below else predict)(*cubes) * w
            weight[box] += w
        return (total / (weight + 1e-8)).reshape(-1)

    return images.withColumn("voxels", of_volume("array<double>", blend, "voxels", *others, "dims"))


def decay_chain(dose: Column, steps: int, dt: float, k_in: float, k_out: float, k_bind: float, decay: float) -> Column:
    """Euler steps of blood, free and bound activity as a fold: struct(blood, free, bound, total), total being the bound and free sum over time."""
    start = F.struct(dose.cast("double").alias("blood"), F.lit(0.0).alias("free"), F.lit(0.0).alias("bound"), F.lit(0.0).alias("total"))

    def step(s: Column, _: Column) -> Column:
        blood = s["blood"] + dt * (-(k_in + decay) * s["blood"] + k_out * s["free"])
        free = s["free"] + dt * (k_in * s["blood"] - (k_out + k_bind + decay) * s["free"])
        bound = s["bound"] + dt * (k_bind * s["free"] - decay * s["bound"])
        return F.struct(blood.alias("blood"), free.alias("free"), bound.alias("bound"), (s["total"] + dt * (s["free"] + s["bound"])).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def point_kernel_dose(images: DataFrame, radius: int = 3, sigma: float = 0.6, attenuation: float = 0.01) -> DataFrame:
    """Convolve each volume with a normalized dose-point kernel (FFT); not below 0. Images have one spacing per row."""

    @F.pandas_udf("array<double>")
    def convolve(v: pd.Series, d: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for x, (nx, ny, nz), sp in zip(v, d, s, strict=True):
            k = kernels.dose_point_kernel(radius, tuple(sp), sigma, attenuation)
            out.append(np.maximum(kernels.convolve_same(np.asarray(x, float).reshape(nz, ny, nx), k), 0).reshape(-1))
        return pd.Series(out, dtype=object)

    return images.withColumn("voxels", convolve("voxels", "dims", "spacing"))


def agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Per group: mean absolute error, Pearson correlation, ratio of means, bias under the mask b > 1 % of its maximum."""
    peak = pairs.groupBy(*by).agg(F.max(b).alias("_peak"))
    rows = pairs.join(peak, list(by))
    masked = F.when(F.col(b) > 0.01 * F.col("_peak"), F.col(a) - F.col(b))
    return rows.groupBy(*by).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.corr(a, b).alias("pearson"), F.try_divide(F.avg(a), F.avg(b)).alias("ratio"), F.avg(masked).alias("bias"))


def compared(pairs: DataFrame, a: str, b: str, body: str) -> DataFrame:
    """Adds the agreement of two volumes of a row inside a body mask (nonzero) where either is positive: n_voxels, pearson, ncc
    (denominator + 1e-8), normalized mae (each divided by the 99th percentile of its positive voxels) and the ratio of means. Nulls where nothing is compared."""

    def measure(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple:
        inside = (m != 0) & ((x > 0) | (y > 0))
        if not inside.any() or not (x > 0).any() or not (y > 0).any():
            return int(inside.sum()), None, None, None, None
        p, q = x[inside], y[inside]
        dp, dq = p - p.mean(), q - q.mean()
        spread = float(np.sqrt((dp * dp).sum() * (dq * dq).sum()))
        top = [float(np.percentile(v[v > 0], 99)) for v in (x, y)]
        return len(p), float((dp * dq).sum() / spread) if spread else None, float((dp * dq).sum() / (spread + 1e-8)), float(np.abs(p / top[0] - q / top[1]).mean()), float(p.mean() / q.mean()) if q.mean() else None

    found = of_volume("struct<n_voxels: long, pearson: double, ncc: double, mae: double, ratio: double>", measure, a, b, body, "dims")
    return pairs.withColumn("_c", found).select(*pairs.columns, "_c.*")


def ssim(pairs: DataFrame, a: str, b: str, size: int = 11) -> Column:
    """Structural similarity of two volumes of a row, slice by slice of z."""
    return of_volume("double", lambda x, y: kernels.ssim(x, y, size), a, b, "dims")


def voxel_features(pairs: DataFrame, ct: str, spect: str) -> DataFrame:
    """Adds five flat arrays per image: standardized activity and CT, their 3 x 3 x 3 means, and the standardized distance to
    the voxels above the 95th percentile of activity (100 everywhere where there are none)."""
    plain = lambda v: (v - v.mean()) / (v.std() + 1e-6)

    def features(c: np.ndarray, s: np.ndarray) -> tuple:
        c, t = plain(c), plain(s)
        return tuple(v.reshape(-1) for v in (t, c, kernels.box_mean(t), kernels.box_mean(c), plain(kernels.distance_to(s > np.percentile(s, 95)))))

    names = ("spect", "ct", "spect_mean", "ct_mean", "to_peak")
    found = of_volume(f"struct<{', '.join(f'f_{n}: array<double>' for n in names)}>", features, ct, spect, "dims")
    return pairs.withColumn("_f", found).select(*pairs.columns, "_f.*")


def safe_dose(energy: Column, rho: Column, volume: Column | float) -> Column:
    """energy / (density * volume), 0 in air (density up to 0.05)."""
    return F.when(rho <= 0.05, 0.0).otherwise(energy / (rho * volume))


def without_contrast(hu: Column) -> Column:
    """The CT number; above 300 (iodine) an error."""
    return F.when(hu > 300, F.raise_error(F.lit("CT numbers above 300: contrast agent would falsify the dose")).cast("double")).otherwise(hu)


def calibrated(value: Column, units: Column, factor: float) -> Column:
    """Counts times the calibration factor; Bq/ml are calibrated already."""
    return F.when(units == "BQML", value).otherwise(value * factor)


def in_body(voxels: str, mask: str) -> Column:
    """Voxels times mask."""
    return F.zip_with(voxels, mask, lambda v, m: v * m)


def unit_range(voxels: str) -> Column:
    """Voxels divided by the largest absolute value; all zeros stay."""
    return let(F.array_max(F.transform(voxels, F.abs)), lambda top: F.transform(voxels, lambda v: F.when(top > 0, v / top).otherwise(v)))


def unit_ct(voxels: str) -> Column:
    """CT numbers clipped to [-1000, 2000], shifted to begin at 0 and divided by the largest."""
    clipped = F.transform(voxels, lambda v: F.greatest(F.lit(-1000.0), F.least(F.lit(2000.0), v.cast("double"))))
    shifted = let(clipped, lambda c: let(F.array_min(c), lambda low: F.transform(c, lambda v: v - low)))
    return let(shifted, lambda c: let(F.array_max(c), lambda top: F.transform(c, lambda v: F.when(top > 0, v / top).otherwise(v))))


def prepared(spect: DataFrame, ct: DataFrame, dose: DataFrame, size: Sequence[int], key: str = "image_id", kind: str = "float") -> DataFrame:
    """Activity resampled to a grid of about `size`, CT and dose brought onto it, all cut or padded to exactly `size` at the
    first corner and scaled to [0, 1]: key, dims, spect, ct, dose."""
    spacing = F.array(*[F.col("dims")[i] * F.col("spacing")[i] / float(n) for i, n in enumerate(size)])
    fine = spatial.resample_to_spacing(spect, spacing, kind=kind)
    whole = lambda df: spatial.crop_corner(df, size)
    out = whole(fine).select(key, "dims", unit_range("voxels").alias("spect"))
    for name, moving, scaled in (("ct", ct, unit_ct), ("dose", dose, unit_range)):
        out = out.join(whole(spatial.onto(fine, moving, key, kind=kind)).select(key, scaled("voxels").alias(name)), key)
    return out


def dataset(target: DataFrame, ct: DataFrame, spect: DataFrame, approximate: DataFrame, key: str = "image_id", kind: str = "float") -> DataFrame:
    """CT (air, -1000, outside), activity and approximate dose (0 outside) on the grid of a target dose: key, dims, target, ct, spect, approximate."""
    out = target.select(key, "dims", F.col("voxels").alias("target"))
    for name, moving, fill in (("ct", ct, -1000.0), ("spect", spect, 0.0), ("approximate", approximate, 0.0)):
        out = out.join(spatial.onto(target, moving, key, fill=F.lit(fill), kind=kind).select(key, F.col("voxels").alias(name)), key)
    return out
