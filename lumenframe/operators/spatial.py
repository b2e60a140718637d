"""Cropping, padding, reorienting, resampling and affine sampling of image rows; all without a shuffle but for pairing.

Shape, spacing and direction are each row's own, so a table of mixed images goes through in one call, and parameters may be
columns. Voxels are moved or sampled by numpy kernels over Arrow batches, rows of one shape and matrix together. A chain of transforms
is one matrix (geometry.compose), so voxels are sampled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry, kernels
from lumenframe.operators.masks import of_volume
from lumenframe.operators.volumes import corners_median, doubles, ints


def whole(values: Sequence[int] | Column) -> Column:
    return values if isinstance(values, Column) else ints(values)


def real(values: Sequence[float] | Column) -> Column:
    return values if isinstance(values, Column) else doubles(values)


def each_axis(make: Callable[[int], Column], kind: str = "int") -> Column:
    return F.array(*[make(i).cast(kind) for i in range(3)])


def axis_shift(voxels: Column, sign: int) -> Column:
    """origin + sign * spacing * voxels * diagonal of direction."""
    return each_axis(lambda i: F.col("origin")[i] + sign * F.col("spacing")[i] * voxels[i] * F.col("direction")[4 * i], "double")


def boxed(images: DataFrame, begin: Column, size: Column, fill: Column | None = None, flip: Column | None = None, **others: Column) -> DataFrame:
    """The box of `size` voxels from `begin` (from 0) of every image, with `fill` where it sticks out, some axes reversed.

    Rows of a batch that share shape and box are cut together.
    """

    @F.pandas_udf(dict(images.dtypes)["voxels"])
    def cut(v: pd.Series, d: pd.Series, b: pd.Series, s: pd.Series, f: pd.Series, r: pd.Series) -> pd.Series:
        out, v = [None] * len(v), list(v)
        groups: dict[tuple, list[int]] = {}
        for i, (x, *key, fill) in enumerate(zip(v, d, b, s, r, f, strict=True)):
            if x is not None:
                groups.setdefault((*(np.asarray(k).tobytes() for k in key), fill), []).append(i)
        for rows in groups.values():
            dims, begin, size, flip = (np.asarray(k.iloc[rows[0]], int) for k in (d, b, s, r))
            together = max(1, (1 << 20) // max(int(np.prod(dims)), 1))  # rows that are held at once
            for part in (rows[i : i + together] for i in range(0, len(rows), together)):
                stack = (np.stack([v[i] for i in part]) if len(part) > 1 else np.asarray(v[part[0]])).reshape(len(part), *dims[::-1])
                for i, x in zip(part, kernels.boxed(stack, begin, size, flip > 0, f.iloc[rows[0]]).reshape(len(part), -1), strict=True):
                    out[i] = x
        return pd.Series(out, dtype=object)

    new = cut("voxels", "dims", begin, size, (fill if fill is not None else F.lit(0.0)).cast("float"), flip if flip is not None else ints((0, 0, 0)))
    return images.withColumns({"voxels": new, "dims": size.cast("array<int>"), **others})


def crop(images: DataFrame, begin: Sequence[int] | Column, size: Sequence[int] | Column) -> DataFrame:
    """The box of `size` voxels from `begin` (from 0); the origin moves along. Columns give every image a box of its own."""
    return boxed(images, whole(begin), whole(size), origin=axis_shift(whole(begin), 1))


def pad(images: DataFrame, begin: Sequence[int] | Column, end: Sequence[int] | Column, value: float | Column = 0.0) -> DataFrame:
    """Add `begin` and `end` voxels of `value` to every image, whatever its shape; the origin moves back."""
    begin, end = whole(begin), whole(end)
    size = each_axis(lambda i: F.col("dims")[i] + begin[i] + end[i])
    return boxed(images, each_axis(lambda i: -begin[i]), size, value if isinstance(value, Column) else F.lit(value), origin=axis_shift(begin, -1))


def pad_or_crop(images: DataFrame, target: Sequence[int] | Column) -> DataFrame:
    """Centre images in the target shape, padding with 0; an odd difference drops the extra voxel at the start."""
    size = whole(target)

    def begin(i: int) -> Column:
        more = size[i] - F.col("dims")[i]
        half = F.floor(more / 2)
        return F.when(more < 0, F.least(-half, -more)).otherwise(-half)

    return boxed(images, each_axis(begin), size, origin=axis_shift(each_axis(begin), 1))


def crop_around(images: DataFrame, size: Sequence[int] | Column, centre: Sequence[int] | Column) -> DataFrame:
    """A box of `size` around an integer centre (from 1), moved inside where it would stick out; no larger than the image."""
    size, centre = whole(size), whole(centre)
    begin = each_axis(lambda i: F.least(F.greatest(centre[i] - 1 - F.floor(size[i] / 2), F.lit(0)), F.greatest(F.col("dims")[i] - size[i], F.lit(0))))
    return crop(images, begin, each_axis(lambda i: F.least(size[i], F.col("dims")[i])))


def crop_corner(images: DataFrame, size: Sequence[int]) -> DataFrame:
    """Exactly `size` voxels from the first corner on: longer axes are cut at their end, shorter ones padded with 0."""
    return boxed(images, ints((0, 0, 0)), ints(size))


def translate(images: DataFrame, voxels: int | Column, axis: int) -> DataFrame:
    """Move the origin by whole voxels along axis 1, 2 or 3; touches no voxel, ignores the direction's sign."""
    n = F.lit(voxels) if isinstance(voxels, int) else voxels
    return images.withColumn("origin", F.array(*[F.col("origin")[i] + (n * F.col("spacing")[i] if i == axis - 1 else 0.0) for i in range(3)]))


def reorient(images: DataFrame, *targets: str | Column) -> DataFrame:
    """To an orientation code, or a column of codes: axes whose letters differ are reversed and the origin moves to their other end.

    The source is each row's own direction; one that isn't diagonal has no code and is an error. Of several targets each follows
    the one before; origins move step by step, and voxels move once.
    """
    d = F.col("direction")
    oblique = F.exists(F.transform(d, lambda x, i: F.abs(F.abs(x) - F.when(i % 4 == 0, 1.0).otherwise(0.0))), lambda x: x > 1e-6)
    sign = [F.when(oblique, F.raise_error(F.lit("an oblique direction has no orientation code")).cast("int")).otherwise(F.signum(d[4 * i]).cast("int")) for i in range(3)]
    flip, origin, t = [F.lit(0)] * 3, [F.col("origin")[i].cast("double") for i in range(3)], sign
    for target in targets:
        if isinstance(target, str):
            t = [F.lit(k) for k in geometry.direction_signs(target)]
        else:
            t = [F.when(F.substring(target, i + 1, 1).isin(*"LPS"), 1).otherwise(-1) for i in range(3)]
        flip = [F.when(sign[i] != t[i], 1 - flip[i]).otherwise(flip[i]) for i in range(3)]
        origin = [origin[i] + F.when(sign[i] != t[i], sign[i] * (F.col("dims")[i] - 1) * F.col("spacing")[i]).otherwise(0.0) for i in range(3)]
        sign = t
    direction = F.array(*[(t[i // 4] if i % 4 == 0 else F.lit(0)).cast("double") for i in range(9)])
    return boxed(images, ints((0, 0, 0)), F.col("dims"), flip=F.array(*flip), origin=F.array(*origin), direction=direction)


def sampled(voxels: Column, dims: Column, matrix: Column, centre: Column, out_dims: Column, fill: Column, mode: str, kind: str = "float") -> Column:
    """Sample each row's volume on the grid of out_dims at matrix * (p - centre) + centre.

    matrix: 16 doubles, row by row, output position to source position. Rows of a batch with one shape and matrix are
    sampled together. mode: 'nearest', 'round_first', 'linear' or 'cubic'.
    """

    @F.pandas_udf(f"array<{kind}>")
    def kernel(v: pd.Series, d: pd.Series, m: pd.Series, c: pd.Series, o: pd.Series, fill: pd.Series) -> pd.Series:
        out = [None] * len(v)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(d, m, c, o, strict=True)):
            if v.iloc[i] is not None and all(k is not None for k in key):
                groups.setdefault(tuple(tuple(map(float, k)) for k in key), []).append(i)
        for (d1, m1, c1, o1), rows in groups.items():
            shape = tuple(int(k) for k in d1)
            together = max(1, (1 << 24) // max(int(np.prod(shape)), 1))  # rows that are held at once
            for part in (rows[i : i + together] for i in range(0, len(rows), together)):
                stack = np.stack([v.iloc[i] for i in part]).astype(np.float64 if kind == "double" else np.float32)
                got = kernels.pull(stack, np.array(m1).reshape(4, 4), np.array(c1), tuple(int(k) for k in o1), shape, fill.iloc[part].to_numpy(stack.dtype), mode)
                for i, x in zip(part, got, strict=True):
                    out[i] = x
        return pd.Series(out, dtype=object)

    return kernel(voxels, dims, matrix, centre, out_dims, fill)


def matrices(build: Callable[..., np.ndarray], *columns: Column) -> Column:
    """16 doubles per row: build(values of the columns) as a 4 x 4 matrix, worked out once for rows of equal values."""

    @F.pandas_udf("array<double>")
    def made(*series: pd.Series) -> pd.Series:
        known: dict[tuple, np.ndarray] = {}
        out = []
        for row in zip(*series, strict=True):
            key = tuple(tuple(map(float, x)) if isinstance(x, (np.ndarray, list)) else x for x in row)
            if key not in known:
                known[key] = np.asarray(build(*key), float).reshape(-1)
            out.append(known[key])
        return pd.Series(out, dtype=object)

    return made(*columns)


def affine(images: DataFrame, matrix: np.ndarray | Column, out_dims: Sequence[int] | Column | None = None, centre: Column | None = None, mode: str = "linear", fill: Column | None = None, kind: str = "float", pulls: bool = False) -> DataFrame:
    """General affine transform: the matrix maps input to output about out_dims / 2 (or the given centre); geometry is kept.

    The matrix is inverted here (a singular one is an error) unless it pulls back already; as a column (16 doubles) it must.
    Outside stands the median of the image's own corners unless fill is given.
    """
    if isinstance(matrix, np.ndarray):
        if not pulls:
            if abs(np.linalg.det(matrix)) < 1e-300:
                raise ValueError("the affine matrix is singular")
            matrix = np.linalg.inv(matrix)
        matrix = doubles(matrix.reshape(-1))
    out = whole(out_dims) if out_dims is not None else F.col("dims")
    centre = centre if centre is not None else F.transform(out, lambda n: n / 2)
    outside = fill if fill is not None else corners_median("voxels", "dims")
    new = sampled(F.col("voxels"), F.col("dims"), matrix, centre, out, outside, mode, kind)
    return images.withColumns({"voxels": new, "dims": out})


def rotation_matrix_columns(axis: int, degrees: Column) -> Column:
    """The 16 numbers of a rotation by a column of degrees about a coordinate axis."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    i, j = [(1, 2), (2, 0), (0, 1)][axis - 1]
    cell: dict[tuple[int, int], Column] = {(i, i): c, (j, j): c, (i, j): -s, (j, i): s}
    return F.array(*[cell.get((a, b), F.lit(1.0 if a == b else 0.0)) for a in range(4) for b in range(4)])


def turned(axis: int, degrees: float) -> Callable[[tuple, tuple], np.ndarray]:
    """The pull-back of a rotation in positions of a grid with the given spacing and direction: M^-1 R(degrees) M."""

    def build(spacing: tuple, direction: tuple) -> np.ndarray:
        m = geometry.index_to_physical(spacing, direction)
        return geometry.homogeneous(np.linalg.inv(m) @ geometry.rotation(axis, degrees, direction) @ m)

    return build


def rotate(images: DataFrame, axis: int, degrees: float, mode: str = "linear", kind: str = "float") -> DataFrame:
    """Rotate about the physical centre, position size / 2 + 1; shape and geometry are kept.

    In positions the transform is M^-1 R(-degrees) M with M = direction * spacing of each row's geometry.
    """
    pull = matrices(turned(axis, degrees), F.col("spacing"), F.col("direction"))
    return affine(images, pull, centre=F.transform("dims", lambda n: n / 2 + 1), mode=mode, kind=kind, pulls=True)


def rotate_each(images: DataFrame, axis: int, degrees: Column, mode: str = "linear", kind: str = "float", centre: Column | None = None) -> DataFrame:
    """The batched form: an angle per row, about position size / 2 or the given centre."""
    return affine(images, rotation_matrix_columns(axis, degrees), centre=centre, mode=mode, kind=kind, pulls=True)


def diagonal(steps: Column, shift: Column) -> Column:
    """A 4 x 4 matrix of three steps and three shifts."""
    return F.array(*[steps[i].cast("double") if j == i else shift[i].cast("double") if j == 3 else F.lit(0.0) for i in range(3) for j in range(4)], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def scale(images: DataFrame, factors: Sequence[float] | Column, mode: str = "linear", kind: str = "float") -> DataFrame:
    """New size round(old * factor), half to even; position i takes (i - 1) / factor + 1. Spacing and origin are kept."""
    f = real(factors)
    out = each_axis(lambda i: F.rint(F.col("dims")[i] * f[i]))
    pull = diagonal(F.transform(f, lambda x: 1 / x), F.transform(f, lambda x: 1 - 1 / x))
    return affine(images, pull, out, centre=doubles((0, 0, 0)), mode=mode, kind=kind, pulls=True)


def scale_each(images: DataFrame, factors: Sequence[float] | Column, mode: str = "linear", kind: str = "float") -> DataFrame:
    """The batched form: an affine transform about half the new size, which samples other places than scale()."""
    f = real(factors)
    out = each_axis(lambda i: F.rint(F.col("dims")[i] * f[i]))
    return affine(images, diagonal(F.transform(f, lambda x: 1 / x), doubles((0, 0, 0))), out, mode=mode, kind=kind, pulls=True)


def resample_to_spacing(images: DataFrame, spacing: Sequence[float] | Column, mode: str = "linear", kind: str = "float", fill: Column | None = None, sizes: str = "ceil") -> DataFrame:
    """New size ceil(old size * old / new spacing); position i takes (i - 1) * new / old + 1; origin and direction are kept.

    Nearest neighbours are rounded before the bounds are tested. sizes='round' rounds half to even instead of up.
    """
    new, old = real(spacing), F.col("spacing")
    size = lambda i: F.col("dims")[i] * old[i] / new[i]
    out = each_axis(lambda i: F.rint(size(i)) if sizes == "round" else F.ceil(size(i)))
    ratio = each_axis(lambda i: new[i] / old[i], "double")
    how = "round_first" if mode == "nearest" else mode
    done = affine(images, diagonal(ratio, F.transform(ratio, lambda r: 1 - r)), out, centre=doubles((0, 0, 0)), mode=how, kind=kind, pulls=True, fill=fill)
    return done.withColumn("spacing", new)


def resample_each(images: DataFrame, spacing: Column, mode: str = "linear", kind: str = "float") -> DataFrame:
    """The batched form: a spacing per row, 0 outside, bounds tested before nearest neighbours are rounded."""
    old = F.col("spacing")
    out = each_axis(lambda i: F.ceil(F.col("dims")[i] * old[i] / spacing[i]))
    ratio = each_axis(lambda i: spacing[i] / old[i], "double")
    done = affine(images, diagonal(ratio, F.transform(ratio, lambda r: 1 - r)), out, centre=doubles((0, 0, 0)), mode=mode, kind=kind, pulls=True, fill=F.lit(0.0))
    return done.withColumn("spacing", spacing)


def resample_to_image(pairs: DataFrame, mode: str = "linear", fill: Column | None = None, kind: str = "float") -> DataFrame:
    """Bring `moving` onto the grid of `fixed`: rows with structs fixed and moving (dims, voxels, origin, spacing, direction).

    The pull-back matrix is that of both rows' whole geometries, oblique directions included. Outside stands the median of
    the fixed image's corners unless fill is given. Adds `resampled`.
    """
    f, m = F.col("fixed"), F.col("moving")
    build = lambda *g: geometry.fixed_to_moving(g[:3], g[3:])
    matrix = matrices(build, *(side[c] for side in (f, m) for c in ("origin", "spacing", "direction")))
    outside = fill if fill is not None else corners_median("fixed.voxels", "fixed.dims")
    return pairs.withColumn("resampled", sampled(m["voxels"], m["dims"], matrix, doubles((0, 0, 0)), f["dims"], outside, mode, kind))


def onto(fixed: DataFrame, moving: DataFrame, key: str, mode: str = "linear", fill: Column | None = None, kind: str = "float") -> DataFrame:
    """resample_to_image of two image tables matched by key: the result has the fixed geometry and the moving image's other columns."""
    grid = F.struct("dims", "voxels", "origin", "spacing", "direction")
    pairs = moving.withColumn("moving", grid).drop("dims", "voxels", "origin", "spacing", "direction").join(fixed.select(key, grid.alias("fixed")), key)
    done = resample_to_image(pairs, mode, fill, kind)
    return done.select("*", "fixed.dims", F.col("resampled").alias("voxels"), "fixed.origin", "fixed.spacing", "fixed.direction").drop("fixed", "moving", "resampled")


def physical_point(index: Sequence[Column], oblique: bool = True) -> Column:
    """origin + direction * spacing * index for a row's geometry and three index columns, as an array; the index isn't lowered by 1.

    oblique=False takes the directions for the identity.
    """
    o, s, d = F.col("origin"), F.col("spacing"), F.col("direction")
    scaled = [c.cast("double") * s[i] for i, c in enumerate(index)]
    return each_axis(lambda i: o[i] + (sum((d[3 * i + j] * scaled[j] for j in range(3)), F.lit(0.0)) if oblique else scaled[i]), "double")


def physical_centre() -> Column:
    """Midway between the points of index 0 and of index size."""
    ends = [physical_point([F.lit(0)] * 3), physical_point([F.col("dims")[i] for i in range(3)])]
    return each_axis(lambda i: (ends[0][i] + ends[1][i]) / 2, "double")


def adjoint_sample(gradients: DataFrame, matrix: np.ndarray, dims: Sequence[int], out_dims: Sequence[int], centre: Sequence[float] = (0, 0, 0), mode: str = "linear") -> DataFrame:
    """The transpose of sampling with a pull-back matrix: output gradients (voxels) back to the source grid of `dims`."""
    @F.pandas_udf("array<double>")
    def back(v: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.push(np.stack(list(v)).astype(float), matrix, np.array(centre, float), tuple(out_dims), tuple(dims), mode))) if len(v) else pd.Series([], dtype=object)

    return gradients.withColumns({"voxels": back("voxels"), "dims": ints(dims)})


def adjoint_reorient(gradients: DataFrame, source: str | Column) -> DataFrame:
    """The transpose of reorient: gradients in the new orientation back to the source's code. Axes were reversed only, so this reverses them again, geometry included."""
    return reorient(gradients, source)


def matrix_gradient(images: DataFrame, gradients: str, matrix: np.ndarray, centre: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Adds `d_matrix`: the gradient of sum(gradients * linear sampling at the pull-back matrix) by its first 12 numbers, row by row.

    It is the sum over output voxels of gradient * slope of the volume at the sampled place * (position - centre, 1). Voxels that are
    sampled outside have none.
    """

    @F.pandas_udf("array<double>")
    def slope(v: pd.Series, g: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([kernels.matrix_gradient(np.asarray(x, float), np.asarray(y, float), matrix, tuple(int(k) for k in dims), np.array(centre, float)) for x, y, dims in zip(v, g, d, strict=True)], dtype=object)

    return images.withColumn("d_matrix", slope("voxels", gradients, "dims"))


def match_spacing(source: str, target: str) -> Column:
    """Which order of the source's three spacings gives the target's: '012' and so on, the first that fits; '012' if none does."""
    hits = [F.when(F.array(*[F.col(source)[k] for k in perm]) == F.col(target), "".join(map(str, perm))) for perm in permutations(range(3))]
    return F.coalesce(*hits, F.lit("012"))


def match_origin(axis: int, origin: str, dims: str, spacing: str, target: str, tolerance: float = 0.1) -> Column:
    """How the target's origin on one axis (0, 1, 2) comes from a source: the first of the candidates
    origin[p] + sign * spacing[s] * (dims[n] - 1) with s rising, n and p falling and sign 0, 1, -1, as a struct; nulls where none fits.

    The axes of an origin are independent, so 81 candidates an axis stand for their 81^3 combinations.
    """
    hits = []
    for s in range(3):
        for n in (2, 1, 0):
            for p in (2, 1, 0):
                for sign in (0, 1, -1):
                    at = F.col(origin)[p] + sign * F.col(spacing)[s] * (F.col(dims)[n] - 1)
                    hits.append(F.when(F.abs(at - F.col(target)[axis]) <= tolerance, F.struct(F.lit(s).alias("spacing"), F.lit(n).alias("size"), F.lit(p).alias("origin"), F.lit(sign).alias("sign"))))
    return F.coalesce(*hits)


def match_axes(pairs: DataFrame, dims: Sequence[int] | Column) -> DataFrame:
    """Which permutation and reversal of axes maps array `a` of shape dims onto `b`; nulls where none does.

    Axis i of b runs along axis permuted[i] (x, y, z being 0, 1, 2) of a, from its end where reversed[i] is 1; the shape
    is permuted along. Of the 6 x 8 candidates the axes' own order comes first, then (z, y, x) reversed or not; the first
    hit wins. Columns a and b are flat arrays. Least and largest values of the slices along each axis, which don't hang on order, leave few
    candidates; those are compared as transposed views.
    """
    found = of_volume("struct<permuted: string, reversed: string>", lambda a, b: kernels.axes_between(a, b.reshape(-1)), "a", "b", whole(dims))
    return pairs.withColumn("found", found).withColumns({"permuted": F.col("found")["permuted"], "reversed": F.col("found")["reversed"]}).drop("found")
