"""Sampling volumes at tables of points, and the reverse: gradients by the points, by the voxels and by a matrix that made the points.

A point row holds image_id, point (its name, once an image), px, py, pz and any further columns. Positions count from 1 in steps of the image's spacing: voxel i
lies at 1 + (i - 1) * spacing. Points go to the bricks that hold their neighbours; each brick sums what its voxels give, and a point's parts are added up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import bricks as by_brick
from lumenframe.operators.bricks import PLACE, begin_of, size_of

AXES = "xyz"
#: Points of one brick that a task takes; bricks with more are dealt to several tasks.
CROWD = 1_000_000


def for_each_image(points: DataFrame, images: DataFrame) -> DataFrame:
    """One list of points for every image: a row per image and point, as sampling returns."""
    return images.select("image_id").distinct().crossJoin(points)


def placed(points: DataFrame, geometry: DataFrame, mode: str, keep_beginning: bool) -> DataFrame:
    """Adds ix, iy, iz (index positions in single precision), inside, low (the lower neighbours, from 0) and part (the shares of the upper ones).

    A point is inside from voxel 1 to the last one of each axis. keep_beginning moves points from [0, 1) to 1 first; negative coordinates are outside in any case.
    """
    rows = points.join(geometry, "image_id")
    index = [((F.col(f"p{a}") - 1) / F.col("spacing")[i] + 1).cast("float").cast("double") for i, a in enumerate(AXES)]
    if keep_beginning:
        index = [F.when((F.col(f"p{a}") >= 0) & (i < 1), F.lit(1.0)).otherwise(i) for a, i in zip(AXES, index, strict=True)]
    rows = rows.withColumns({f"i{a}": i for a, i in zip(AXES, index, strict=True)})
    inside = F.lit(True)
    for i, a in enumerate(AXES):
        inside &= (F.col(f"i{a}") >= 1) & (F.col(f"i{a}") <= F.col("dims")[i])
    low = [(F.rint(f"i{a}") if mode == "nearest" else F.floor(f"i{a}")).cast("int") - 1 for a in AXES]
    rows = rows.withColumns({"inside": F.coalesce(inside, F.lit(False)), "low": F.array(*low)})
    share = [F.lit(0.0) if mode == "nearest" else F.col(f"i{a}") - (F.col("low")[i] + 1) for i, a in enumerate(AXES)]
    return rows.withColumn("part", F.array(*share))


def geometry_of(images: DataFrame) -> DataFrame:
    """(image_id, dims, spacing), one row an image, of image or brick rows."""
    return images.groupBy("image_id").agg(F.first("dims").alias("dims"), F.first("spacing").alias("spacing"))


def in_bricks(images: DataFrame) -> DataFrame:
    return images if "bx" in images.columns else by_brick.split(images)


def met_by_bricks(bricks: DataFrame, rows: DataFrame) -> DataFrame:
    """(image_id, point, value, sx, sy, sz): sums over each point's neighbours of the voxel times its share, and times the slopes of the share, a row per brick that holds some."""
    sides = bricks.groupBy("image_id").agg(F.first("side").alias("side"))
    near = rows.where("inside").select("image_id", "point", "low", "part", "dims").join(sides, "image_id")
    for i, name in enumerate(PLACE):
        first, last = F.floor(F.col("low")[i] / F.col("side")[i]).cast("int"), F.floor(F.least(F.col("low")[i] + 1, F.col("dims")[i] - 1) / F.col("side")[i]).cast("int")
        near = near.withColumn(name, F.explode(F.when(F.col("part")[i] != 0, F.array_distinct(F.array(first, last))).when(first != last, F.array(first, last)).otherwise(F.array(first))))
    home = ["image_id", *PLACE]
    counts = near.groupBy(*home).agg(F.count("*").alias("n"))
    # At most one row per CROWD points: a bounded share of the table.
    crowded = F.broadcast(counts.where(F.col("n") > CROWD).select(*home, F.ceil(F.col("n") / CROWD).cast("int").alias("lots")))
    near = near.join(crowded, home, "left").withColumn("lot", F.pmod(F.xxhash64("point"), F.coalesce("lots", F.lit(1))).cast("int")).drop("lots", "side", "dims")
    held = bricks.select(*home, begin_of().alias("begin"), size_of().alias("size"), "dims", F.col("voxels").cast("array<double>").alias("voxels")).join(counts.select(*home), home, "left_semi")
    held = held.join(crowded, home, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
    keys = [*home, "lot"]
    both = held.withColumn("asks", F.lit(0)).unionByName(near.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "asks").select(*keys, "asks", "begin", "size", "dims", "voxels", "point", "low", "part")
    kinds = dict(rows.dtypes)

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        volume = begin = dims = None
        for batch in batches:
            cuts = np.flatnonzero(np.append(True, (batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(1) | (batch["asks"].to_numpy()[1:] != batch["asks"].to_numpy()[:-1]))) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.iloc[a:b]
                head = part.iloc[0]
                if not head["asks"]:
                    volume, begin, dims = np.asarray(head["voxels"], float).reshape([int(n) for n in reversed(head["size"])]), np.asarray(head["begin"], int), np.asarray(head["dims"], int)
                    continue
                low, share = np.stack(part["low"].to_numpy()).astype(int), np.stack(part["part"].to_numpy()).astype(float)
                yield pd.DataFrame({"image_id": part["image_id"].to_numpy(), "point": part["point"].to_numpy(), **dict(zip(("value", "sx", "sy", "sz"), neighbour_sums(volume, begin, dims, low, share), strict=True))})

    return both.mapInPandas(sums, f"image_id {kinds['image_id']}, point {kinds['point']}, value double, sx double, sy double, sz double")


def neighbour_sums(volume: np.ndarray, begin: np.ndarray, dims: np.ndarray, low: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Over the up to eight neighbours that a (z, y, x) brick holds: voxel * share, and voxel * the share's slope along x, y and z."""
    out, size = [np.zeros(len(low)) for _ in range(4)], np.array(volume.shape[::-1])
    for corner in np.ndindex(2, 2, 2):
        up = np.array(corner)
        at = np.minimum(low + up, dims - 1) - begin
        here = ((at >= 0) & (at < size)).all(1)
        x, y, z = at[here].T
        v = volume[z, y, x]
        w, sign = np.where(up, share[here], 1 - share[here]), 2 * up - 1
        out[0][here] += v * w.prod(1)
        for k in range(3):
            out[k + 1][here] += v * sign[k] * np.delete(w, k, 1).prod(1)
    return out


def summed_at(images: DataFrame, points: DataFrame, mode: str, keep_beginning: bool) -> DataFrame:
    """The points with inside, spacing, value, sx, sy, sz; zeros outside."""
    if mode not in ("linear", "nearest"):
        raise ValueError("points are sampled 'linear' or 'nearest'")
    bricks = in_bricks(images)
    rows = placed(points, geometry_of(bricks), mode, keep_beginning)
    names = ("value", "sx", "sy", "sz")
    parts = met_by_bricks(bricks, rows).groupBy("image_id", "point").agg(*(F.sum(c).alias(c) for c in names))
    return rows.join(parts, ["image_id", "point"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})


def sample_points(images: DataFrame, points: DataFrame, mode: str = "linear", fill: float | Column = 0.0, keep_beginning: bool = False) -> DataFrame:
    """Adds `value` to the points of images in rows or bricks: trilinear, or of the nearest voxel (halves to even); `fill` outside. Points of images that aren't there are left out.

    The upper neighbour of the last voxel is that voxel. With keep_beginning points between 0 and 1 count as 1. Null coordinates are outside.
    """
    rows = summed_at(images, points, mode, keep_beginning)
    outside = fill if isinstance(fill, Column) else F.lit(float(fill))
    return rows.withColumn("value", F.when(F.col("inside"), F.col("value")).otherwise(outside)).select(*points.columns, "value")


def point_gradients(images: DataFrame, points: DataFrame, gradient: str) -> DataFrame:
    """Adds dx, dy, dz: the gradient of sum(gradient * linear sample) by each point's coordinates; zeros outside, where samples don't hang on them.

    An index moves by 1 / spacing per unit of its coordinate; at the last voxel, whose upper neighbour is itself, there is no slope.
    """
    rows = summed_at(images, points, "linear", False)
    slope = {f"d{a}": F.col(gradient) * F.col(f"s{a}") / F.col("spacing")[i] for i, a in enumerate(AXES)}
    return rows.withColumns(slope).select(*points.columns, *slope)


def voxel_gradients(images: DataFrame, points: DataFrame, gradient: str, mode: str = "linear") -> DataFrame:
    """(image_id, x, y, z, value): the gradient of sum(gradient * sample) by each voxel that some point reaches: what sampling reads, this adds up.

    Each point gives a row per neighbour; tasks add up their own before the shuffle.
    """
    rows = placed(points, geometry_of(images), mode, False).where("inside")
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)] if mode == "linear" else [(0, 0, 0)]
    at = lambda i, up: F.least(F.col("low")[i] + up, F.col("dims")[i] - 1) + 1
    share = lambda c: [F.col("part")[i] if up else 1 - F.col("part")[i] for i, up in enumerate(c)]
    near = [F.struct(*(at(i, up).alias(AXES[i]) for i, up in enumerate(c)), (share(c)[0] * share(c)[1] * share(c)[2] * F.col(gradient)).alias("w")) for c in corners]
    return rows.select("image_id", F.inline(F.array(*near))).where("w <> 0").groupBy("image_id", *AXES).agg(F.sum("w").alias("value"))


def transformed_points(images: DataFrame, matrix: str) -> DataFrame:
    """(image_id, x, y, z, px, py, pz): every voxel's position under a column of 16 doubles, matrix * (p - size / 2) + size / 2."""
    grid = images.select("image_id", "dims", F.col(matrix).alias("_m"))
    for i, a in enumerate(AXES):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(1), F.col("dims")[i])))
    away = [F.col(a) - F.col("dims")[i] / 2 for i, a in enumerate(AXES)]
    moved = {f"p{a}": sum((F.col("_m")[4 * r + k] * away[k] for k in range(3)), F.col("_m")[4 * r + 3]) + F.col("dims")[r] / 2 for r, a in enumerate(AXES)}
    return grid.withColumns(moved).select("image_id", *AXES, *moved)


def coordinates_gradient(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """(image_id, d_matrix): the gradient by the 12 first numbers of a matrix, row by row, of what has gradient gx, gy, gz by transformed_points' positions.

    rows: image_id, x, y, z, gx, gy, gz; dims: image_id, dims. It is the sum of outer products of gradient and (position - size / 2, 1): twelve sums that tasks begin before the shuffle.
    """
    met = rows.join(dims.select("image_id", "dims"), "image_id")
    away = [F.col(a) - F.col("dims")[i] / 2 for i, a in enumerate(AXES)] + [F.lit(1.0)]
    sums = [F.sum(F.col(f"g{a}") * w) for a in AXES for w in away]
    return met.groupBy("image_id").agg(F.array(*sums).alias("d_matrix"))
