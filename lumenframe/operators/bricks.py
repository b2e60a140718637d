"""Volumes in bricks: one row per box of voxels, for volumes that are too large for one row or one worker.

A brick row holds image_id, bx, by and bz (the brick's place, from 0), side (the voxels of a whole brick along x, y and z; bricks at the far ends are
shorter), dims, origin, spacing and direction of the whole volume, voxels (flat, x fastest) and any further columns of the image. Operators work out which source box each
output brick needs, cut it from the bricks that hold it, and meet the pieces in one shuffle; a task holds one box at a time. Results
equal those of the whole volume voxel for voxel.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import kernels
from lumenframe.operators.dose import cosine_window, patch_starts
from lumenframe.operators.spatial import diagonal, each_axis, matrices, real, turned, whole

PLACE = ("bx", "by", "bz")
#: Voxels of small boxes or bricks that a task works on together.
HELD = 1 << 20
#: Voxels of a block of small bricks that stays together: few enough that volumes of many bricks are still dealt to many tasks.
BLOCK = 1 << 16


def begin_of(side: str | Column = "side") -> Column:
    """A brick's first voxel (x, y, z from 0)."""
    return each_axis(lambda i: F.col(PLACE[i]) * (F.col(side) if isinstance(side, str) else side)[i])


def size_of(dims: str | Column = "dims") -> Column:
    """A brick's own shape."""
    d = F.col(dims) if isinstance(dims, str) else dims
    return each_axis(lambda i: F.least(F.col("side")[i], d[i] - F.col(PLACE[i]) * F.col("side")[i]))


def places(images: DataFrame, side: Sequence[int] | Column) -> DataFrame:
    """A row per brick of every image, without voxels: columns of the image, side, bx, by, bz."""
    rows = images.withColumn("side", whole(side))
    for i, name in enumerate(PLACE):
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.ceil(F.col("dims")[i] / F.col("side")[i]).cast("int") - 1)))
    return rows


def split(images: DataFrame, side: Sequence[int] = (64, 64, 64)) -> DataFrame:
    """Image rows as bricks; each row is cut where it is, images of one shape together."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    others = [c for c in images.columns if c != "voxels"]
    out = StructType([images.schema[c] for c in others]).add("side", ArrayType(IntegerType()))
    for c in PLACE:
        out = out.add(c, IntegerType())
    out, side = out.add(images.schema["voxels"]), [int(s) for s in side]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, (values, ends) = rows_of(batch.column("dims")).astype(int), flat_of(batch.column("voxels"))
            for at, shape in stacks(dims):
                volumes = np.stack([values[ends[i] : ends[i + 1]] for i in at]).reshape(-1, *shape[::-1])
                mine = batch.take(pa.array(at))
                for place, box in boxes_in((0, 0, 0), shape, side):
                    flat = volumes[(slice(None), *box)].reshape(len(at), -1)
                    numbers = [pa.array(np.full(len(at), k, np.int32)) for k in place]
                    found = [*(mine.column(c) for c in others), lists(np.tile(np.array(side, np.int32), (len(at), 1))), *numbers, lists(flat)]
                    yield pa.RecordBatch.from_arrays(found, names=out.names)

    return images.where("voxels is not null").select(*others, "voxels").mapInArrow(cut, out)


def generated(images: DataFrame, side: Sequence[int], make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Bricks of image rows without voxels: make(begin, size), both x, y, z, gives a brick's (z, y, x) voxels, for a phantom or a reader of parts of files. Bricks are dealt out before they are made."""
    rows = places(images, side).withColumns({"_begin": begin_of(), "_size": size_of()})
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in rows.columns if c not in ("_begin", "_size")]

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # rows are small and bricks are not: one brick at a time
                row = batch.slice(i, 1)
                begin, size = (np.array(row.column(c)[0].as_py(), int) for c in ("_begin", "_size"))
                flat = np.asarray(make(begin, size), np.float32).reshape(-1)
                voxels = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), voxels], names=[*kept, "voxels"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.repartition(parts, "image_id", *PLACE).mapInArrow(fill, f"{schema}, voxels array<float>")


def join(bricks: DataFrame) -> DataFrame:
    """Bricks as image rows again, for volumes that fit a row."""
    others = [c for c in bricks.columns if c not in (*PLACE, "side", "voxels", "image_id", "dims")]
    rest = F.struct(F.array(*[F.lit(0)] * 3).alias("low"), F.col("dims").alias("high"), "dims", *others)
    first = F.when((F.col("bx") == 0) & (F.col("by") == 0) & (F.col("bz") == 0), rest)
    pieces = bricks.select("image_id", *(F.lit(0).alias(c) for c in PLACE), first.alias("_rest"), begin_of().alias("_begin"), size_of().alias("_size"), F.col("voxels").alias("_voxels"))
    return in_boxes(pieces, lambda boxes, row: [({}, boxes)], (), kind=None).select("image_id", "dims", *others, "voxels")


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(n, k) numbers of a column of lists of one length, or (n, 1) of single numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 3)


def flat_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def alike(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows of a matrix that are equal, group by group."""
    groups: dict[bytes, list[int]] = {}
    for i, key in enumerate(np.ascontiguousarray(keys)):
        groups.setdefault(key.tobytes(), []).append(i)
    yield from map(np.array, groups.values())


def stacks(shapes: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Places of rows of one shape, as many as hold HELD voxels or one, and the shape."""
    for at in alike(shapes):
        shape = shapes[at[0]].tolist()
        some = max(1, HELD // max(1, math.prod(shape)))
        yield from ((at[i : i + some], shape) for i in range(0, len(at), some))


def boxes_in(low: Sequence[int], high: Sequence[int], side: Sequence[int]) -> Iterator[tuple[tuple[int, ...], tuple[slice, ...]]]:
    """Each brick of the given side that has voxels from low to high: its place, and where (z, y, x) it lies in a box from low to high."""
    for place in itertools.product(*(range(a // n, -(-b // n)) for a, b, n in zip(low, high, side, strict=True))):
        yield place, tuple(slice(max(k * n, a) - a, min((k + 1) * n, b) - a) for k, a, b, n in reversed(list(zip(place, low, high, side, strict=True))))


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    rows = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def in_boxes(pieces: DataFrame, finish: Callable[..., Iterable[tuple[dict, np.ndarray]]], read: Sequence[str], kind: str | None = "double", add: bool = False, single: Sequence[str] = ()) -> DataFrame:
    """Pieces that share image_id, bx, by and bz put (or added) into one box from `low` to `high`, boxes handed to finish as soon as they are whole.

    pieces: _begin, _size and _voxels of each piece, and `_rest`, a struct of low, high and all other columns of the box, which a box's first piece (or others too) holds.
    finish(boxes, row, singles) gets a (n, z, y, x) stack of boxes with the same numbers in `read`, these, and the n values of each column of `single`, and gives
    (new values of columns, n rows of voxels) for every row that stands for a box. Pieces come sorted, so a task holds one box, or small ones up to HELD voxels together.
    Voxels are of the given kind, or stay what they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

    keys = ("image_id", *PLACE)
    fields = [*(pieces.schema[c] for c in keys), *pieces.schema["_rest"].dataType.fields]
    out = StructType([*fields]).add("voxels", ArrayType({"double": DoubleType(), "float": FloatType()}[kind]) if kind else pieces.schema["_voxels"].dataType)
    types, names = {f.name: f.type for f in to_arrow_schema(out)}, [f.name for f in fields]
    number = types["voxels"].value_type.to_pandas_dtype()

    def finished(heads: pa.Table, boxes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in alike(np.hstack([rows_of(heads.column(c)).astype(float) for c in ("low", "high", *read)])):
            mine = heads.take(pa.array(at))
            row, singles = {c: mine.column(c)[0].as_py() for c in ("low", "high", *read)}, [mine.column(c).to_numpy() for c in single]
            for new, values in finish(np.stack([boxes[i] for i in at]), row, *singles):
                values = np.ascontiguousarray(values, number).reshape(len(at), -1)
                columns = [pa.array([new[c]] * len(at), types[c]) if c in new else mine.column(c).combine_chunks() for c in names]
                yield pa.RecordBatch.from_arrays([*columns, lists(values)], names=[*names, "voxels"])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, boxes, held = None, [], [], 0  # the last box may still grow
        for batch in filter(len, batches):
            rest, places, own = batch.column("_rest"), [batch.column(c) for c in keys], []
            table = pa.Table.from_arrays([*places, *(rest.field(c) for c in names[4:])], names=names)
            ids = list(zip(*(c.to_pylist() for c in places), strict=True))
            begins, shapes = rows_of(batch.column("_begin")), rows_of(batch.column("_size"))
            values, ends = flat_of(batch.column("_voxels"))
            first = [i for i, (this, last) in enumerate(zip(ids, [key, *ids], strict=False)) if this != last]
            lows, highs = (rows_of(rest.field(c).take(pa.array(first, pa.int64()))) for c in ("low", "high"))
            box_of = np.searchsorted(first, np.arange(len(ids)), "right") - 1
            if not first or first[0]:  # the batch goes on with the last box
                lows, box_of = np.vstack([[low], lows]), box_of + 1
            starts = begins - lows[box_of]
            slices = np.stack([starts, starts + shapes], 2).tolist()
            shapes, heights, ends = shapes[:, ::-1].tolist(), (highs - lows[len(lows) - len(highs) :])[:, ::-1].tolist(), ends.tolist()
            new = dict(zip(first, range(len(first)), strict=True))
            for i in range(len(ids)):
                piece = values[ends[i] : ends[i + 1]].reshape(shapes[i])
                if i in new:
                    if held > HELD:
                        yield from finished(pa.concat_tables([*heads, table.take(pa.array(own, pa.int64()))]), boxes)
                        heads, own, boxes, held = [], [], [], 0
                    box = np.zeros(heights[new[i]], piece.dtype)
                    own.append(i)
                    boxes.append(box)
                    held += box.size
                (x, x2), (y, y2), (z, z2) = slices[i]
                if add:
                    box[z:z2, y:y2, x:x2] += piece
                else:
                    box[z:z2, y:y2, x:x2] = piece
            key, low = ids[-1], lows[-1]
            heads.append(table.take(pa.array(own, pa.int64())))  # a copy, so that the batch can go
        if boxes:
            yield from finished(pa.concat_tables(heads), boxes)

    # What a box's first piece holds comes first, and sums are added up in one order.
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "_begin").mapInArrow(each, out)


def gather(bricks: DataFrame, wanted: DataFrame, finish: Callable[..., Iterable[tuple[dict, np.ndarray]]], read: Sequence[str] = (), kind: str = "double", single: Sequence[str] = (), held_side: str = "side") -> DataFrame:
    """finish of every row of `wanted` (image_id, bx, by, bz, low, high, and more) with its source box from low to high, of whichever bricks hold it (of side `held_side`).

    What each source brick must give is worked out from places alone and met with the bricks once; what it gives is cut before the shuffle that brings a box together.
    Columns of a wanted row go with its first piece alone.
    """
    return in_boxes(cut_for(bricks, wanted, held_side), finish, read, kind, single=single)


def cut_for(bricks: DataFrame, wanted: DataFrame, held_side: str = "side") -> DataFrame:
    """The pieces of gather, as in_boxes takes them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    kept = [c for c in wanted.columns if c not in ("image_id", *PLACE)]
    asked = wanted.select("image_id", *(F.col(c).alias(f"_to_{c}") for c in PLACE), "low", "high", F.struct(*kept).alias("_rest"), F.col(held_side).alias("_side"))
    from_to = [(F.floor(F.col("low")[i] / F.col("_side")[i]).cast("int"), F.floor((F.col("high")[i] - 1) / F.col("_side")[i]).cast("int")) for i in range(3)]
    for name, (first, last) in zip(PLACE, from_to, strict=True):
        asked = asked.withColumn(name, F.explode(F.sequence(first, last)))
    is_first = (F.col("bx") == from_to[0][0]) & (F.col("by") == from_to[1][0]) & (F.col("bz") == from_to[2][0])
    target = F.struct(*(F.col(f"_to_{c}").alias(c) for c in PLACE), "low", "high", F.when(is_first, F.col("_rest")).alias("_rest"))
    asked = asked.groupBy("image_id", *PLACE).agg(F.collect_list(target).alias("targets"))
    # Hashed by places in either case: Spark may take voxels that a function makes for small and would broadcast them.
    met = bricks.select("image_id", *PLACE, begin_of().alias("begin"), size_of().alias("size"), "voxels").join(asked.hint("shuffle_hash"), ["image_id", *PLACE])
    met = met.select("image_id", "begin", "size", "voxels", "targets")
    kinds = {f.name: f.dataType for f in met.schema}
    target_type = kinds["targets"].elementType
    out = StructType().add("image_id", kinds["image_id"])
    for c in PLACE:
        out = out.add(c, target_type[c].dataType)
    out = out.add("_rest", target_type["_rest"].dataType).add("_begin", ArrayType(IntegerType())).add("_size", ArrayType(IntegerType())).add("_voxels", kinds["voxels"])
    schema = to_arrow_schema(out)

    def given(batch: pa.RecordBatch) -> pa.RecordBatch:
        """All pieces of the bricks of a batch."""
        targets = batch.column("targets")
        asked, counts = targets.flatten(), np.diff(targets.offsets.to_numpy())
        of = np.repeat(np.arange(batch.num_rows), counts)
        order, *piece = pieces_of(batch, of, rows_of(asked.field("low")), rows_of(asked.field("high")))
        rows = asked.take(pa.array(order))
        found = [batch.column("image_id").take(pa.array(of[order])), *(rows.field(c) for c in (*PLACE, "_rest")), *piece]
        return pa.RecordBatch.from_arrays(found, names=schema.names)

    return met.mapInArrow(lambda batches: map(given, held_together(batches)), out)


def held_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As many bricks as hold HELD voxels, or one."""
    for batch in batches:
        ends = batch.column("voxels").offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + HELD, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def pieces_of(batch: pa.RecordBatch, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray, pa.ListArray]:
    """What the bricks `of` a batch give to boxes from low to high: the order of the boxes, and where each piece begins, its size and voxels.

    Bricks of one shape that give the same place are cut together.
    """
    begin, size = rows_of(batch.column("begin")).astype(int), rows_of(batch.column("size")).astype(int)
    low, high = np.maximum(low, begin[of]), np.minimum(high, (begin + size)[of])
    values, ends = flat_of(batch.column("voxels"))
    order, parts = [], []
    for at in alike(np.hstack([size[of], low - begin[of], high - begin[of]])):
        i = at[0]
        shape, (x, y, z), (x2, y2, z2) = size[of[i]][::-1], low[i] - begin[of[i]], high[i] - begin[of[i]]
        there = np.stack([values[k : k + shape.prod()] for k in ends[of[at]]]).reshape(-1, *shape)
        parts.append(there[:, z:z2, y:y2, x:x2].reshape(-1))
        order.append(at)
    order = np.concatenate(order)
    sizes = (high - low)[order]
    voxels = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes.prod(1))]), pa.int32()), pa.array(np.concatenate(parts)))
    return order, lists(low[order].astype(np.int32)), lists(sizes.astype(np.int32)), voxels


def block_side() -> Column:
    """The side of the blocks of whole bricks that tasks work on: up to BLOCK voxels, or one brick."""
    side = F.col("side")
    bricks = F.greatest(F.lit(1), F.floor(F.cbrt(F.lit(float(BLOCK)) / side[0] / side[1] / side[2])).cast("int"))
    return each_axis(lambda i: side[i] * bricks)


def dealt(bricks: DataFrame, far: int) -> DataFrame:
    """The pieces, as in_boxes takes them, of blocks of side `_block` with `far` voxels more at their far ends; bx, by and bz are the blocks' places.

    Which blocks a brick gives to hangs on its own place, so bricks meet no other table, and most give one piece.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    ints = ArrayType(IntegerType())
    bricks = bricks.withColumn("_block", block_side())
    others = [c for c in bricks.columns if c not in ("image_id", *PLACE, "voxels")]
    rest = StructType().add("low", ints).add("high", ints)
    for c in others:
        rest = rest.add(bricks.schema[c].name, bricks.schema[c].dataType)
    out = StructType([bricks.schema["image_id"]])
    for c in PLACE:
        out = out.add(c, IntegerType())
    out = out.add("_rest", rest).add("_begin", ints).add("_size", ints).add("_voxels", bricks.schema["voxels"].dataType)
    schema = to_arrow_schema(out)

    def given(batch: pa.RecordBatch) -> pa.RecordBatch:
        begin, size, dims, block = (rows_of(batch.column(c)).astype(int) for c in ("begin", "size", "dims", "_block"))
        first = np.maximum(begin - far, 0) // block
        counts = (begin + size - 1) // block - first + 1
        total = counts.prod(1)
        of = np.repeat(np.arange(len(total)), total)
        k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
        nx, ny, _ = counts[of].T
        place = first[of] + np.stack([k % nx, k // nx % ny, k // (nx * ny)], 1)
        low = place * block[of]
        high = np.minimum(low + block[of] + far, dims[of])
        order, *piece = pieces_of(batch, of, low, high)
        low, high, of = low[order], high[order], of[order]
        head = (begin[of] == low).all(1)  # a block's first brick alone brings the other columns
        rows = batch.take(pa.array(of, mask=~head))
        fields = [lists(m.astype(np.int32)) for m in (low, high)] + [rows.column(c) for c in others]
        told = pa.StructArray.from_arrays(fields, names=["low", "high", *others], mask=pa.array(~head))
        places = [pa.array(p.astype(np.int32)) for p in place[order].T]
        return pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(of)), *places, told, *piece], names=schema.names)

    rows = bricks.select("image_id", *others, begin_of().alias("begin"), size_of().alias("size"), "voxels")
    return rows.mapInArrow(lambda batches: map(given, held_together(batches)), out)


def about(bricks: DataFrame) -> DataFrame:
    """The bricks' rows without voxels."""
    return bricks.drop("voxels")


def map_bricks(bricks: DataFrame, change: Callable[[np.ndarray], np.ndarray], halo: int | Sequence[int] = 1) -> DataFrame:
    """Any function of whole volumes that keeps their shape and whose result at a voxel hangs on voxels up to `halo` away (and on where the volume ends): gradients, means, convolutions.

    Each brick meets the faces, edges and corners of its neighbours; where the volume ends so does the box, so borders are those of the whole volume.
    """
    h = [halo] * 3 if isinstance(halo, int) else list(halo)
    begin, size = begin_of(), size_of()
    wanted = about(bricks).withColumns({"low": each_axis(lambda i: F.greatest(begin[i] - h[i], F.lit(0))), "high": each_axis(lambda i: F.least(begin[i] + size[i] + h[i], F.col("dims")[i])), "at": begin, "own": size})

    def local(boxes: np.ndarray, row: dict) -> Iterator[tuple[dict, np.ndarray]]:
        own = tuple(slice(x - a, x - a + n) for a, x, n in zip(reversed(row["low"]), reversed(row["at"]), reversed(row["own"]), strict=True))
        yield {}, np.stack([np.asarray(change(box.astype(float)), float)[own] for box in boxes])

    return gather(bricks, wanted, local, ("at", "own")).drop("low", "high", "at", "own")


def gradient_magnitude(bricks: DataFrame, eps: float = 1e-8) -> DataFrame:
    """masks.gradient_magnitude of volumes in bricks."""
    return map_bricks(bricks, lambda v: kernels.gradient_magnitude(v, eps), 1)


def point_kernel_dose(bricks: DataFrame, spacing: Sequence[float], radius: int = 3, sigma: float = 0.6, attenuation: float = 0.01) -> DataFrame:
    """dose.point_kernel_dose of volumes of one spacing in bricks: overlap-save, an FFT per brick and its halo of the kernel's radius."""
    kernel = kernels.dose_point_kernel(radius, tuple(spacing), sigma, attenuation)
    return map_bricks(bricks, lambda v: np.maximum(kernels.convolve_same(v, kernel), 0), radius)


def outside_of(bricks: DataFrame) -> DataFrame:
    """(image_id, fill): the median of each volume's eight corners, from the bricks that hold them."""
    ends = [F.array(F.lit(0), F.col("dims")[i] - 1) for i in range(3)]
    corners = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    here = lambda c: [ends[i][c[i]] - F.col(PLACE[i]) * F.col("side")[i] for i in range(3)]
    size = size_of()
    inside = lambda at: (at[0] >= 0) & (at[1] >= 0) & (at[2] >= 0) & (at[0] < size[0]) & (at[1] < size[1]) & (at[2] < size[2])
    values = F.array_compact(F.array(*[F.when(inside(here(c)), F.get("voxels", (here(c)[0] + size[0] * (here(c)[1] + size[1] * here(c)[2])).cast("int")).cast("double")) for c in corners]))
    found = bricks.select("image_id", F.explode(values).alias("v")).groupBy("image_id").agg(F.array_sort(F.collect_list("v")).alias("s"))
    return found.select("image_id", ((F.col("s")[3] + F.col("s")[4]) / 2).alias("fill"))


def affine(bricks: DataFrame, matrix: np.ndarray | Column, out_dims: Sequence[int] | Column | None = None, centre: Column | None = None, mode: str = "linear", fill: float | None = None, pulls: bool = False, kind: str = "float") -> DataFrame:
    """spatial.affine of volumes in bricks: a matrix (4 x 4, or a column of 16 doubles that pulls back) about out_dims / 2 or the given centre.

    An output brick's source box is that of its mapped corners and a voxel more. Output bricks are as large as source bricks, or smaller by the factor by which
    the matrix shrinks the volume, so that a source box has about one brick's size.
    """
    if isinstance(matrix, np.ndarray):
        matrix = np.linalg.inv(matrix) if not pulls else matrix
        matrix = F.array(*[F.lit(float(x)) for x in matrix.reshape(-1)])
    # One row per image with all that doesn't hang on the brick: that of its first brick.
    images = about(bricks).where("bx = 0 and by = 0 and bz = 0").drop(*PLACE)
    out = whole(out_dims) if out_dims is not None else F.col("dims")
    images = images.withColumns({"source": F.col("dims"), "_m": matrix, "_out": out})
    images = images.withColumn("_c", centre if centre is not None else F.transform("_out", lambda n: n / 2)).withColumn("dims", F.col("_out").cast("array<int>")).drop("_out")
    images = images.withColumn("_fill", F.lit(float(fill))) if fill is not None else images.join(outside_of(bricks).withColumnRenamed("fill", "_fill"), "image_id")
    step = lambda i: F.greatest(F.lit(1.0), sum((F.abs(F.col("_m")[4 * r + i]) for r in range(3)), F.lit(0.0)))
    smaller = each_axis(lambda i: F.greatest(F.lit(1), F.floor(F.col("side")[i] / step(i))))
    wanted = places(images.withColumn("_s", smaller).withColumnRenamed("side", "_from"), F.col("_s")).drop("_s")

    @F.pandas_udf("struct<low: array<int>, high: array<int>>")
    def reach(b: pd.Series, s: pd.Series, m: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        begin, size, source, centre = (np.stack([np.asarray(x, float) for x in series]) for series in (b, s, d, c))
        pull = np.stack([np.asarray(x, float).reshape(4, 4) for x in m])
        corners = np.stack([begin + 1 + np.array(k) * (size - 1) for k in np.ndindex(2, 2, 2)], 1) - centre[:, None]
        p = np.einsum("nij,nkj->nki", pull[:, :3, :3], corners) + (pull[:, :3, 3] + centre)[:, None]
        slack = 1 + 1e-6 * np.abs(p).max(1)  # places are rounded to single precision
        low = np.clip(np.floor(p.min(1) - slack), 1, source) - 1
        high = np.clip(np.ceil(p.max(1) + slack), low + 1, source)
        return pd.DataFrame({"low": list(low.astype(np.int32)), "high": list(high.astype(np.int32))})

    wanted = wanted.withColumn("_r", reach(begin_of(), size_of(), F.col("_m"), F.col("_c"), F.col("source"))).withColumns({"low": F.col("_r.low"), "high": F.col("_r.high")}).drop("_r")

    number = np.float64 if kind == "double" else np.float32
    wanted = wanted.withColumns({"at": begin_of(), "own": size_of()})

    def sample(boxes: np.ndarray, row: dict, fills: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
        window = kernels.Window(tuple(row["source"]), tuple(row["at"]), tuple(row["low"]), tuple(b - a for a, b in zip(row["low"], row["high"], strict=True)))
        flat = boxes.reshape(len(boxes), -1).astype(number, copy=False)
        yield {}, kernels.pull(flat, np.array(row["_m"]).reshape(4, 4), np.array(row["_c"], float), tuple(row["own"]), window, fills.astype(number), mode)

    done = gather(bricks, wanted, sample, ("at", "own", "source", "_m", "_c"), kind, ("_fill",), "_from")
    return done.drop("low", "high", "at", "own", "_m", "_c", "_fill", "source", "_from")


def resample_to_spacing(bricks: DataFrame, spacing: Sequence[float] | Column, mode: str = "linear", fill: float | None = None, kind: str = "float") -> DataFrame:
    """spatial.resample_to_spacing of volumes in bricks."""
    new, old = real(spacing), F.col("spacing")
    out = each_axis(lambda i: F.ceil(F.col("dims")[i] * old[i] / new[i]))
    ratio = each_axis(lambda i: new[i] / old[i], "double")
    how = "round_first" if mode == "nearest" else mode
    done = affine(bricks, diagonal(ratio, F.transform(ratio, lambda r: 1 - r)), out, centre=real((0, 0, 0)), mode=how, fill=fill, pulls=True, kind=kind)
    return done.withColumn("spacing", new)


def rotate(bricks: DataFrame, axis: int, degrees: float, mode: str = "linear", fill: float | None = None, kind: str = "float") -> DataFrame:
    """spatial.rotate of volumes in bricks."""
    pull = matrices(turned(axis, degrees), F.col("spacing"), F.col("direction"))
    return affine(bricks, pull, centre=F.transform("dims", lambda n: n / 2 + 1), mode=mode, fill=fill, pulls=True, kind=kind)


def blend_patches(bricks: DataFrame, patch: int, stride: int, predict: Callable[[np.ndarray], np.ndarray], rest: Callable[[np.ndarray], np.ndarray] = lambda cube: cube, skip_below: float = 1e-3) -> DataFrame:
    """dose.blend_patches of volumes in bricks: each cube is predicted once, where its first voxel is.

    Bricks are put together into blocks first, small volumes whole. A block needs patch - 1 voxels more at its far ends. Its weighted sums are cut by the blocks they fall in
    and added up there; the weights, which hang on places alone, are worked out where they are needed.
    """
    line = np.array(cosine_window(patch))

    def blended(boxes: np.ndarray, row: dict) -> Iterator[tuple[dict, np.ndarray]]:
        """The blocks' own cubes, predicted, weighted and summed in their boxes, cut by the blocks that the boxes reach."""
        low, high, block, total = row["low"], row["high"], row["_block"], np.zeros(boxes.shape)
        own = [[a - 1 for a in patch_starts(n, patch, stride) if b <= a - 1 < b + k] for n, b, k in zip(row["dims"], low, block, strict=True)]
        for first in itertools.product(*reversed(own)):
            here = tuple(slice(a - b, min(a - b + patch, n)) for a, b, n in zip(first, reversed(low), boxes.shape[1:], strict=True))
            weight = np.einsum("i,j,k->ijk", *(line[: s.stop - s.start] for s in here))
            cubes = boxes[(slice(None), *here)].astype(float)
            skipped = (cubes.max(axis=(1, 2, 3)) < skip_below).tolist()
            total[(slice(None), *here)] += np.stack([(rest if skip else predict)(cube) for cube, skip in zip(cubes, skipped, strict=True)]) * weight
        for place, part in boxes_in(low, high, block):
            ends = [min((b + 1) * t, n) for b, t, n in zip(place, block, row["dims"], strict=True)]
            begin = [a + p.start for a, p in zip(low, reversed(part), strict=True)]
            new = dict(zip(PLACE, place, strict=True)) | {"low": [b * t for b, t in zip(place, block, strict=True)], "high": ends, "to_begin": begin, "to_size": [p.stop - p.start for p in reversed(part)]}
            yield new, total[(slice(None), *part)]

    def averaged(totals: np.ndarray, row: dict) -> Iterator[tuple[dict, np.ndarray]]:
        weights = []
        for low, high, n in zip(row["low"], row["high"], row["dims"], strict=True):
            w = np.zeros(n)
            for a in patch_starts(n, patch, stride):
                w[a - 1 : a - 1 + patch] += line[: n - a + 1]
            weights.append(w[low:high])
        means = totals / (np.einsum("k,j,i->kji", *reversed(weights)) + 1e-8)
        for place, part in boxes_in(row["low"], row["high"], row["side"]):
            yield dict(zip(PLACE, place, strict=True)), means[(slice(None), *part)]

    parts = in_boxes(dealt(bricks.withColumns({"to_begin": begin_of(), "to_size": size_of()}), patch - 1), blended, ("_block", "dims"))
    kept = [c for c in parts.columns if c not in ("image_id", *PLACE, "to_begin", "to_size", "voxels")]
    pieces = parts.select("image_id", *PLACE, F.struct(*kept).alias("_rest"), F.col("to_begin").alias("_begin"), F.col("to_size").alias("_size"), F.col("voxels").alias("_voxels"))
    return in_boxes(pieces, averaged, ("dims", "side"), add=True).drop("low", "high", "_block")


def voxel_sums(bricks: DataFrame) -> DataFrame:
    """(image_id, n, total, low, high): reductions of volumes in bricks, each brick's first and then the bricks'."""

    @F.pandas_udf("struct<n: long, total: double, low: double, high: double>")
    def each(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(x), float(np.sum(x, dtype=float)), float(np.min(x)), float(np.max(x))) for x in v], columns=["n", "total", "low", "high"])

    parts = bricks.select("image_id", each("voxels").alias("p"))
    return parts.groupBy("image_id").agg(F.sum("p.n").alias("n"), F.sum("p.total").alias("total"), F.min("p.low").alias("low"), F.max("p.high").alias("high"))
