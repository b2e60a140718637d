"""NIfTI-1 volumes: a reader over Spark's binary files, and a writer through a Python data source.

Files hold right-anterior-superior (RAS) geometry; image rows hold left-posterior-superior (LPS), as scanners' own formats do.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

IMAGE = "file string, dims array<int>, channels int, voxels array<float>, origin array<double>, spacing array<double>, direction array<double>"
# NIfTI-1 data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def header(data: bytes) -> dict:
    """Dims, channels, geometry and where and how the voxels lie, of the first 352 bytes of an unpacked NIfTI-1 file of either byte order."""
    order = "<" if struct.unpack_from("<i", data, 0)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data, 0)[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    get = lambda fmt, at: struct.unpack_from(order + fmt, data, at)
    dim, code = get("8h", 40), get("h", 70)[0]
    pix, (offset, slope, inter) = get("8f", 76), get("3f", 108)
    dims = [max(1, d) for d in dim[1:4]]
    channels = int(np.prod([max(1, d) for d in dim[4 : dim[0] + 1]])) if dim[0] > 3 else 1
    kind = np.dtype(order + TYPES[code])
    if get("h", 254)[0] > 0:
        m = np.array(get("12f", 280), float).reshape(3, 4)
    else:
        b, c, d, x, y, z = get("6f", 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        scale = np.array([pix[1], pix[2], pix[3] * (-1 if pix[0] < 0 else 1)])
        m = np.hstack([r * scale, [[x], [y], [z]]]) if get("h", 252)[0] > 0 else np.hstack([np.diag(scale), np.zeros((3, 1))])
    m = np.diag([-1.0, -1.0, 1.0]) @ m
    spacing = np.linalg.norm(m[:, :3], axis=0)
    place = {"offset": int(offset), "kind": kind, "bytes": int(np.prod(dims)) * channels * kind.itemsize, "slope": slope, "inter": inter}
    return {"dims": dims, "channels": channels, "origin": m[:, 3].tolist(), "spacing": spacing.tolist(), "direction": (m[:, :3] / spacing).reshape(-1).tolist(), **place}


def values(head: dict, data: bytes, count: int = -1) -> np.ndarray:
    """Voxels in single precision, by the header's slope and intercept; a slope of 0 or one that isn't finite scales nothing."""
    voxels, slope, inter = np.frombuffer(data, head["kind"], count).astype(np.float32), head["slope"], head["inter"]
    if slope != 0 and np.isfinite(slope) and np.isfinite(inter) and (slope != 1 or inter):
        voxels = voxels * np.float32(slope) + np.float32(inter)
    return voxels


def parse(data: bytes) -> dict:
    """Dims, channels, float32 voxels (x fastest) and geometry of a NIfTI-1 file, gzipped or not, of either byte order."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head = header(data)
    row = {k: head[k] for k in ("dims", "channels", "origin", "spacing", "direction")}
    return row | {"voxels": values(head, data[head["offset"] : head["offset"] + head["bytes"]])}


def build(dims: list[int], voxels: np.ndarray, origin: list[float], spacing: list[float], direction: list[float]) -> bytes:
    """A single-file float32 NIfTI-1 image."""
    m = np.diag([-1.0, -1.0, 1.0]) @ np.hstack([np.array(direction, float).reshape(3, 3) * np.array(spacing), np.array(origin, float)[:, None]])
    head = bytearray(352)
    put = lambda fmt, at, *v: struct.pack_into("<" + fmt, head, at, *v)
    put("i", 0, 348)
    put("8h", 40, 3, *dims, 1, 1, 1, 1)
    put("2h", 70, 16, 32)
    put("8f", 76, 1, *spacing, 0, 0, 0, 0)
    put("3f", 108, 352, 1, 0)
    put("2h", 252, 0, 2)
    put("12f", 280, *m.reshape(-1))
    put("4s", 344, b"n+1\0")
    return bytes(head) + np.asarray(voxels, "<f4").tobytes()


def frames(rows: Iterable[dict], most: int = 1 << 25) -> Iterator[pd.DataFrame]:
    """Rows of IMAGE as few frames, each of about `most` bytes of voxels, or one row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1000 + (0 if row["voxels"] is None else row["voxels"].nbytes)
        if size >= most:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def read_nifti(spark: SparkSession, path: str, headers_only: bool = False) -> DataFrame:
    """One row per .nii or .nii.gz file under path, read by Spark from any store it knows. headers_only leaves voxels null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii*").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def each(batches: Iterable) -> Iterator:
        for batch in batches:
            parsed = ({"file": file.rpartition("/")[2], **parse(bytes(data))} for file, data in zip(batch["path"], batch["content"], strict=True))
            yield from frames(row | {"voxels": None} if headers_only else row for row in parsed)

    return files.mapInPandas(each, IMAGE)


def write_nifti(images: DataFrame, uri: str) -> None:
    """Write image rows with a `file` column; existing files of the same names are replaced when the job commits."""
    from lumenframe.sources import volumes

    volumes.save(images, uri)
