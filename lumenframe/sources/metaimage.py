"""MetaImage volumes (.mha): a text header and the voxels in one file, and readers for any volume file."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import nifti

# MetaImage element types.
TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG": "i4", "MET_ULONG": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def parse(data: bytes) -> dict:
    """Dims, channels, float32 voxels (x fastest, channel after channel) and geometry of a .mha file with its data inside, packed or not."""
    head, at = {}, 0
    while head.get("ElementDataFile") is None:
        end = data.index(b"\n", at)
        name, _, value = data[at:end].decode().partition("=")
        head[name.strip()] = value.strip()
        at = end + 1
    if head["ElementDataFile"] != "LOCAL":
        raise ValueError("the voxels are in another file")
    n = int(head.get("NDims", 3))
    numbers = lambda *names: next(([float(x) for x in head[k].split()] for k in names if k in head), None)
    dims = [int(x) for x in numbers("DimSize")] + [1] * (3 - n)
    channels = int(head.get("ElementNumberOfChannels", 1))
    raw = data[at:]
    if head.get("CompressedData", "False").lower() == "true":
        raw = zlib.decompress(raw)
    order = ">" if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")).lower() == "true" else "<"
    size = int(np.prod(dims)) * channels
    voxels = np.frombuffer(raw, order + TYPES[head["ElementType"]], size).astype(np.float32).reshape(-1, channels).T.reshape(-1)
    if n > 3:
        channels, dims = channels * int(np.prod(dims[3:])), dims[:3]
    turn = np.eye(3)
    turn[: min(n, 3), : min(n, 3)] = np.array(numbers("TransformMatrix", "Rotation", "Orientation") or np.eye(n).reshape(-1)).reshape(n, n)[:3, :3]
    pad = lambda values, fill: (list(values or []) + [fill] * 3)[:3]
    return {
        "dims": dims, "channels": channels, "voxels": voxels, "origin": pad(numbers("Offset", "Position", "Origin"), 0.0),
        "spacing": pad(numbers("ElementSpacing", "ElementSize"), 1.0), "direction": turn.T.reshape(-1).tolist(),  # a row of the file is an axis
    }


def build(dims: list[int], voxels: np.ndarray, origin: list[float], spacing: list[float], direction: list[float], packed: bool = False) -> bytes:
    """A single-file float32 MetaImage."""
    text = lambda values: " ".join(repr(float(v)) for v in values)
    lines = ["ObjectType = Image", "NDims = 3", "BinaryData = True", "BinaryDataByteOrderMSB = False", f"CompressedData = {packed}", f"TransformMatrix = {text(np.array(direction).reshape(3, 3).T.reshape(-1))}"]
    lines += [f"Offset = {text(origin)}", f"ElementSpacing = {text(spacing)}", f"DimSize = {' '.join(map(str, dims))}", "ElementType = MET_FLOAT", "ElementDataFile = LOCAL", ""]
    raw = np.asarray(voxels, "<f4").tobytes()
    return "\n".join(lines).encode() + (zlib.compress(raw) if packed else raw)


def parse_volume(name: str, data: bytes) -> dict:
    """By the file's name."""
    return parse(data) if name.lower().endswith(".mha") else nifti.parse(data)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """One row per .nii, .nii.gz or .mha file under path, read by Spark from any store it knows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{nii,nii.gz,mha}").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def each(batches: Iterable) -> Iterator:
        for batch in batches:
            yield from nifti.frames({"file": file.rpartition("/")[2], **parse_volume(file, bytes(data))} for file, data in zip(batch["path"], batch["content"], strict=True))

    return files.mapInPandas(each, nifti.IMAGE)


def with_type(images: DataFrame, kind: str, plain: bool = False) -> DataFrame:
    """image_type and image_subtype of a table read as CT, MRI or PET; plain knows CT only and takes all else for PET."""
    known = {"CT": ("CT", "CT"), "MRI": ("MRI", "T1"), "PET": ("PET", "FDG")}
    found = known["CT"] if kind == "CT" else known["PET"] if plain else known.get(kind, known["PET"])
    return images.withColumns({"image_type": F.lit(found[0]), "image_subtype": F.lit(found[1]), "legacy_file_name": F.element_at(F.split("file", "/"), -1)})
