"""Volume files as a Spark data source: headers without voxels, files left out by name before they are opened, bricks layer by layer, and writes that commit by renaming.

Files lie in any file system that pyarrow opens (local paths, file://, hdfs://, s3://, gs://); for stores that only Spark reads use nifti.read_nifti.
"""

from __future__ import annotations

import fnmatch
import gzip
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lumenframe.sources import nifti

BRICKS = "file string, dims array<int>, channels int, side array<int>, bx int, by int, bz int, voxels array<float>, origin array<double>, spacing array<double>, direction array<double>"
HEAD = 352


def opened(uri: str):  # noqa: ANN201
    """(file system, path) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class VolumeFile(InputPartition):
    """One file, or one layer of bricks of it."""

    path: str
    layer: int | None = None


class Scan(DataSourceReader):
    """Rows of the asked columns alone; one partition per file, or per layer of bricks where a file isn't packed."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.uri, self.glob = schema, options["path"], options.get("pathglobfilter", "*.nii*")
        self.side = [int(n) for n in options["brick"].split(",")] if "brick" in options else None
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Tests of the file's name are answered here; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, IsNotNull)) and f.attribute == ("file",):
                self.names.append(f)
            else:
                yield f

    def wanted(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value), StringEndsWith: lambda f: name.endswith(f.value), IsNotNull: lambda f: True}
        return fnmatch.fnmatch(name, self.glob) and all(tests[type(f)](f) for f in self.names)

    def partitions(self) -> list[VolumeFile]:
        from pyarrow import fs

        where, base = opened(self.uri)
        info = where.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and self.wanted(f.base_name) and not any(part.startswith(("_", ".")) for part in f.path[len(base) :].split("/")))
        if not self.side or "voxels" not in self.schema.names:
            return [VolumeFile(f) for f in files]
        layers = []
        for f in files:
            if f.endswith(".gz"):
                layers.append(VolumeFile(f))
            else:
                with where.open_input_file(f) as source:
                    layers += [VolumeFile(f, k) for k in range(math.ceil(nifti.header(source.read(HEAD))["dims"][2] / self.side[2]))]
        return layers

    def read(self, partition: VolumeFile) -> Iterator[pa.RecordBatch]:
        where, _ = opened(self.uri)
        packed = partition.path.endswith(".gz")
        with where.open_input_file(partition.path) as raw:
            source = gzip.GzipFile(fileobj=raw) if packed else raw
            first = source.read(HEAD)
            head = nifti.header(first)
            row = {k: head[k] for k in ("dims", "channels", "origin", "spacing", "direction")} | {"file": partition.path.rpartition("/")[2]}
            if self.side is None:
                if "voxels" in self.schema.names:
                    source.seek(head["offset"])
                    row["voxels"] = nifti.values(head, source.read(head["bytes"]))
                yield self.batch([row])
                return
            if "voxels" not in self.schema.names:
                yield self.batch([row | {"side": self.side, "bx": i, "by": j, "bz": k} for k, j, i in np.ndindex(*(math.ceil(n / s) for n, s in zip(reversed(head["dims"]), reversed(self.side), strict=True)))])
                return
            yield from self.bricks(source, head, row, partition.layer)

    def bricks(self, source, head: dict, row: dict, layer: int | None) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        """A layer at a time is read and cut; a packed file is unpacked once from its begin. Volumes of several channels give the bricks of the first."""
        (nx, ny, nz), (sx, sy, sz) = head["dims"], self.side
        plane = nx * ny * head["kind"].itemsize
        for bz in range(math.ceil(nz / sz)) if layer is None else [layer]:
            deep = min(sz, nz - bz * sz)
            source.seek(head["offset"] + bz * sz * plane)
            slab = nifti.values(head, source.read(deep * plane), nx * ny * deep).reshape(deep, ny, nx)
            for by in range(math.ceil(ny / sy)):
                for bx in range(math.ceil(nx / sx)):
                    yield self.batch([row | {"side": self.side, "bx": bx, "by": by, "bz": bz, "voxels": slab[:, by * sy : (by + 1) * sy, bx * sx : (bx + 1) * sx].reshape(-1)}])

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Tasks write to a folder of the job; commit renames what they report, so a task that dies or runs twice leaves no file, whole or half, under its name."""

    def __init__(self, uri: str) -> None:
        self.uri, self.job = uri, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        where, base = opened(self.uri)
        task, done = f"{base}/{self.job}/{uuid.uuid4().hex}", []
        where.create_dir(task, recursive=True)
        for row in rows:
            data = nifti.build(list(row["dims"]), np.array(row["voxels"], np.float32), list(row["origin"]), list(row["spacing"]), list(row["direction"]))
            with where.open_output_stream(f"{task}/{row['file']}", compression=None) as out:
                out.write(gzip.compress(data, mtime=0) if row["file"].endswith(".gz") else data)
            done.append((f"{task}/{row['file']}", f"{base}/{row['file']}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = opened(self.uri)
        for message in messages:
            for held, final in message.files if message else []:
                where.move(held, final)
        self.clear(where, base)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*opened(self.uri))

    def clear(self, where, base: str) -> None:  # noqa: ANN001
        from pyarrow import fs

        if where.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.job}")


class VolumeSource(DataSource):
    """spark.read.format("volume").option("brick", "64,64,64").load(uri), and df.write.format("volume").save(uri) of file, dims, voxels, origin, spacing, direction.

    A schema given to the reader names the columns that are read: without voxels only 352 bytes of a file are.
    """

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return BRICKS if "brick" in self.options else nifti.IMAGE

    def reader(self, schema: StructType) -> Scan:
        return Scan(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def scan(spark: SparkSession, uri: str, columns: Iterable[str] | None = None, brick: Iterable[int] | None = None, glob: str = "*.nii*") -> DataFrame:
    """Volume files under a folder, the given columns alone; brick rows (see operators.bricks) where a brick's sides are given.

    Filters on `file` (=, in, startswith, endswith) choose files before any is opened.
    """
    spark.dataSource.register(VolumeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = {f.split()[0]: f for f in (BRICKS if brick else nifti.IMAGE).split(", ")}
    reader = spark.read.format("volume").schema(", ".join(fields[c] for c in (columns or fields))).option("pathGlobFilter", glob)
    reader = reader.option("brick", ",".join(map(str, brick))) if brick else reader
    rows = reader.load(uri)
    return rows.withColumn("image_id", F.col("file")) if brick and "file" in rows.columns else rows


def save(images: DataFrame, uri: str) -> None:
    """Write image rows under their `file` names; files of the same names are replaced when the whole job has succeeded."""
    images.sparkSession.dataSource.register(VolumeSource)
    images.select("file", "dims", "voxels", "origin", "spacing", "direction").write.format("volume").mode("append").save(uri)
