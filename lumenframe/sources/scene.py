"""3D scene archives (a zip with an .mrml file): volume nodes with their whole chain of transforms folded in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources.metaimage import parse_volume

NODE = "scene string, name string, file string, dims array<int>, channels int, voxels array<float>, origin array<double>, spacing array<double>, direction array<double>"
FLIP = np.diag([-1.0, -1.0, 1.0, 1.0])


def numbers(text: str | None, default: list[float]) -> list[float]:
    return [float(x) for x in text.split()] if text else default


def volume_nodes(data: bytes) -> list[dict]:
    """Volume nodes of the first .mrml in the archive, with the voxels of the file that their storage names (null if it's no NIfTI or
    MetaImage file of the archive); the geometry is the scene's. Transforms apply from the node outwards, in RAS, and end in LPS."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if n.endswith(".mrml"))[0]))
        inside = {n.rpartition("/")[2]: z.read(n) for n in z.namelist() if n.lower().endswith((".nii", ".nii.gz", ".mha"))}
    nodes = {n.get("id"): n for n in root.iter() if n.get("id")}

    def link(node: ElementTree.Element, kind: str) -> str | None:
        for part in (node.get("references") or "").split(";"):
            name, _, ids = part.partition(":")
            if name.strip() == kind and ids.strip():
                return ids.split()[0]
        return node.get(f"{kind}NodeRef") or node.get(f"{kind}NodeID")

    out = []
    for node in nodes.values():
        if not node.tag.endswith("Volume"):
            continue
        chain, seen, at = np.eye(4), set(), link(node, "transform")
        while at and at in nodes and at not in seen:
            seen.add(at)
            parent = nodes[at]
            chain = np.array(numbers(parent.get("matrixTransformToParent"), np.eye(4).reshape(-1).tolist())).reshape(4, 4) @ chain
            at = link(parent, "transform")
        spacing = np.array(numbers(node.get("spacing"), [1, 1, 1]))
        m = np.eye(4)
        m[:3, :3] = np.array(numbers(node.get("ijkToRASDirections"), np.eye(3).reshape(-1).tolist())).reshape(3, 3) * spacing
        m[:3, 3] = numbers(node.get("origin"), [0, 0, 0])
        m = FLIP @ chain @ m
        norm = np.linalg.norm(m[:3, :3], axis=0)
        storage = nodes.get(link(node, "storage"))
        file = storage.get("fileName") if storage is not None else None
        held = inside.get(unquote(file).rpartition("/")[2]) if file else None
        volume = parse_volume(file, held) if held else {}
        out.append({"name": node.get("name"), "file": file, **{k: volume.get(k) for k in ("dims", "channels", "voxels")}, "origin": m[:3, 3].tolist(), "spacing": norm.tolist(), "direction": (m[:3, :3] / norm).reshape(-1).tolist()})
    return out


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row per volume node of the scene archives (.mrb) under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mrb").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def each(batches: Iterable) -> Iterator:
        for batch in batches:
            for scene, data in zip(batch["path"], batch["content"], strict=True):
                found = volume_nodes(bytes(data))
                if found:
                    yield pd.DataFrame(found).astype({"channels": "Int32"}).assign(scene=scene.rpartition("/")[2])[[c.split()[0] for c in NODE.split(", ")]]

    return files.mapInPandas(each, NODE)
