"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once a context, unless they find it already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return spark
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "lumenframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(ROOT.glob("lumenframe/**/*.py")):
            z.write(file, file.relative_to(ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared spark.checkpoint.dir; where none is set and Spark runs on this machine alone, a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
