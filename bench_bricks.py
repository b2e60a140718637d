"""A volume of 1024 x 1024 x 512 voxels in bricks: seconds, and the most memory that Spark and its workers held together. One JSON line per operator."""

from __future__ import annotations

import json
import os
import threading
import time

import numpy as np
import psutil

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import functions as F

from lumenframe.operators import bricks, volumes
from lumenframe.session import build_session

DIMS, SIDE = (1024, 1024, 512), (128, 128, 64)


def wave(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    x, y, z = (np.arange(b, b + n) for b, n in zip(begin, size, strict=True))
    return np.sin(x / 50)[None, None, :] + np.cos(y / 40)[None, :, None] + np.sin(z / 30)[:, None, None]


class Peak(threading.Thread):
    """The largest sum of resident memory of this process, the JVM and the workers."""

    def __init__(self) -> None:
        super().__init__(daemon=True)
        self.most = 0

    def run(self) -> None:
        me = psutil.Process()
        while True:
            held = 0
            for p in [me, *me.children(recursive=True)]:
                try:
                    held += p.memory_info().rss
                except psutil.Error:
                    pass
            self.most = max(self.most, held)
            time.sleep(0.2)


def main() -> None:
    spark = build_session(cores=os.environ.get("BENCH_CPUS", "2"), partitions=64, memory="1800m")
    spark.sparkContext.setLogLevel("ERROR")
    head = spark.range(1).select(F.col("id").alias("image_id"), volumes.ints(DIMS).alias("dims"), volumes.doubles((0, 0, 0)).alias("origin"), volumes.doubles((1, 1, 1)).alias("spacing"), volumes.doubles(volumes.IDENTITY).alias("direction"))
    source = bricks.generated(head, SIDE, wave)
    peak = Peak()
    peak.start()
    work = {
        "resample to 0.5": lambda: bricks.resample_to_spacing(source, (2, 2, 2)),
        "resample to 0.25": lambda: bricks.resample_to_spacing(source, (4, 4, 4)),
        "rotate about an oblique axis": lambda: bricks.rotate(source, 1, 10, fill=0.0),
        "gradient": lambda: bricks.gradient_magnitude(source),
    }
    for name, make in work.items():
        began = time.perf_counter()
        found = bricks.voxel_sums(make()).first()
        print(json.dumps({"operator": name, "seconds": round(time.perf_counter() - began, 1), "voxels": found["n"], "mean": round(found["total"] / found["n"], 6), "peak_mb": peak.most >> 20}), flush=True)


if __name__ == "__main__":
    main()
