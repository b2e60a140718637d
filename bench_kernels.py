"""The numpy kernels alone on one volume of the published size, 512 x 512 x 256 in single precision: one JSON line, seconds, one thread."""

from __future__ import annotations

import json
import resource
import sys
import time

import numpy as np

from lumenframe.functions import geometry, kernels

DIMS = (512, 512, 256)


def main() -> None:
    dims = tuple(n // int(sys.argv[1]) for n in DIMS) if len(sys.argv) > 1 else DIMS
    flat = np.random.default_rng(1).random((1, int(np.prod(dims))), np.float32)
    volume, fill, took = flat.reshape(dims[::-1]), np.zeros(1, np.float32), {}

    def timed(name, work) -> None:  # noqa: ANN001
        began = time.perf_counter()
        work()
        took[name] = round(time.perf_counter() - began, 3)

    for factor in (0.25, 0.5, 1.5):
        out = tuple(int(np.ceil(n * factor)) for n in dims)
        pull = geometry.homogeneous(np.eye(3) / factor, [1 - 1 / factor] * 3)
        for name, mode in (("nearest", "round_first"), ("linear", "linear")):
            timed(f"resample_{factor}_{name}", lambda out=out, pull=pull, mode=mode: kernels.pull(flat, pull, np.zeros(3), out, dims, fill, mode))
    centre = np.array(dims) / 2 + 1
    timed("rotate_z_90", lambda: kernels.pull(flat, geometry.homogeneous(geometry.rotation(3, 90)), centre, dims, dims, fill, "linear"))
    timed("rotate_oblique", lambda: kernels.pull(flat, geometry.homogeneous(geometry.rotation(1, 20) @ geometry.rotation(3, 30)), centre, dims, dims, fill, "linear"))
    size = np.array(dims)
    timed("pad_0.1", lambda: kernels.boxed(volume, -np.array((26, 26, 13)), size + 2 * np.array((26, 26, 13)), np.zeros(3, bool), 0.0))
    timed("reorient", lambda: kernels.boxed(volume, np.zeros(3, int), size, np.array([1, 1, 0], bool), 0.0).copy())
    print(json.dumps({"dims": dims, "seconds": took, "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}))


if __name__ == "__main__":
    main()
