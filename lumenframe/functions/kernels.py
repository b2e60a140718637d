"""Numpy kernels over batches of volumes that share a shape; voxels are flat with x fastest, positions count from 1."""

from __future__ import annotations

import itertools

import numpy as np


def grid(dims: tuple[int, int, int]) -> np.ndarray:
    """(voxels, 3) positions of all voxels, x fastest."""
    nx, ny, nz = dims
    f = np.arange(nx * ny * nz)
    return np.stack([f % nx + 1, f // nx % ny + 1, f // (nx * ny) + 1], 1)


def flat_index(p: np.ndarray, dims: tuple[int, int, int]) -> np.ndarray:
    return (p[:, 0] - 1) + dims[0] * ((p[:, 1] - 1) + dims[1] * (p[:, 2] - 1))


def weights(points: np.ndarray, dims: tuple[int, int, int], mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, index, weight): the source voxels of each point and their shares, one column per neighbour.

    Bounds are tested on float32 coordinates. 'nearest' tests, then rounds half to even; 'round_first' rounds, then
    tests, so points up to half a voxel outside are kept; 'linear' clamps the upper neighbour to the border.
    """
    p = points.astype(np.float32)
    size = np.array(dims)
    if mode == "round_first":
        r = np.rint(p).astype(np.int64)
        inside = ((r >= 1) & (r <= size)).all(1)
        return inside, flat_index(np.clip(r, 1, size), dims)[:, None], np.ones((len(p), 1))
    inside = ((p >= 1) & (p <= size.astype(np.float32))).all(1)
    if mode == "nearest":
        return inside, flat_index(np.clip(np.rint(p).astype(np.int64), 1, size), dims)[:, None], np.ones((len(p), 1))
    low = np.clip(np.floor(p).astype(np.int64), 1, size)
    part = np.clip(p.astype(np.float64) - low, 0, 1)
    index, weight = [], []
    for corner in range(8):
        up = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
        index.append(flat_index(np.minimum(low + up, size), dims))
        weight.append(np.where(up, part, 1 - part).prod(1))
    return inside, np.stack(index, 1), np.stack(weight, 1)


#: Output voxels that are sampled at once, so that positions and shares stay small whatever the volume.
SLAB = 1 << 18


def slabs(dims: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Ranges of z (from 0) of at most SLAB voxels, or one slice."""
    deep = max(1, SLAB // max(dims[0] * dims[1], 1))
    return [(z, min(z + deep, dims[2])) for z in range(0, dims[2], deep)]


def slab_points(matrix: np.ndarray, dims: tuple[int, int, int], centre: np.ndarray, low: int, high: int) -> np.ndarray:
    p = grid((dims[0], dims[1], high - low)) + np.array([0, 0, low]) - centre
    return p @ matrix[:3, :3].T + matrix[:3, 3] + centre


def axis_shares(p: np.ndarray, size: int, mode: str, first: int = 0, held: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inside, lower, upper, share of the upper) along one axis, by the rules of weights(); places count from 0, or from `first` where only `held` of them are there."""
    p, held = p.astype(np.float32), size if held is None else held
    here = lambda r: np.clip(r - first, 0, held - 1)
    if mode == "round_first":
        r = np.rint(p).astype(np.int64)
        return (r >= 1) & (r <= size), here(r - 1), here(r - 1), np.zeros(len(p))
    inside = (p >= 1) & (p <= np.float32(size))
    if mode == "nearest":
        r = here(np.clip(np.rint(p).astype(np.int64), 1, size) - 1)
        return inside, r, r, np.zeros(len(p))
    low = np.clip(np.floor(p).astype(np.int64), 1, size)
    return inside, here(low - 1), here(np.minimum(low, size - 1)), np.clip(p.astype(np.float64) - low, 0, 1)


class Window:
    """Which part of a sampling is worked out and which part of its source is there: all of both, or one brick from the box that it needs."""

    def __init__(self, dims: tuple[int, int, int], at: tuple[int, int, int] = (0, 0, 0), begin: tuple[int, int, int] = (0, 0, 0), held: tuple[int, int, int] | None = None) -> None:
        self.dims, self.at, self.begin, self.held = dims, at, begin, held or dims

    def shares(self, p: np.ndarray, k: int, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return axis_shares(p, self.dims[k], mode, self.begin[k], self.held[k])

    def positions(self, k: int, n: int) -> np.ndarray:
        return np.arange(1, n + 1) + self.at[k]


def pull_axes(voxels: np.ndarray, steps: np.ndarray, shift: np.ndarray, out_dims: tuple[int, int, int], part: Window, fill: np.ndarray, mode: str) -> np.ndarray:
    """Sampling by a diagonal matrix, axis after axis: positions steps * i + shift with i from 1. Slab by slab of z.

    Rows are gathered before any arithmetic where y shrinks, so that only those which are used are touched; axes on which all samples fall on voxels aren't interpolated.
    """
    kind, held = voxels.dtype, part.held
    v = voxels.reshape(len(voxels), held[2], held[1], held[0])
    (ix, x0, x1, wx), (iy, y0, y1, wy), (iz, z0, z1, wz) = (part.shares(steps[k] * part.positions(k, out_dims[k]) + shift[k], k, mode) for k in range(3))
    wx, wy, wz = (w.astype(kind) for w in (wx, wy, wz))
    out = np.empty((len(voxels), out_dims[2], out_dims[1], out_dims[0]), kind)
    mixed = [bool(w.any()) for w in (wx, wy, wz)]  # along an axis without shares the lower neighbour is the sample
    early = 2 * out_dims[1] <= held[1]
    for a, b in slabs(out_dims):
        w = wz[a:b, None, None]

        def deep(volume: np.ndarray, rows: np.ndarray | slice, a: int = a, b: int = b, w: np.ndarray = w) -> np.ndarray:
            """The rows of the slab, interpolated along z."""
            at = (lambda z: volume[z][:, rows]) if isinstance(rows, slice) else (lambda z: volume[z[:, None], rows])
            return at(z0[a:b]) * (1 - w) + at(z1[a:b]) * w if mixed[2] else at(z0[a:b])

        for k, volume in enumerate(v):
            if not any(mixed):
                s = volume[np.ix_(z0[a:b], y0, x0)]
            else:
                if early:
                    s = deep(volume, y0) * (1 - wy[:, None]) + deep(volume, y1) * wy[:, None] if mixed[1] else deep(volume, y0)
                else:
                    s = deep(volume, slice(None))
                    s = s[:, y0] * (1 - wy[:, None]) + s[:, y1] * wy[:, None] if mixed[1] else s[:, y0]
                s = s[:, :, x0] * (1 - wx) + s[:, :, x1] * wx if mixed[0] else s[:, :, x0]
            out[k, a:b] = s
        outside = ~(iz[a:b, None, None] & iy[:, None] & ix)
        if outside.any():
            out[:, a:b][:, outside] = fill[:, None]
    return out.reshape(len(voxels), -1)


def pull_planes(voxels: np.ndarray, turn: np.ndarray, shift: np.ndarray, out_dims: tuple[int, int, int], part: Window, fill: np.ndarray, mode: str) -> np.ndarray:
    """Sampling by a matrix that leaves z to itself: places and shares are worked out once for all slices. Slab by slab of z."""
    kind, (nx, ny, nz), held = voxels.dtype, out_dims, part.held
    v = voxels.reshape(len(voxels), held[2], held[1] * held[0])
    x, y = np.meshgrid(part.positions(0, nx), part.positions(1, ny))
    (ix, x0, x1, wx), (iy, y0, y1, wy) = (part.shares((turn[k, 0] * x + turn[k, 1] * y + shift[k]).reshape(-1), k, mode) for k in (0, 1))
    iz, z0, z1, wz = part.shares(turn[2, 2] * part.positions(2, nz) + shift[2], 2, mode)
    corners = [(x0 + held[0] * y0, (1 - wx) * (1 - wy)), (x1 + held[0] * y0, wx * (1 - wy)), (x0 + held[0] * y1, (1 - wx) * wy), (x1 + held[0] * y1, wx * wy)]
    corners = [(at, w.astype(kind)) for at, w in (corners if mode == "linear" else [(corners[0][0], np.ones(nx * ny))])]
    still = np.array_equal(z0, np.arange(nz)) and not wz.any()
    out, outside = np.empty((len(voxels), nz, nx * ny), kind), ~(ix & iy)
    for a, b in slabs(out_dims):
        for k, volume in enumerate(v):
            if still:
                s = volume[a:b]
            else:
                w = wz[a:b, None].astype(kind)
                s = volume[z0[a:b]] * (1 - w) + volume[z1[a:b]] * w if mode == "linear" else volume[z0[a:b]]
            piece = np.take(s, corners[0][0], 1)
            if mode == "linear":
                piece *= corners[0][1]
                for at, w in corners[1:]:
                    more = np.take(s, at, 1)
                    more *= w
                    piece += more
            piece[:, outside] = fill[k]
            piece[~iz[a:b]] = fill[k]
            out[k, a:b] = piece
    return out.reshape(len(voxels), -1)


def pull(voxels: np.ndarray, matrix: np.ndarray, centre: np.ndarray, out_dims: tuple[int, int, int], dims: tuple[int, int, int] | Window, fill: np.ndarray, mode: str) -> np.ndarray:
    """Sample (batch, voxels) on the grid of out_dims at matrix * (p - centre) + centre; outside stands `fill` of the volume.

    A diagonal matrix is worked off axis by axis, one that leaves z to itself plane by plane, any other by slabs of z: what is held beside the volumes is bounded by SLAB.
    A Window instead of dims samples a part of the grid from a part of the volume, with the same result.
    """
    part = dims if isinstance(dims, Window) else Window(tuple(dims))
    turn, n = matrix[:3, :3], out_dims[0] * out_dims[1]
    if mode != "cubic" and not turn[~np.eye(3, dtype=bool)].any():
        steps = np.diag(turn)
        return pull_axes(voxels, steps, matrix[:3, 3] + centre - steps * centre, out_dims, part, fill, mode)
    if mode != "cubic" and not (turn[2, :2].any() or turn[:2, 2].any()):
        return pull_planes(voxels, turn, matrix[:3, 3] + centre - turn @ centre, out_dims, part, fill, mode)
    if mode == "cubic" and part.held != part.dims:
        raise ValueError("cubic splines need the whole volume")
    spline = spline_coefficients(voxels, part.dims) if mode == "cubic" else None
    out, shift = np.empty((len(voxels), n * out_dims[2]), voxels.dtype), matrix[:3, 3] + centre - turn @ centre
    x, y = part.positions(0, out_dims[0]), part.positions(1, out_dims[1])[:, None]
    for a, b in slabs(out_dims):
        if spline is not None:
            out[:, n * a : n * b] = cubic_pull(spline, slab_points(matrix, out_dims, centre, a, b), part.dims, fill)
            continue
        z = part.positions(2, out_dims[2])[a:b, None, None]
        (ix, x0, x1, wx), (iy, y0, y1, wy), (iz, z0, z1, wz) = (part.shares((t[0] * x + (t[1] * y + (t[2] * z + c))).reshape(-1), k, mode) for k, (t, c) in enumerate(zip(turn, shift, strict=True)))
        piece = np.zeros((len(voxels), n * (b - a)), voxels.dtype)
        for zk, vz in ((z0, 1 - wz), (z1, wz)) if mode == "linear" else ((z0, None),):
            for yk, vy in ((y0, 1 - wy), (y1, wy)) if mode == "linear" else ((y0, None),):
                line, v = part.held[0] * (yk + part.held[1] * zk), None if vy is None else vy * vz
                for xk, vx in ((x0, 1 - wx), (x1, wx)) if mode == "linear" else ((x0, None),):
                    got = np.take(voxels, xk + line, 1)
                    piece += got if v is None else got * (vx * v).astype(voxels.dtype)
        piece[:, ~(ix & iy & iz)] = fill[:, None]
        out[:, n * a : n * b] = piece
    return out


def push(out: np.ndarray, matrix: np.ndarray, centre: np.ndarray, out_dims: tuple[int, int, int], dims: tuple[int, int, int], mode: str) -> np.ndarray:
    """The transpose of pull: what each source voxel adds to a weighted sum of the outputs. Slab by slab of z, as pull works."""
    grad, n = np.zeros((len(out), int(np.prod(dims)))), out_dims[0] * out_dims[1]
    for a, b in slabs(out_dims):
        inside, index, weight = weights(slab_points(matrix, out_dims, centre, a, b), dims, mode)
        for k in range(index.shape[1]):
            at = index[inside, k]
            if len(at):
                low = at.min()  # a slab reaches only part of the volume
                for row, values in zip(grad, out[:, n * a : n * b], strict=True):
                    found = np.bincount(at - low, (values * weight[:, k])[inside])
                    row[low : low + len(found)] += found
    return grad


def corners_median(voxels: np.ndarray, dims: tuple[int, int, int]) -> np.ndarray:
    """Median of the eight corner voxels: the mean of the middle two."""
    at = [flat_index(np.array([[x, y, z]]), dims)[0] for x in (1, dims[0]) for y in (1, dims[1]) for z in (1, dims[2])]
    return np.sort(voxels[:, at], 1)[:, 3:5].mean(1)


def affine_points(matrix: np.ndarray, dims: tuple[int, int, int], centre: np.ndarray) -> np.ndarray:
    """Where each voxel of the output comes from: matrix * (p - centre) + centre, with the pull-back matrix."""
    p = grid(dims) - centre
    return p @ matrix[:3, :3].T + matrix[:3, 3] + centre


def histogram_match(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The k-th smallest source voxel (ties in order) gets the k-th order statistic of the target, interpolated if sizes differ."""
    t = np.sort(target)
    rank = np.empty(len(source), np.int64)
    rank[np.argsort(source, kind="stable")] = np.arange(len(source))
    if len(t) != len(source):
        t = np.interp(np.linspace(0, len(t) - 1, len(source)), np.arange(len(t)), t)
    return t[rank]


def spline_prefilter(line: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the last axis, with vanishing curvature at both ends.

    Elimination in the tridiagonal system (1/6, 4/6, 1/6): one sweep forth and one back, for all lines together.
    """
    n, c = line.shape[-1], line.copy()
    if n < 3:
        return c
    upper = np.zeros(n)  # the ends are voxels themselves: first and last rows of the system are the identity's
    for i in range(1, n - 1):
        pivot = 4 - upper[i - 1]
        upper[i] = 1 / pivot
        c[..., i] = (6 * c[..., i] - c[..., i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        c[..., i] -= upper[i] * c[..., i + 1]
    return c


def spline_coefficients(voxels: np.ndarray, dims: tuple[int, int, int]) -> np.ndarray:
    """Coefficients of a tensor-product cubic B-spline through the voxels, ends extended linearly: (batch, z + 2, y + 2, x + 2)."""
    c = voxels.reshape(len(voxels), dims[2], dims[1], dims[0]).astype(float)
    for axis in (1, 2, 3):
        c = np.moveaxis(spline_prefilter(np.moveaxis(c, axis, -1)), -1, axis)
        first, last = np.take(c, [0], axis), np.take(c, [-1], axis)
        n = c.shape[axis]
        before = 2 * first - np.take(c, [min(1, n - 1)], axis)
        after = 2 * last - np.take(c, [max(n - 2, 0)], axis)
        c = np.concatenate([before, c, after], axis)
    return c


def cubic_pull(c: np.ndarray, points: np.ndarray, dims: tuple[int, int, int], fill: np.ndarray) -> np.ndarray:
    """Sample the spline of spline_coefficients at the points; outside stands fill."""
    p = points.astype(np.float32).astype(float)
    inside = ((p >= 1) & (p <= np.array(dims))).all(1)
    low = np.clip(np.floor(p).astype(int), 1, np.maximum(np.array(dims) - 1, 1))
    t = p - low
    share = np.stack([(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6])
    out = np.zeros((len(c), len(p)))
    low = np.clip(low, 1, np.array(dims))
    for i in range(4):
        for j in range(4):
            for k in range(4):
                at = (np.minimum(low[:, 2] - 1 + k, dims[2] + 1), np.minimum(low[:, 1] - 1 + j, dims[1] + 1), np.minimum(low[:, 0] - 1 + i, dims[0] + 1))
                out += c[:, at[0], at[1], at[2]] * (share[i, :, 0] * share[j, :, 1] * share[k, :, 2])
    return np.where(inside, out, fill[:, None])


def convolve_same(volume: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Linear convolution by FFT, cut to the volume's shape."""
    shape = [a + b - 1 for a, b in zip(volume.shape, kernel.shape, strict=True)]
    full = np.fft.irfftn(np.fft.rfftn(volume, shape) * np.fft.rfftn(kernel, shape), shape)
    return full[tuple(slice((k - 1) // 2, (k - 1) // 2 + n) for n, k in zip(volume.shape, kernel.shape, strict=True))]


def dose_point_kernel(radius: int, spacing: tuple[float, float, float], sigma: float, attenuation: float) -> np.ndarray:
    """A local Gaussian plus exp(-mu r) / (4 pi r^2), each normalized, then both together."""
    z, y, x = np.meshgrid(*(np.arange(-radius, radius + 1) * s for s in reversed(spacing)), indexing="ij")
    r = np.sqrt(x * x + y * y + z * z)
    near = np.exp(-(r**2) / (2 * sigma**2))
    far = np.exp(-attenuation * r) / (4 * np.pi * np.maximum(r, min(spacing) / 2) ** 2)
    both = near / near.sum() + far / far.sum()
    return both / both.sum()


def boxed(volume: np.ndarray, begin: np.ndarray, size: np.ndarray, flip: np.ndarray, fill: float) -> np.ndarray:
    """The box of `size` voxels from `begin` (x, y, z from 0; may lie outside) of a (..., z, y, x) volume or stack, some axes reversed."""
    out = np.full((*volume.shape[:-3], *size[::-1]), fill, volume.dtype)
    source, target = [...], [...]
    for b, s, n in zip(begin[::-1], size[::-1], volume.shape[-3:], strict=True):
        low, high = max(b, 0), min(b + s, n)
        source.append(slice(low, max(high, low)))
        target.append(slice(low - b, max(high, low) - b))
    out[tuple(target)] = volume[tuple(source)]
    return out[(..., *(slice(None, None, -1) if f else slice(None) for f in flip[::-1]))]


def gradient_magnitude(volume: np.ndarray, eps: float) -> np.ndarray:
    """sqrt of the squared central differences, 0 on the border of each axis, plus eps."""
    squares = np.full(volume.shape, eps)
    for axis in range(3):
        inner = [slice(None)] * 3
        inner[axis] = slice(1, -1)
        if volume.shape[axis] > 2:
            squares[tuple(inner)] += (np.gradient(volume, axis=axis)[tuple(inner)]) ** 2
    return np.sqrt(squares)


def flux(volume: np.ndarray, axis: int) -> np.ndarray:
    """Next voxel less the one before along x, y or z (0, 1, 2) of a (z, y, x) volume; an end voxel is its own neighbour."""
    wide = np.pad(volume, [(1, 1) if k == 2 - axis else (0, 0) for k in range(3)], mode="edge")
    n = volume.shape[2 - axis]
    return np.take(wide, range(2, n + 2), 2 - axis) - np.take(wide, range(n), 2 - axis)


def box_mean(volume: np.ndarray) -> np.ndarray:
    """Mean over 3 x 3 x 3 voxels, the border mirrored."""
    p = np.pad(volume, 1, mode="symmetric")
    for axis in range(3):
        n = p.shape[axis] - 2
        p = sum(np.take(p, range(k, k + n), axis) for k in range(3)) / 3
    return p


def nearest_on_lines(f: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (i - j)^2 for every i of the first axis: the lower envelope of parabolas, all lines (n, lines) together.

    Each line has a stack of the parabolas that are lowest somewhere, and where each begins to be. A new one pops those it hides; a step works on the lines
    that still have to pop, so the work is in proportion to the voxels, whatever they hold.
    """
    n, m = f.shape
    g = f + (np.arange(n, dtype=float) ** 2)[:, None]  # a parabola at j is g[j] - 2 i j, but for i^2
    lines = np.arange(m)
    at, begins, top = np.zeros((n, m), np.int32), np.empty((n + 1, m)), np.zeros(m, np.int32)
    flat_at, flat_begins, flat_g = at.reshape(-1), begins.reshape(-1), g.reshape(-1)
    begins[0] = -np.inf
    for q in range(1, n):
        todo, k, lifted = lines, top, g[q]
        while len(todo):
            place = k * m + todo
            v = flat_at[place]
            cross = (lifted - flat_g[v * m + todo]) / (2.0 * (q - v))
            hidden = cross <= flat_begins[place]
            stay = ~hidden
            done, place = todo[stay], place[stay] + m
            top[done] = k[stay] + 1
            flat_at[place], flat_begins[place] = q, cross[stay]
            todo, k, lifted = todo[hidden], k[hidden] - 1, lifted[hidden]
    begins[top + 1, lines] = np.inf
    out, k = np.empty_like(f), np.zeros(m, np.int32)
    for q in range(n):
        todo = lines
        while len(todo):
            todo = todo[flat_begins[(k[todo] + 1) * m + todo] < q]
            k[todo] += 1
        v = flat_at[k * m + lines]
        out[q] = flat_g[v * m + lines] - (2.0 * q) * v + q * q
    return out


#: Lines whose envelopes are built together; their stacks stay in the cache.
LINES = 4096


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance in voxels to the nearest voxel of the mask, in time linear in the voxels. 100 if there is none.

    Along the first axis distances are running ones, forth and back; along the others they are lower envelopes of parabolas.
    """
    if not mask.any():
        return np.full(mask.shape, 100.0)
    far = float(sum(mask.shape))
    d = np.where(mask, 0.0, far)
    for q in range(1, len(d)):
        np.minimum(d[q], d[q - 1] + 1, out=d[q])
    for q in range(len(d) - 2, -1, -1):
        np.minimum(d[q], d[q + 1] + 1, out=d[q])
    d2 = np.where(d < far, d * d, 1e9)
    for axis in (1, 2):
        n = d2.shape[axis]
        if n > 1:
            lines = np.moveaxis(d2, axis, 0).reshape(n, -1)
            for a in range(0, lines.shape[1], LINES):
                lines[:, a : a + LINES] = nearest_on_lines(lines[:, a : a + LINES])
            d2 = np.moveaxis(lines.reshape([n, *(s for k, s in enumerate(d2.shape) if k != axis)]), 0, axis)
    return np.sqrt(d2)


def gaussian_taps(size: int, sigma: float) -> np.ndarray:
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return g / g.sum()


def ssim(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5, c1: float = 0.01**2, c2: float = 0.03**2) -> float:
    """Mean structural similarity of two stacks of 2-D slices: Gaussian windows, zeros beyond the border."""
    taps, half = gaussian_taps(size, sigma), size // 2

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (1, 2):
            pad = [(0, 0)] * 3
            pad[axis] = (half, half)
            wide, n = np.pad(x, pad), x.shape[axis]
            x = sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(taps))
        return x

    m, n = blur(a), blur(b)
    va, vb, cov = blur(a * a) - m * m, blur(b * b) - n * n, blur(a * b) - m * n
    return float((((2 * m * n + c1) * (2 * cov + c2)) / ((m * m + n * n + c1) * (va + vb + c2))).mean())


def principal_axis(centred: np.ndarray) -> np.ndarray:
    """The axis along which rows of (x, y, z) about their mean spread most, of any length, its largest component (the first of equals, to nine digits) positive.

    The covariance is squared forty times, its trace held at 1, which leaves the outer product of the axis with itself. Where two axes are of one length, that is
    a plane's projector, whose column is one direction of it; sums are added up in the order of the rows, so it is the same one on every machine.
    """
    a, b, c, d, e, f = (float(np.cumsum(centred[:, i] * centred[:, j])[-1]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    t = a + d + f
    a, b, c, d, e, f = (k / t for k in (a, b, c, d, e, f))
    for _ in range(40):
        t = a * a + d * d + f * f + 2 * (b * b + c * c + e * e)
        a, b, c, d, e, f = (a * a + b * b + c * c) / t, (a * b + b * d + c * e) / t, (a * c + b * e + c * f) / t, (b * b + d * d + e * e) / t, (b * c + d * e + e * f) / t, (c * c + e * e + f * f) / t
    return np.array([[a, b, c], [b, d, e], [c, e, f]][int(np.array([a, d, f]).round(9).argmax())])


def endpoints(volume: np.ndarray, above: float) -> np.ndarray:
    """Both ends (x, y, z from 0) of the voxels above a threshold along their principal axis; ties go to the first in flat order.

    Without such voxels both are (16, 16, 16), for a single one both are it.
    """
    z, y, x = np.nonzero(volume > above)
    if not len(x):
        return np.full(6, 16.0)
    p = np.stack([x, y, z], 1).astype(float)
    if len(p) == 1:
        return np.concatenate([p[0], p[0]])
    c = p - p.mean(0)
    u = principal_axis(c)
    along = ((c[:, 0] * u[0] + c[:, 1] * u[1] + c[:, 2] * u[2]) / np.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])).round(9)
    return np.concatenate([p[along.argmin()], p[along.argmax()]])


def matrix_gradient(voxels: np.ndarray, gradients: np.ndarray, matrix: np.ndarray, dims: tuple[int, int, int], centre: np.ndarray) -> np.ndarray:
    """Of sum(gradients * linear samples), by the first three rows of the pull-back matrix; slab by slab."""
    out, n = np.zeros((3, 4)), dims[0] * dims[1]
    size = np.array(dims)
    for a, b in slabs(dims):
        p = slab_points(matrix, dims, centre, a, b).astype(np.float32).astype(float)
        inside = ((p >= 1) & (p <= size)).all(1)
        low = np.clip(np.floor(p).astype(np.int64), 1, size)
        part = np.clip(p - low, 0, 1)
        slope = np.zeros((len(p), 3))
        for corner in range(8):
            up = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
            value = voxels[flat_index(np.minimum(low + up, size), dims)]
            share = np.where(up, part, 1 - part)
            for k in range(3):
                slope[:, k] += (1 if up[k] else -1) * value * np.delete(share, k, 1).prod(1)
        g = np.where(inside, gradients[n * a : n * b], 0.0)
        place = np.hstack([grid((dims[0], dims[1], b - a)) + np.array([0, 0, a]) - centre, np.ones((len(p), 1))])
        out += (slope * g[:, None]).T @ place
    return out.reshape(-1)


def moments(volume: np.ndarray) -> tuple[float, float, float, float]:
    """Weighted mean position (x, y, z from 1) and the largest distance of a positive voxel from it."""
    total = volume.sum()
    axes = [np.arange(1, n + 1) for n in reversed(volume.shape)]
    sums = [volume.sum(tuple(k for k in range(3) if k != 2 - i)) for i in range(3)]
    c = [float((a * s).sum() / total) if total != 0 else 0.0 for a, s in zip(axes, sums, strict=True)]
    z, y, x = np.nonzero(volume > 0)
    far = ((x + 1 - c[0]) ** 2 + (y + 1 - c[1]) ** 2 + (z + 1 - c[2]) ** 2).max() if len(x) else 0.0
    return (*c, float(np.sqrt(far)))


def slice_bounds(volume: np.ndarray) -> list[np.ndarray]:
    """Per axis x, y, z of a (z, y, x) volume the least and largest value of each slice across it: (2, slices)."""
    others = [(0, 1), (0, 2), (1, 2)]
    return [np.stack([volume.min(o), volume.max(o)]) for o in others]


def axes_between(a: np.ndarray, b: np.ndarray) -> tuple[str | None, str | None]:
    """The first permutation and reversal of the axes of a (z, y, x) volume that gives the flat voxels b, as texts of digits; nulls if none does."""
    if a.size != b.size:
        return None, None
    mine = slice_bounds(a)
    seen: dict[tuple, list[np.ndarray]] = {}
    for perm in itertools.permutations(range(3)):
        shape = tuple(a.shape[2 - k] for k in reversed(perm))
        other = b.reshape(shape)
        if shape not in seen:
            seen[shape] = slice_bounds(other)
        ways = [[r for r in (0, 1) if np.array_equal(mine[k][:, ::-1] if r else mine[k], seen[shape][i], equal_nan=True)] for i, k in enumerate(perm)]
        moved = a.transpose([2 - k for k in reversed(perm)])
        for rev in ((x, y, z) for z in ways[2] for y in ways[1] for x in ways[0]):
            if np.array_equal(moved[tuple(slice(None, None, -1) if r else slice(None) for r in reversed(rev))], other, equal_nan=True):
                return "".join(map(str, perm)), "".join(map(str, rev))
    return None, None
