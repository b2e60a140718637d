"""Bricks, points and chains against whole volumes and plain loops; kernels that were made linear or bounded."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry, kernels
from lumenframe.operators import bricks, chain, curves, dose, masks, noise, points, spatial, volumes

SCHEMA = "image_id long, dims array<int>, voxels array<double>, origin array<double>, spacing array<double>, direction array<double>, label string"
OBLIQUE = geometry.rotation(3, 20).reshape(-1).tolist()


def table(spark, shapes, seed=0, spacing=(1.0, 1.0, 1.0), direction=volumes.IDENTITY):
    rng = np.random.default_rng(seed)
    rows = [(i, list(s), rng.standard_normal(int(np.prod(s))).tolist(), [0.0, 1.0, 2.0], list(map(float, spacing)), list(map(float, direction)), f"l{i}") for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b, tolerance=0.0):
    a, b = ({r["image_id"]: r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for k, x in a.items():
        y = b[k]
        assert list(x["dims"]) == list(y["dims"]) and x["label"] == y["label"] and np.allclose(x["spacing"], y["spacing"])
        assert np.allclose(x["voxels"], y["voxels"], atol=tolerance, rtol=0, equal_nan=True)


SHAPES = [(5, 4, 7), (1, 1, 1), (3, 6, 2)]
SIDES = [(2, 3, 4), (1, 1, 1), (9, 9, 9)]


@pytest.mark.parametrize("side", SIDES)
def test_split_and_join(spark, side):
    df = table(spark, SHAPES)
    same(bricks.join(bricks.split(df, side)), df)


@pytest.mark.parametrize("side", SIDES[:2])
def test_bricks_equal_whole_volumes(spark, side):
    df = table(spark, SHAPES, spacing=(1, 1.5, 2), direction=OBLIQUE)
    cut = bricks.split(df, side)
    turn = geometry.affine_matrix((0.5, -1, 0.25), (20, 30, 40), (1.2, 0.7, 1.0), (0.1, 0, 0.2))
    same(bricks.join(bricks.resample_to_spacing(cut, (0.8, 3, 1.1), kind="double")), spatial.resample_to_spacing(df, (0.8, 3, 1.1), kind="double"))
    same(bricks.join(bricks.resample_to_spacing(cut, (3, 4, 9), "nearest", kind="double")), spatial.resample_to_spacing(df, (3, 4, 9), "nearest", kind="double"))
    same(bricks.join(bricks.rotate(cut, 2, 30, kind="double")), spatial.rotate(df, 2, 30, kind="double"))
    same(bricks.join(bricks.affine(cut, turn, (6, 5, 4), fill=-3.0, kind="double")), spatial.affine(df, turn, (6, 5, 4), fill=F.lit(-3.0), kind="double"))
    same(bricks.join(bricks.gradient_magnitude(cut)), masks.gradient_magnitude(df))
    same(bricks.join(bricks.map_bricks(cut, kernels.box_mean, 1)), masks.map_voxels(df, kernels.box_mean), 1e-12)


@pytest.mark.parametrize("radius", [1, 3])
def test_convolution_by_overlap_save(spark, radius):
    df = table(spark, [(7, 6, 5), (9, 2, 3)], 3)
    same(bricks.join(bricks.point_kernel_dose(bricks.split(df, (3, 2, 4)), (1, 1, 1), radius)), dose.point_kernel_dose(df, radius), 1e-12)


@pytest.mark.parametrize(("patch", "stride"), [(3, 1), (4, 3), (5, 2)])
def test_blending_in_bricks(spark, patch, stride):
    df = table(spark, [(7, 6, 5), (3, 8, 4)], 5)
    predict, rest = (lambda c: c * c.max()), (lambda c: 2 * c)
    want = dose.blend_patches(df, patch, stride, predict, rest, 1.5)
    same(bricks.join(bricks.blend_patches(bricks.split(df, (3, 2, 4)), patch, stride, predict, rest, 1.5)), want, 1e-9)


@pytest.mark.parametrize("held", [1, 100, 1 << 20])
@pytest.mark.parametrize(("patch", "stride"), [(4, 2), (5, 3)])
def test_blending_in_blocks_of_bricks(spark, monkeypatch, held, patch, stride):
    """Bricks are put together into blocks of any size, also when a box's pieces come in several batches; each cube is predicted once."""
    monkeypatch.setattr(bricks, "HELD", held)
    monkeypatch.setattr(bricks, "BLOCK", held)
    predicted = spark.sparkContext.accumulator(0)

    def predict(cube):
        predicted.add(1)
        return cube * cube.max()

    rest = lambda c: 2 * c
    df = table(spark, [(9, 10, 7), (3, 8, 4), (9, 10, 7), (1, 1, 1)], 6)
    want = dose.blend_patches(df, patch, stride, lambda c: c * c.max(), rest, 1.5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = bricks.blend_patches(bricks.split(df, (2, 3, 2)), patch, stride, predict, rest, 1.5).localCheckpoint()
        same(bricks.join(got), want, 1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cubes = [math.prod(len(dose.patch_starts(n, patch, stride)) for n in r["dims"]) for r in df.collect()]
    assert 0 < predicted.value <= sum(cubes)
    assert {tuple(r["side"]) for r in got.collect()} == {(2, 3, 2)} and got.count() == sum(math.prod(-(-n // k) for n, k in zip(r["dims"], (2, 3, 2), strict=True)) for r in df.collect())


def test_small_volumes_are_blended_whole(spark, monkeypatch):
    """A brick of a small volume gives one piece, and the volume's sums are one: pieces don't grow with the bricks that a cube reaches."""
    moved, plain = [], bricks.in_boxes
    monkeypatch.setattr(bricks, "in_boxes", lambda pieces, *args, **more: moved.append(pieces.count()) or plain(pieces, *args, **more))
    df = table(spark, [(6, 6, 6)] * 20)
    done = bricks.blend_patches(bricks.split(df, (2, 3, 2)), 4, 2, lambda c: c * c.max())
    assert done.count() == 20 * 18 and moved == [20 * 18, 20]


@pytest.mark.parametrize("kind", ["tinyint", "int", "float", "double"])
def test_split_and_join_keep_what_voxels_are(spark, kind):
    df = table(spark, [*SHAPES, (5, 4, 7)]).withColumn("voxels", F.transform("voxels", lambda v: (v * 9).cast(kind)))
    df = df.union(df.where("image_id = 1").withColumns({"image_id": F.lit(9), "label": F.lit(None), "voxels": F.lit(None)}))
    back = bricks.join(bricks.split(df, (2, 3, 4)))
    assert dict(back.dtypes) == dict(df.dtypes)
    same(back, df.where("voxels is not null"))


def test_a_brick_far_from_all_output_is_filled(spark):
    df = table(spark, [(6, 6, 6)])
    away = geometry.affine_matrix((100, 0, 0))
    got = bricks.join(bricks.affine(bricks.split(df, (2, 2, 2)), away, fill=5.0, kind="double")).first()
    assert set(got["voxels"]) == {5.0}


def test_generated_bricks(spark):
    head = table(spark, [(5, 6, 7)]).drop("voxels")

    def make(begin, size):
        z, y, x = np.meshgrid(*(np.arange(b, b + n) for b, n in zip(begin[::-1], size[::-1], strict=True)), indexing="ij")
        return x + 10 * y + 100 * z

    got = bricks.join(bricks.generated(head, (2, 4, 3), make)).first()
    assert got["voxels"] == [x + 10 * y + 100 * z for z in range(7) for y in range(6) for x in range(5)]
    sums = bricks.voxel_sums(bricks.generated(head, (2, 4, 3), make)).first()
    assert (sums["n"], sums["low"], sums["high"]) == (210, 0, 654)


def test_no_task_holds_more_than_a_source_box(spark):
    """Shrinking by 8 takes output bricks of an eighth of the side, so a box stays a brick's size."""
    df = table(spark, [(64, 4, 4)])
    cut = bricks.split(df, (16, 4, 4))
    held = bricks.map_bricks(cut, lambda v: np.full(v.shape, v.size), 1)
    assert max(max(r["voxels"]) for r in held.collect()) <= 18 * 16
    small = bricks.resample_to_spacing(cut, (8, 1, 1))
    assert {r["side"][0] for r in small.select("side").collect()} == {2}


# ---- points ----------------------------------------------------------------------------------------------------
POINTS = "image_id long, point long, px double, py double, pz double, g double, label string"


def scattered(spark, n=200, seed=2, images=3):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, images + 1)), i, *(float(x) for x in np.round(rng.uniform(-1, 9, 3), int(rng.integers(0, 3)))), float(rng.standard_normal()), "p") for i in range(n)]
    return spark.createDataFrame([*rows, (0, n, None, 1.0, 1.0, 1.0, "p"), (0, n + 1, 1.0, 1.0, 1.0, 1.0, "p"), (0, n + 2, 0.5, 1.0, 2.0, 1.0, "p")], POINTS)


def at_point(volume, spacing, p, mode, fill, keep):
    """A plain sample of a (z, y, x) volume."""
    if any(c is None for c in p):
        return fill
    q = [float(np.float32((c - 1) / s + 1)) for c, s in zip(p, spacing, strict=True)]
    if keep:
        q = [1.0 if c >= 0 and i < 1 else i for c, i in zip(p, q, strict=True)]
    size = volume.shape[::-1]
    if any(i < 1 or i > n for i, n in zip(q, size, strict=True)):
        return fill
    if mode == "nearest":
        x, y, z = (int(np.rint(i)) - 1 for i in q)
        return volume[z, y, x]
    out = 0.0
    for up in np.ndindex(2, 2, 2):
        low = [math.floor(i) for i in q]
        w = math.prod(i - a if u else 1 - (i - a) for i, a, u in zip(q, low, up, strict=True))
        x, y, z = (min(a + u, n) - 1 for a, u, n in zip(low, up, size, strict=True))
        out += w * volume[z, y, x]
    return out


@pytest.mark.parametrize("mode", ["linear", "nearest"])
@pytest.mark.parametrize("keep", [False, True])
@pytest.mark.parametrize(("side", "crowd"), [((2, 3, 2), 1_000_000), ((64, 64, 64), 5)])
def test_sampling_at_points(spark, monkeypatch, mode, keep, side, crowd):
    monkeypatch.setattr(points, "CROWD", crowd)
    spacing = (1.0, 1.5, 2.0)
    df = table(spark, SHAPES, spacing=spacing)
    volume = {r["image_id"]: np.array(r["voxels"]).reshape(r["dims"][::-1]) for r in df.collect()}
    got = points.sample_points(bricks.split(df, side), scattered(spark), mode, -9.0, keep).collect()
    assert len(got) == len({r["point"] for r in got}) == sum(r["image_id"] in volume for r in scattered(spark).collect())
    for r in got:
        assert r["label"] == "p" and math.isclose(r["value"], at_point(volume[r["image_id"]], spacing, (r["px"], r["py"], r["pz"]), mode, -9.0, keep), abs_tol=1e-9)


def test_one_list_of_points_for_all_images(spark):
    df = table(spark, SHAPES)
    shared = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 50.0, 1.0, 1.0)], "point long, px double, py double, pz double")
    got = {(r["image_id"], r["point"]): r["value"] for r in points.sample_points(df, points.for_each_image(shared, df), fill=0.5).collect()}
    assert len(got) == 6 and got[0, 2] == 0.5 and got[0, 1] == df.where("image_id = 0").first()["voxels"][0]


def test_gradients_by_points_are_difference_quotients(spark):
    spacing, step = (1.0, 1.5, 2.0), 1e-4
    df = table(spark, SHAPES[::2], spacing=spacing)
    rng = np.random.default_rng(6)
    rows = [(int(i % 2), i, *(1 + (rng.uniform(0.1, 0.9) + int(rng.integers(0, n - 1))) * s for n, s in zip((SHAPES[0], SHAPES[2])[i % 2], spacing, strict=True)), float(rng.standard_normal()), "p") for i in range(60)]
    pts = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], POINTS)
    found = {r["point"]: r for r in points.point_gradients(bricks.split(df, (2, 3, 2)), pts, "g").collect()}
    volume = {r["image_id"]: np.array(r["voxels"]).reshape(r["dims"][::-1]) for r in df.collect()}
    for i, name, *p, g, _ in [(r[0], r[1], *r[2:]) for r in rows]:
        for k, axis in enumerate("xyz"):
            ends = [at_point(volume[i], spacing, [c + (d * step if j == k else 0) for j, c in enumerate(p)], "linear", 0.0, False) for d in (1, -1)]
            assert math.isclose(found[name][f"d{axis}"], g * (ends[0] - ends[1]) / (2 * step), abs_tol=6e-3)


@pytest.mark.parametrize("mode", ["linear", "nearest"])
def test_voxel_gradients_are_the_transpose_of_sampling(spark, mode):
    df = table(spark, SHAPES, spacing=(1, 1.5, 2))
    pts = scattered(spark)
    forward = points.sample_points(df, pts, mode).select(F.sum(F.col("value") * F.col("g"))).first()[0]
    back = points.voxel_gradients(df, pts, "g", mode)
    voxels = volumes.voxel_rows(df).select("image_id", "x", "y", "z", F.col("value").alias("v"))
    assert math.isclose(forward, back.join(voxels, ["image_id", "x", "y", "z"]).select(F.sum(F.col("value") * F.col("v"))).first()[0], abs_tol=1e-9)


def test_gradient_by_the_matrix_of_coordinates(spark):
    df = table(spark, [(3, 4, 2)]).withColumn("m", volumes.doubles(geometry.affine_matrix((1, 2, 3), (10, 20, 30)).reshape(-1)))
    weigh = F.col("x") * F.col("px") + F.col("y") * F.col("py") * 2 - F.col("z") * F.col("pz")
    total = lambda d: points.transformed_points(d, "m").select(F.sum(weigh)).first()[0]
    rows = points.transformed_points(df, "m").select("image_id", "x", "y", "z", F.col("x").alias("gx"), (2 * F.col("y")).alias("gy"), (-F.col("z")).alias("gz"))
    found = points.coordinates_gradient(rows, df).first()["d_matrix"]
    for k in range(12):
        step = volumes.doubles([0.5 * (i == k) for i in range(16)])
        moved = df.withColumn("m", F.zip_with("m", step, lambda v, s: v + s))
        assert math.isclose(found[k], (total(moved) - total(df)) / 0.5, abs_tol=1e-6)


# ---- chains ----------------------------------------------------------------------------------------------------
def test_a_chain_samples_once(spark):
    df = table(spark, SHAPES, spacing=(1, 1.5, 2), direction=OBLIQUE)
    lazy = chain.Chain(df).rotate(3, 30).scale((1.5, 1, 0.5)).translate(2, 1).resample((0.5, 2, 1)).crop((1, 0, -1), (6, 3, 5))
    done = lazy.done(kind="double", fill=F.lit(0.0))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kernel(") == 1
    for r in done.collect():
        source = df.where(F.col("image_id") == r["image_id"]).first()
        assert list(r["dims"]) == [6, 3, 5] and list(r["spacing"]) == [0.5, 2, 1]
        m, dims = geometry.index_to_physical(source["spacing"], source["direction"]), np.array(source["dims"])
        volume = np.array(source["voxels"]).reshape(dims[::-1])
        turn, centre = np.linalg.inv(m) @ geometry.rotation(3, 30, source["direction"]) @ m, dims / 2 + 1
        want = []
        for z in range(1, 6):
            for y in range(1, 4):
                for x in range(1, 7):
                    p = np.array([x + 1, y, z - 1]) - 1
                    p = p * np.array([0.5, 2, 1]) / np.array(source["spacing"])
                    p = p / np.array([1.5, 1, 0.5]) + 1
                    want.append(at_point(volume, (1, 1, 1), turn @ (p - centre) + centre, "linear", 0.0, False))
        assert np.allclose(r["voxels"], want, atol=1e-5)


def test_a_chain_of_one_is_the_operator(spark):
    df = table(spark, SHAPES, spacing=(1, 1.5, 2), direction=OBLIQUE)
    same(chain.Chain(df).rotate(2, 40).done(kind="double"), spatial.rotate(df, 2, 40, kind="double"), 1e-9)
    same(chain.Chain(df).resample((0.7, 2, 3)).done(kind="double"), spatial.resample_to_spacing(df, (0.7, 2, 3), kind="double"), 1e-6)
    turn = geometry.affine_matrix((0, 1, 0), (5, 10, 15), (1, 2, 1))
    same(chain.Chain(df).affine(turn).done(kind="double"), spatial.affine(df, turn, kind="double"), 1e-6)
    same(chain.Chain(df).affine(turn).affine(np.linalg.inv(turn)).done(kind="double"), df, 1e-5)


# ---- kernels ---------------------------------------------------------------------------------------------------
def test_distances_are_exact_and_linear_in_time():
    rng = np.random.default_rng(1)
    for shape in ((5, 6, 7), (1, 9, 1), (8, 1, 3), (4, 4, 4)):
        for share in (0.02, 0.3):
            mask = rng.random(shape) < share
            hot = np.argwhere(mask)
            grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1)
            want = np.sqrt(((grid[..., None, :] - hot) ** 2).sum(-1).min(-1)) if len(hot) else np.full(shape, 100.0)
            assert np.allclose(kernels.distance_to(mask), want)
    took = []
    for n in (48, 96):
        one = np.zeros((n, n, n), bool)
        one[3, 4, 5] = True
        began = time.perf_counter()
        kernels.distance_to(one)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] and took[1] < 10  # eight times the voxels


def test_spline_filter_solves_the_system():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 33):
        c = kernels.spline_prefilter(v := rng.standard_normal((2, n)))
        inner = (c[:, :-2] + 4 * c[:, 1:-1] + c[:, 2:]) / 6
        assert np.allclose(inner, v[:, 1:-1]) and np.allclose(c[:, [0, -1]], v[:, [0, -1]])


def test_pushing_by_slabs(monkeypatch):
    rng = np.random.default_rng(5)
    matrix, y = geometry.affine_matrix((0.3, 0, -0.2), (10, 20, 30)), rng.standard_normal((2, 6 * 5 * 4))
    want = kernels.push(y, matrix, np.full(3, 2.0), (6, 5, 4), (5, 5, 5), "linear")
    monkeypatch.setattr(kernels, "SLAB", 1)
    assert np.allclose(kernels.push(y, matrix, np.full(3, 2.0), (6, 5, 4), (5, 5, 5), "linear"), want)


def test_axes_of_a_large_pair(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 5, (64, 48, 56)).astype(np.float32)  # (z, y, x)
    b = np.flip(a.transpose(1, 2, 0), 0)
    began = time.perf_counter()
    assert kernels.axes_between(a, b.reshape(-1)) == ("201", "001")
    assert kernels.axes_between(a, rng.permutation(b.reshape(-1))) == (None, None)
    assert time.perf_counter() - began < 5
    df = spark.createDataFrame([(a.reshape(-1).tolist(), b.reshape(-1).tolist())], "a array<float>, b array<float>")
    found = spatial.match_axes(df, (56, 48, 64))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 5000
    assert found.select("permuted", "reversed").first() == ("201", "001")


def test_blending_window():
    assert np.allclose(dose.cosine_window(3), [0, 1, 0], atol=1e-15)
    assert np.allclose(dose.cosine_window(5), [0, math.sqrt(0.5), 1, math.sqrt(0.5), 0], atol=1e-15)
    assert dose.cosine_window(1) == [1.0]


def test_flux_at_the_ends():
    v = np.arange(24.0).reshape(2, 3, 4) ** 2
    assert kernels.flux(v, 0)[0, 0].tolist() == [1, 4, 8, 5] and kernels.flux(v, 2)[:, 0, 0].tolist() == [144, 144]


# ---- curves and noise ------------------------------------------------------------------------------------------
def nested(t, a, mu):
    """Inner and outer integrals by trapezoids on a fine grid."""
    u = np.linspace(t[0], t[-1], 40_001)
    y, step, inner = np.interp(u, t, a), (t[-1] - t[0]) / 40_000, np.zeros(40_001)
    for i in range(1, len(u)):
        inner[i] = inner[i - 1] * math.exp(-mu * step) + step * (y[i - 1] * math.exp(-mu * step) + y[i]) / 2
    return float(np.sum((y * inner)[1:] + (y * inner)[:-1]) * step / 2)


@pytest.mark.parametrize("span", [20.0, 1000.0, 5000.0])
def test_organ_dose_of_long_curves(spark, span):
    mu, n = 0.5, int(4 * span) + 1
    t = np.linspace(0, span / mu, n)
    a = np.exp(-t / (t[-1] / 3)) * 5
    rows = [(1, float(x), float(y)) for x, y in zip(t, a, strict=True)]
    c = curves.clean(spark.createDataFrame(rows, "curve long, t double, a double"))
    got = curves.organ_dose(c, spark.createDataFrame([(1, 2.0, mu, 10.0)], "curve long, s_value double, mu double, alpha_beta double")).first()
    auc = float(np.sum((a[1:] + a[:-1]) * np.diff(t)) / 2)
    assert math.isclose(got["auc"], auc, rel_tol=1e-12) and math.isclose(got["g"], 2 * nested(t, a, mu) / auc**2, rel_tol=2e-2)
    assert math.isclose(got["bed"], got["dose"] * (1 + got["g"] * got["dose"] / 10), rel_tol=1e-12)


def test_running_integral_is_simpson_at_every_point():
    rng = np.random.default_rng(8)
    t, y, mu = np.cumsum(rng.uniform(0.2, 2, 9)), rng.random(9), 0.3

    def simpson(t, y):
        total, n = 0.0, len(t)
        if n == 2:
            return (t[1] - t[0]) * (y[0] + y[1]) / 2
        for i in range(0, n - 2, 2):
            h0, h1 = t[i + 1] - t[i], t[i + 2] - t[i + 1]
            total += (h0 + h1) / 6 * ((2 - h1 / h0) * y[i] + (h0 + h1) ** 2 / (h0 * h1) * y[i + 1] + (2 - h0 / h1) * y[i + 2])
        if n % 2 == 0:
            h0, h1 = t[-2] - t[-3], t[-1] - t[-2]
            total += y[-1] * (2 * h1**2 + 3 * h0 * h1) / (6 * (h0 + h1)) + y[-2] * (h1**2 + 3 * h1 * h0) / (6 * h0) - y[-3] * h1**3 / (6 * h0 * (h0 + h1))
        return total

    got = curves.decayed_simpson(t, y, mu)
    assert got[0] == 0 and np.allclose(got[1:], [simpson(t[: i + 1], y[: i + 1] * np.exp(-mu * (t[i] - t[: i + 1]))) for i in range(1, 9)])
    assert np.isfinite(curves.decayed_simpson(np.array([0.0, 1, 1, 2, 3]), np.ones(5), 1.0)).all()


@pytest.mark.parametrize("zeros", [0.0, 0.7])
def test_medians_with_ties(spark, zeros):
    rng = np.random.default_rng(9)
    values = {g: np.where(rng.random(n) < zeros, 0.0, rng.standard_normal(n).round(2)) for g, n in (("a", 5001), ("b", 4000), ("c", 1), ("d", 2))}
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [("a", None)], "g string, x double")
    got = dict(map(tuple, curves.medians(df, F.col("x"), ["g"]).collect()))
    assert got == {g: float(np.median(v)) for g, v in values.items()}


def test_thinning_draws_by_key_alone(spark):
    df = spark.range(4000).select("id", (F.col("id") % 60).alias("n"))
    draw = lambda d: sorted(map(tuple, d.select("id", noise.thinned(F.col("n"), F.xxhash64("id"), 0.25, 5).alias("k")).collect()))
    first = draw(df.repartition(1))
    assert first == draw(df.repartition(7))
    kept, total = sum(k for _, k in first), sum(i % 60 for i in range(4000))
    assert all(0 <= k <= i % 60 for i, k in first) and abs(kept / total - 0.25) < 4 * math.sqrt(0.25 * 0.75 / total)
    counts = np.array([noise.EVENTS + 5, 0, -3, 7])
    out = noise.kept_events(counts, np.arange(4), 0.5, 1)
    assert abs(out[0] - counts[0] / 2) < 5 * math.sqrt(counts[0]) and out[1:3].tolist() == [0, 0] and 0 <= out[3] <= 7
    nulls = spark.createDataFrame([(1, None), (None, 3)], "id long, n long").select(noise.thinned(F.col("n"), F.col("id"), 0.5, 1).alias("k")).collect()
    assert [r["k"] for r in nulls] == [None, None]


def test_small_boxes_are_finished_together(spark):
    """Boxes of one shape reach finish as one stack; one call and one batch a box made small bricks slow."""
    cut = bricks.split(table(spark, [(4, 4, 4)] * 200), (2, 2, 2))
    calls = spark.sparkContext.accumulator(0)

    def finish(boxes, row):
        calls.add(1)
        yield {}, boxes

    wanted = bricks.about(cut).withColumns({"low": bricks.begin_of(), "high": F.transform(bricks.begin_of(), lambda b: b + 2)})
    same(bricks.join(bricks.gather(cut, wanted, finish).drop("low", "high")), bricks.join(cut))
    assert 0 < calls.value <= 400  # of 1600 boxes
