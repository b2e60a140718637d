"""Closed forms and properties of the volume operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import geometry, kernels
from lumenframe.operators import curves, dose, masks, noise, spatial, uptake, volumes


def image(spark, data, spacing=(1, 1, 1)):
    data = np.asarray(data, np.float32)
    row = (1, [int(n) for n in data.shape], data.transpose(2, 1, 0).reshape(-1).tolist(), [0.0] * 3, [float(s) for s in spacing], list(volumes.IDENTITY))
    return spark.createDataFrame([row], "image_id long, dims array<int>, voxels array<float>, origin array<double>, spacing array<double>, direction array<double>")


def cube(df):
    row = df.first()
    nx, ny, nz = row["dims"]
    return np.array(row["voxels"]).reshape(nz, ny, nx).transpose(2, 1, 0)


def test_rotation_keeps_a_voxel_on_the_axis(spark):
    a = np.zeros((7, 7, 7))
    a[4, 4, 3] = 1
    c = volumes.doubles((5, 5, 4))
    turned = cube(spatial.affine(image(spark, a), geometry.homogeneous(geometry.rotation(3, 90)), centre=c, mode="nearest"))
    assert turned[4, 4, 3] == 1 and turned.sum() == 1


def test_scaling_about_a_corner(spark):
    a = np.zeros((8, 8, 8))
    a[1, 1, 1] = 1
    big = cube(spatial.affine(image(spark, a), geometry.affine_matrix(scale=(2, 2, 2)), centre=volumes.doubles((1, 1, 1)), mode="nearest"))
    assert big[2, 2, 2] == 1


def test_chain_is_one_matrix():
    a, b = geometry.affine_matrix(rotate=(10, 20, 30)), geometry.affine_matrix(translation=(1, 2, 3), scale=(1, 2, 1))
    p = np.array([1.0, 2.0, 3.0, 1.0])
    assert np.allclose(geometry.compose(a, b) @ p, b @ (a @ p))


def test_orientations_in_turn_move_voxels_once(spark):
    """Going through one orientation to another is one pass of Python, with the results of two; mixed shapes, a null and NaN go through."""
    rng = np.random.default_rng(3)
    df = image(spark, rng.random((2, 3, 4)), (1, 2, 3)).union(image(spark, rng.random((4, 3, 2)), (2, 1, 1))).union(image(spark, np.full((2, 3, 4), np.nan)))
    df = df.union(df.withColumn("voxels", F.lit(None).cast("array<float>"))).withColumn("origin", volumes.doubles((5, -7, 11)))
    code = lambda name: F.explode(F.array(*map(F.lit, geometry.CODES))).alias(name)
    df = df.select("*", code("source")).select("*", code("target"))
    once = spatial.reorient(df, F.col("source"), F.col("target"))
    twice = spatial.reorient(spatial.reorient(df, F.col("source")), F.col("target"))
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_pad_then_crop_is_identity(spark):
    a = np.random.default_rng(1).random((3, 4, 2))
    padded = spatial.pad(image(spark, a), (1, 0, 2), (0, 3, 1), -1)
    back = spatial.crop(padded, (1, 0, 2), (3, 4, 2))
    assert np.allclose(cube(back), a) and back.first()["origin"] == [0, 0, 0]


@pytest.mark.parametrize("code", geometry.CODES)
def test_reorienting_back_is_identity(spark, code):
    a = np.random.default_rng(2).random((2, 3, 4))
    there = spatial.reorient(image(spark, a), code)
    assert np.allclose(cube(spatial.reorient(there, "LPS")), a)
    assert geometry.code_of(there.first()["direction"]) == code


def test_singular_matrices_are_errors(spark):
    with pytest.raises(ValueError):
        spatial.affine(image(spark, np.zeros((2, 2, 2))), np.zeros((4, 4)))
    with pytest.raises(ValueError):
        geometry.index_to_physical((0, 1, 1), volumes.IDENTITY)


@given(st.integers(1, 5), st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6), st.sampled_from(["linear", "nearest", "round_first"]))
def test_push_is_the_transpose_of_pull(nx, ny, nz, seed, mode):
    rng = np.random.default_rng(seed)
    matrix = geometry.affine_matrix(tuple(rng.uniform(-1, 1, 3)), (0, 0, float(rng.uniform(0, 90))), tuple(rng.uniform(0.5, 1.5, 3)))
    x, y = rng.standard_normal((1, nx * ny * nz)), rng.standard_normal((1, 24))
    forward = kernels.pull(x, matrix, np.ones(3), (4, 3, 2), (nx, ny, nz), np.zeros(1), mode)
    assert math.isclose(float((forward * y).sum()), float((x * kernels.push(y, matrix, np.ones(3), (4, 3, 2), (nx, ny, nz), mode)).sum()), abs_tol=1e-9)


def test_cubic_spline_passes_through_voxels():
    v = np.random.default_rng(3).random((1, 60))
    assert np.allclose(kernels.pull(v, np.eye(4), np.zeros(3), (3, 4, 5), (3, 4, 5), np.zeros(1), "cubic"), v)


def test_uptake_factor_cases(spark):
    rows = [("75", "3.7e8", "6586.2", "100000.00", "110000.00", 3600.0), ("75", "3.7e8", "6586.2", "230000.00", "010000.00", 7200.0), ("70", "370e6", "6586.2", "110000.000000", "120000.500000", 3600.5), (None, "1", "1", "10", "11", None), ("70", "x", "1", "10", "11", None)]
    df = spark.createDataFrame(rows, "w string, d string, h string, a string, b string, dt double")
    got = df.select(uptake.suv_factor(*map(F.col, "wdhab")).alias("f"), "w", "d", "h", "dt").collect()
    for r in got:
        if r["dt"] is None:
            assert r["f"] is None
        else:
            assert math.isclose(r["f"], float(r["w"]) * 1000 / (float(r["d"]) * 2 ** (-r["dt"] / float(r["h"]))), rel_tol=1e-12)


def test_mask_reductions(spark):
    a = np.zeros((6, 6, 6))
    a[2, 2, 2] = a[3, 3, 3] = 1
    c = masks.barycenter(image(spark, a)).first()
    assert c[1:4] == (3.5, 3.5, 3.5) and math.isclose(c["radius"], math.sqrt(0.75))
    assert [tuple(r)[1:] for r in masks.mask_points(image(spark, a), 3).orderBy("k").collect()] == [(1, 3, 3, 3), (2, 4, 4, 4), (3, -1, -1, -1)]
    assert masks.barycenter(image(spark, np.zeros((2, 2, 2)))).first()[1:] == (0, 0, 0, 0)


def test_masks_of_another_shape_are_errors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0])], "image_id long, v array<float>, m array<float>")
    with pytest.raises(Exception, match="differ in shape"):
        masks.masked_stats(df, "v", "m", F.lit(1.0)).collect()


def test_axes_match_for_all_permutations_and_reversals(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    flat = lambda v: v.transpose(2, 1, 0).reshape(-1).tolist()
    rows, want = [], {}
    for perm in itertools.permutations(range(3)):
        for rev in itertools.product((0, 1), repeat=3):
            b = np.flip(a.transpose(perm), [i for i in range(3) if rev[i]])
            want[len(rows)] = ("".join(map(str, perm)), "".join(map(str, rev)))
            rows.append((len(rows), flat(a), flat(b)))
    want[len(rows)] = (None, None)
    rows.append((len(rows), flat(a), flat(a)[1:] + [0.0]))
    found = spatial.match_axes(spark.createDataFrame(rows, "image_id long, a array<double>, b array<double>"), a.shape)
    assert {r["image_id"]: (r["permuted"], r["reversed"]) for r in found.collect()} == want


def plain_pull(volume, matrix, out_dims, fill, mode):
    """Voxel by voxel: a trilinear or nearest sample at matrix * p."""
    out = np.full(out_dims, fill)
    n = np.array(volume.shape)
    for p in np.ndindex(*out_dims):
        q = (matrix @ np.array([*(np.array(p) + 1), 1.0]))[:3].astype(np.float32).astype(float)
        r = np.rint(q)
        if mode == "round_first":
            if (r >= 1).all() and (r <= n).all():
                out[p] = volume[tuple(r.astype(int) - 1)]
            continue
        if not ((q >= 1).all() and (q <= n).all()):
            continue
        if mode == "nearest":
            out[p] = volume[tuple(r.astype(int) - 1)]
            continue
        low = np.floor(q).astype(int)
        out[p] = sum(volume[tuple(np.minimum(low + c, n) - 1)] * np.prod(np.where(c, q - low, 1 - (q - low))) for c in map(np.array, itertools.product((0, 1), repeat=3)))
    return out


@pytest.mark.parametrize("mode", ["linear", "nearest", "round_first"])
def test_sampling_by_axes_and_by_slabs_is_that_of_a_plain_loop(monkeypatch, mode):
    monkeypatch.setattr(kernels, "SLAB", 40)  # several slabs
    rng = np.random.default_rng(4)
    v = rng.random((5, 4, 6))
    flat = v.transpose(2, 1, 0).reshape(1, -1)
    for matrix in (geometry.affine_matrix((0.3, -0.4, 0.2), scale=(0.7, 1.1, 0.9)), geometry.affine_matrix((0.5, 1, -1), (20, 10, 30), (0.8, 1, 1.2)), geometry.affine_matrix((0.5, 1, 0), (0, 0, 30)), geometry.affine_matrix((0.5, 1, 0.3), (0, 0, 30), (1, 1, 0.8))):
        got = kernels.pull(flat, matrix, np.zeros(3), (6, 5, 7), (5, 4, 6), np.array([9.0]), mode)
        assert np.allclose(got.reshape(7, 5, 6).transpose(2, 1, 0), plain_pull(v, matrix, (6, 5, 7), 9.0, mode))


def test_resampling_between_oblique_grids(spark):
    """Both matrices in full: a fixed grid turned in space onto a moving one with another direction and spacing."""
    rng = np.random.default_rng(5)
    v = rng.random((4, 5, 3))
    turn = geometry.rotation(3, 25) @ geometry.rotation(1, 10)
    fixed = ([1.0, 0.5, 0.2], [0.8, 1.0, 0.7], turn.reshape(-1).tolist())
    moving = ([0.0, -0.5, 0.1], [1.0, 0.9, 1.1], geometry.rotation(2, 15).reshape(-1).tolist())
    grid = lambda a, g: ([int(n) for n in a.shape], a.transpose(2, 1, 0).reshape(-1).tolist(), *g)
    kind = "struct<dims: array<int>, voxels: array<double>, origin: array<double>, spacing: array<double>, direction: array<double>>"
    df = spark.createDataFrame([(grid(np.zeros((3, 3, 4)), fixed), grid(v, moving))], f"fixed {kind}, moving {kind}")
    got = np.array(spatial.resample_to_image(df, fill=F.lit(7.0), kind="double").first()["resampled"]).reshape(4, 3, 3).transpose(2, 1, 0)
    place = lambda g: (np.array(g[2]).reshape(3, 3) * np.array(g[1]), np.array(g[0]))
    (mf, of), (mm, om) = place(fixed), place(moving)
    back = np.eye(4)
    back[:3, :3] = np.linalg.inv(mm) @ mf
    back[:3, 3] = np.linalg.inv(mm) @ (of - om) - back[:3, :3] @ np.ones(3) + 1
    assert np.allclose(got, plain_pull(v, back, (3, 3, 4), 7.0, "linear"))


def test_matrix_gradient_is_the_difference_quotient(spark):
    rng = np.random.default_rng(6)
    v, g = rng.random((4, 5, 3)), rng.random(60)
    flat, m, c = v.transpose(2, 1, 0).reshape(1, -1), geometry.affine_matrix((0.13, 0.07, -0.21), (5, 3, 8)), np.array([2.0, 2.5, 1.5])
    at = kernels.affine_points(m, (4, 5, 3), c)
    g[(np.abs(at - np.rint(at)) < 0.02).any(1)] = 0  # no sample crosses from one cell to another
    loss = lambda k: float((kernels.pull(flat, k, c, (4, 5, 3), (4, 5, 3), np.zeros(1), "linear")[0] * g).sum())
    got = kernels.matrix_gradient(flat[0], g, m, (4, 5, 3), c)
    found = spatial.matrix_gradient(image(spark, v).withColumn("g", F.array(*map(F.lit, g.tolist()))), "g", m, c).first()["d_matrix"]
    assert np.allclose(found, got, atol=1e-5)
    for k in range(12):
        step = np.zeros((4, 4))
        step[k // 4, k % 4] = 1e-3
        assert abs((loss(m + step) - loss(m - step)) / 2e-3 - got[k]) < 0.01 * max(1, abs(got[k]))


def test_endpoints_of_a_line(spark):
    a = np.zeros((9, 9, 9))
    a[2:8, 4, 5] = 1
    assert masks.endpoints(image(spark, a)).first()[1:] == (2, 4, 5, 7, 4, 5)
    a = np.zeros((9, 9, 9))
    for k in range(1, 7):
        a[k, k, 2] = 1
    assert masks.endpoints(image(spark, a)).first()[1:] == (1, 1, 2, 6, 6, 2)
    assert masks.endpoints(image(spark, np.zeros((3, 3, 3)))).first()[1:] == (16,) * 6


def test_endpoints_of_two_axes_of_one_length():
    """Voxels whose two longest axes are equal; the ends are those of the SQL of endpoints_wide, which a decomposition missed."""
    for hot, ends in (
        ((5, 20, 25, 28, 29, 30, 37, 38, 39, 41, 42, 48, 56, 58, 60, 62), (0, 3, 1, 3, 1, 2)),
        ((1, 2, 10, 13, 16, 17, 19, 20, 21, 23, 26, 28, 29, 33, 34, 36, 37, 43, 49, 53, 54, 56, 57, 59), (2, 2, 0, 0, 2, 3)),
        ((5, 7, 9, 23, 24, 26, 34, 37, 39, 44, 46, 52, 53, 55, 62, 63), (0, 3, 2, 3, 1, 3)),
    ):
        volume = np.zeros(64)
        volume[list(hot)] = 1
        assert tuple(kernels.endpoints(volume.reshape(4, 4, 4), 0.5)) == ends


def test_distance_is_that_of_all_pairs():
    rng = np.random.default_rng(7)
    mask = rng.random((6, 5, 4)) > 0.93
    at, hot = np.argwhere(np.ones(mask.shape)), np.argwhere(mask)
    want = np.sqrt(((at[:, None] - hot) ** 2).sum(2).min(1)).reshape(mask.shape)
    assert np.allclose(kernels.distance_to(mask), want) and (kernels.distance_to(np.zeros((2, 2, 2), bool)) == 100).all()


def test_errors_and_divisions_by_zero(spark):
    with pytest.raises(Exception, match="300"):
        spark.range(1).select(dose.without_contrast(F.lit(990.0))).collect()
    assert spark.range(1).select(uptake.suv_factor(F.lit("70"), F.lit("1"), F.lit("0"), F.lit("10"), F.lit("11")).alias("f")).first()["f"] is None
    flat = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, -1.0), (2, 1.0, -2.0)], "curve int, t double, a double")
    assert {r["entropy"] for r in curves.features(curves.clean(flat)).collect()} == {None}
    assert dose.agreement(spark.createDataFrame([(1, 1.0, 0.0)], "g int, a double, b double"), "a", "b", ["g"]).first()["ratio"] is None
    with pytest.raises(Exception, match="oblique"):
        spatial.reorient(image(spark, np.zeros((2, 2, 2))).withColumn("direction", volumes.doubles((0.6, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1))), "RAS").collect()


def test_medians_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 5001), rng.integers(0, 40, 5001) ** 2.0)] + [(9, 1.0), (9, 4.0), (8, 5.0)]
    got = dict(curves.medians(spark.createDataFrame(rows, "g int, v double"), F.col("v"), ["g"]).collect())
    assert got == {k: float(np.median([v for g, v in rows if g == k])) for k in {g for g, _ in rows}}


def test_noise_has_the_stated_moments(spark):
    n = 40_000
    df = spark.range(n).select(noise.lognormal(F.lit(2.0), F.col("id"), 0.3, 11).alias("x"), noise.thinned(F.lit(20), F.col("id"), 0.25, 5).alias("k"))
    r = df.agg(F.avg("x"), F.stddev("x"), F.avg("k"), F.variance("k"), F.max("k")).first()
    assert abs(r[0] - 2) < 0.02 and abs(r[1] - 2 * math.sqrt(math.exp(0.09) - 1)) < 0.02 and abs(r[2] - 5) < 0.05 and abs(r[3] - 3.75) < 0.15 and r[4] <= 20
    assert df.agg(F.sum("k")).first()[0] == df.repartition(7).agg(F.sum("k")).first()[0]
    assert spark.range(1).select(noise.lognormal(F.lit(None).cast("double"), F.col("id"), 0.3, 1).alias("x")).first()["x"] is None


def test_spline_resampling_is_that_of_a_dense_solve(spark):
    """Along one axis: coefficients of a cubic B-spline with vanishing curvature at the ends, evaluated directly."""
    v = np.random.default_rng(9).random(7)
    a = np.zeros((9, 9))
    for i in range(7):
        a[i, i : i + 3] = 1 / 6, 4 / 6, 1 / 6
    a[7, :3], a[8, -3:] = (1, -2, 1), (1, -2, 1)
    c = np.linalg.solve(a, np.concatenate([v, [0, 0]]))
    at = np.arange(14) * 0.5
    want = []
    for x in at[at <= 6]:
        want.append(sum(c[k] * max(0, (2 - abs(x - k + 1)) ** 3 / 6 - (4 * (1 - abs(x - k + 1)) ** 3 / 6 if abs(x - k + 1) < 1 else 0) if abs(x - k + 1) < 2 else 0) for k in range(9)))
    got = cube(spatial.resample_to_spacing(image(spark, v.reshape(7, 1, 1)), (0.5, 1, 1), "cubic", "double"))[: len(want), 0, 0]
    assert np.allclose(got, want, atol=1e-6)


def test_brackets_of_few_groups_go_to_the_rows(spark):
    """Neither a shuffle nor a sort of all rows of a group; before, a task sorted all rows of its groups."""
    df = spark.range(1001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("y"), (F.col("id") * 2).cast("double").alias("p"))
    got = curves.regression_metrics(df, "y", "p", ["g"])
    assert dict(map(tuple, got.select("g", "medae").collect())) == {0: 500.0, 1: 500.0}
    assert "rightHint=(strategy=broadcast)" in got._jdf.queryExecution().logical().toString() or "ResolvedHint (strategy=broadcast)" in got._jdf.queryExecution().analyzed().toString()
