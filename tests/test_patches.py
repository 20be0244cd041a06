import numpy as np
import pytest
from pyspark.sql import functions as F
from voxlake.functions import values as V
from voxlake.operators import scan, spatial


def volume(spark, shape, values=None):
    data = np.arange(np.prod(shape), dtype=float).reshape(shape) if values is None else values
    return spark.createDataFrame([(0, *map(int, i), float(data[i])) for i in np.ndindex(*shape)], "volume_id int, z int, y int, x int, v double"), data


def cells(spark, data):
    return spark.createDataFrame([(0, *map(int, i), float(data[i])) for i in np.ndindex(*data.shape)], "k int, dz int, dy int, dx int, v double")


def back(df, shape):
    out = np.full(shape, np.nan)
    rows = df.collect()
    assert len(rows) == np.prod(shape)
    for r in rows:
        out[r["dz"], r["dy"], r["dx"]] = r["v"]
    return out


@pytest.mark.parametrize("start", [(0, 0, 0), (-1, 2, 3), (3, 3, 3), (9, 0, 0)])
def test_both_reads_agree(spark, start):
    vox, data = volume(spark, (4, 5, 6))
    req = spark.createDataFrame([(0, 7, *start, 4, 5, 6)], "volume_id int, patch_id int, z0 int, y0 int, x0 int, nz int, ny int, nx int")
    want = np.full((3, 3, 3), np.nan)
    for i in np.ndindex(3, 3, 3):
        at = tuple(a + b for a, b in zip(i, start, strict=True))
        if all(0 <= a < n for a, n in zip(at, data.shape, strict=True)):
            want[i] = data[at]
    np.testing.assert_array_equal(back(scan.read_voxels(req, vox, (3, 3, 3)), (3, 3, 3)), want)
    got = scan.read_chunks(req, scan.chunked(vox, (2, 3, 4)), (3, 3, 3), (2, 3, 4)).first()["data"]
    np.testing.assert_array_equal(np.array(got).reshape(3, 3, 3), want)


def test_small_crop_in_large_patch(spark):
    vox, _ = volume(spark, (10, 10, 10))
    req = spark.createDataFrame([(0, 0, -20, -20, -20)], "volume_id int, patch_id int, z0 int, y0 int, x0 int")
    read = scan.read_voxels(req, vox, (50, 50, 50))
    assert read.where(~F.isnan("v")).count() == 1000


def test_resampling_forms_agree(spark):
    data = np.random.default_rng(0).normal(size=(4, 3, 5))
    for out in ((2, 6, 5), (7, 1, 3)):
        near = back(spatial.resample_nearest(cells(spark, data), ["k"], data.shape, out), out)
        np.testing.assert_allclose(near, spatial.resample_patch(data, out, "nearest"))
        line = back(spatial.resample_linear(cells(spark, data), ["k"], data.shape, out), out)
        np.testing.assert_allclose(line, spatial.resample_patch(data, out, "linear"))


def test_mirror_twice_and_transpose(spark):
    data = np.arange(24.0).reshape(2, 3, 4)
    c = cells(spark, data)
    flip = lambda d: spatial.mirror(d, data.shape, {"z": True, "x": True})
    np.testing.assert_array_equal(back(flip(c), data.shape), data[::-1, :, ::-1])
    np.testing.assert_array_equal(back(flip(flip(c)), data.shape), data)
    np.testing.assert_array_equal(back(spatial.transpose(c, (2, 0, 1)), (4, 2, 3)), data.transpose(2, 0, 1))


def test_enforce_shape(spark):
    data = np.arange(60.0).reshape(3, 4, 5)
    got = back(spatial.enforce_shape(cells(spark, data), ["k"], data.shape, (6, 2, 5)), (6, 2, 5))
    want = np.full((6, 2, 5), np.nan)
    want[1:4] = data[:, 1:3]
    np.testing.assert_array_equal(got, want)


def test_rotation():
    assert spatial.rotation_matrix({"z": 360.0}) is None
    m = spatial.rotation_matrix({"z": 90.0})
    data = np.random.default_rng(1).normal(size=(3, 5, 5)).astype(np.float32)
    np.testing.assert_allclose(spatial.rotate(data, m, convention="world"), np.rot90(data, 1, (1, 2)))
    np.testing.assert_allclose(spatial.rotate(data, m, "linear", convention="world"), spatial.rotate(data, m, "nearest", convention="world"), atol=1e-5)
    turned = spatial.rotate(data, spatial.rotation_matrix({"z": 45.0}), convention="world")
    assert np.isnan(turned).any() and turned.shape == data.shape
    assert not np.isnan(spatial.rotate(data, spatial.rotation_matrix({"z": 45.0}), pad_value=0.0, convention="world")).any()


def test_blur(spark):
    data = np.random.default_rng(2).normal(size=(2, 4, 3))
    kernel = V.gaussian_kernel(3, 0.8, 3)
    want = np.zeros_like(data)
    for i in np.ndindex(*data.shape):
        for c, w in kernel:
            want[i] += w * data[tuple(min(max(a + b, 0), n - 1) for a, b, n in zip(i, c, data.shape, strict=True))]
    np.testing.assert_allclose(back(spatial.blur(cells(spark, data), ["k"], data.shape, kernel), data.shape), want)
    flat = np.full((2, 4, 3), 5.0)
    np.testing.assert_allclose(back(spatial.blur(cells(spark, flat), ["k"], flat.shape, V.gaussian_kernel(3, 0.5, 2)), flat.shape), flat)
    with pytest.raises(ValueError):
        V.gaussian_kernel(4)


def test_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([([-1.0, 0.0, 0.5, 1.0, nan, inf, -inf],)], "d array<double>")
    got = rows.select(V.each(V.binarize())(F.col("d")).alias("b"), V.each(V.nan_to_num())(F.col("d")).alias("n"), V.each(lambda v: V.gamma(v, F.lit(2.0)))(F.col("d")).alias("g")).first()
    assert got["b"][:4] == [0.0, 0.0, 1.0, 1.0] and np.isnan(got["b"][4])
    assert got["n"][4:] == [0.0, V.FLOAT_MAX, -V.FLOAT_MAX]
    assert got["g"][:5] == [1.0, 0.0, 0.25, 1.0, 0.0]
