"""Stored volumes: any rank, staged writes, pruned scans, patches in one pass, catalogues and kept counts."""

import glob
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from voxlake.api import Dataset, DatasetWriter, Image, Loader, MultiDataset, Spec, Split, Writer, foregrounds
from voxlake.functions import rng
from voxlake.functions import values as V
from voxlake.operators import catalog, patches, sampling, spatial, stats
from voxlake.sources import ngff

SPEC = Spec((4, 4, 4), (8, 8, 8))


def rows_of(data, chunks):
    """The chunks of an array as rows of the source."""
    grid = [-(-n // c) for n, c in zip(data.shape, chunks, strict=True)]
    for at in np.ndindex(*grid):
        part = data[tuple(slice(i * c, i * c + c) for i, c in zip(at, chunks, strict=True))]
        start = ngff.spatial([i * c for i, c in zip(at, chunks, strict=True)], 0)
        yield ("v", "s0", *ngff.spatial(list(at), 0), *start, list(part.shape), part.ravel().tolist(), list(at[:-3]))


def write(spark, path, data, chunks, mode="overwrite", **options):
    ngff.register(spark)
    text = lambda x: ",".join(map(str, x))
    rows = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows_of(np.asarray(data, np.float32), chunks)], ngff.SCHEMA)
    rows.repartition(3).write.format("ngff").mode(mode).options(path=path, shape=text(data.shape), chunks=text(chunks), **{"voxel_size": "8,8,8"} | options).save()


def read(spark, path, level="s0"):
    """The whole array from its chunk rows."""
    ngff.register(spark)
    shape = json.load(open(f"{path}/{level}/.zarray"))["shape"]
    chunks = json.load(open(f"{path}/{level}/.zarray"))["chunks"]
    out = np.full(shape, np.nan, np.float32)
    for r in spark.read.format("ngff").options(path=path).load().collect():
        at = [*r["lead"], r["cz"], r["cy"], r["cx"]][-len(shape) :]
        out[tuple(slice(i * c, i * c + n) for i, c, n in zip(at, chunks, r["shape"], strict=True))] = np.reshape(r["data"], r["shape"])
    return out


@pytest.mark.parametrize("shape, chunks", [((7,), (3,)), ((4, 4), (4, 4)), ((5, 7), (2, 3)), ((5, 4, 3), (2, 4, 2)), ((2, 3, 4, 5), (1, 2, 3, 5)), ((2, 3, 2, 3, 4), (2, 2, 2, 2, 2))])
def test_volumes_of_any_rank_come_back(spark, tmp_path, shape, chunks):
    data = np.random.default_rng(len(shape)).normal(size=shape).astype(np.float32)
    path = f"{tmp_path}/a.zarr/v"
    write(spark, path, data, chunks)
    np.testing.assert_array_equal(read(spark, path), data)
    assert os.path.exists(f"{path}/s0/" + ".".join(["0"] * len(shape))) and not glob.glob(f"{path}/.staging*")
    axes = json.load(open(f"{path}/.zattrs"))["multiscales"][0]["axes"]
    assert len(axes) == len(shape) and [a["name"] for a in axes if a["type"] == "space"] == list("zyx"[-len(shape) :])


def test_append_leaves_the_rest(spark, tmp_path):
    data, path = np.arange(36, dtype=np.float32).reshape(6, 6), f"{tmp_path}/a.zarr"
    write(spark, path, data, (4, 4))
    more = spark.createDataFrame([("v", "s0", 0, 1, 1, 0, 4, 4, [1, 2], [-1.0, -2.0], [])], ngff.SCHEMA)
    how = {"path": path, "shape": "6,6", "chunks": "4,4"}
    more.write.format("ngff").mode("append").options(**how).save()
    want = data.copy()
    want[4, 4:6] = -1, -2
    np.testing.assert_array_equal(read(spark, path), want)
    with pytest.raises(Exception, match="overwrite it"):
        more.write.format("ngff").mode("append").options(**how | {"chunks": "3,3"}).save()


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_a_failed_write_leaves_the_old_volume(spark, tmp_path, mode):
    data, path = np.arange(64, dtype=np.float32).reshape(8, 8), f"{tmp_path}/a.zarr"
    write(spark, path, data, (4, 4))
    bad = spark.createDataFrame([("v", "s0", 0, y, 0, 0, 0, 0, [4, 4] if y == 0 else [5, 5], [9.0] * (16 if y == 0 else 25), []) for y in (0, 1)], ngff.SCHEMA)
    with pytest.raises(Exception, match="larger than a chunk"):
        bad.repartition(1).write.format("ngff").mode(mode).options(path=path, shape="8,8", chunks="4,4").save()
    np.testing.assert_array_equal(read(spark, path), data)
    assert not glob.glob(f"{path}/.staging*")


def by_place(rows, *keys):
    return {tuple(r[k] for k in (*keys, "dz", "dy", "dx")): r["v"] for r in rows.collect()}


def test_leading_axes_are_taken_whole(spark, tmp_path):
    data, path = np.random.default_rng(2).normal(size=(3, 6, 7, 8)).astype(np.float32), f"{tmp_path}/a.zarr"
    write(spark, path, data, (2, 3, 4, 8))
    image = Image.open(spark, path, SPEC, pad=True)
    assert image.shape == (6, 7, 8) and image.voxel_size == {"z": 8.0, "y": 8.0, "x": 8.0}
    got = by_place(image.read([{"z": 24.0, "y": 28.0, "x": 32.0}]), "channel")
    assert len(got) == 3 * 64
    for (c, z, y, x), v in got.items():
        assert v == data[c, z + 1, y + 1, x + 2]
    coarse = Image.open(spark, path, Spec((2, 2, 2), (16, 16, 16)), pad=True, interpolation="linear")
    got = by_place(coarse.read([{"z": 24.0, "y": 24.0, "x": 32.0}], mirror={"x": True}), "channel")
    want = data[:, 1:5, 1:5, 2:6].reshape(3, 2, 2, 2, 2, 2, 2).mean((2, 4, 6))[..., ::-1]
    np.testing.assert_allclose([got[k] for k in sorted(got)], want.ravel(), rtol=1e-5)


def test_flat_volumes_are_read_as_a_slice(spark, tmp_path):
    data, path = np.arange(42, dtype=np.float32).reshape(6, 7), f"{tmp_path}/a.zarr"
    write(spark, path, data, (4, 3), voxel_size="8,8")
    image = Image.open(spark, path, Spec((2, 3), (8, 8)), pad=True)
    got = by_place(image.read([{"z": 4.0, "y": 16.0, "x": 28.0}, {"z": 4.0, "y": 0.0, "x": 28.0}]), "idx")
    assert {k[1] for k in got} == {0} and [got[0, 0, y, x] for y in range(2) for x in range(3)] == data[1:3, 2:5].ravel().tolist()
    assert np.isnan(got[1, 0, 0, 0]) and got[1, 0, 1, 0] == data[0, 2]
    assert image.rows.count() == 42 and image.foreground() == 41


def test_windows_at_an_edge_with_and_without_padding(spark, tmp_path):
    data, path = np.arange(8, dtype=np.float32).reshape(8, 1, 1), f"{tmp_path}/a.zarr"
    write(spark, path, data, (3, 1, 1))
    line = lambda **o: [v for _, v in sorted(by_place(Image.open(spark, path, Spec((4, 1, 1), (8, 8, 8)), **o).read([{"z": 0.0, "y": 4.0, "x": 4.0}])).items())]
    np.testing.assert_array_equal(line(pad=True), [np.nan, np.nan, 0, 1])
    np.testing.assert_array_equal(line(), [np.nan, 0, 1, np.nan])  # two voxels are there; they are put in the middle
    np.testing.assert_array_equal(line(pad_value=-5.0), [-5, 0, 1, -5])
    half = lambda **o: [v for _, v in sorted(by_place(Image.open(spark, path, Spec((4, 1, 1), (4, 8, 8)), **o).read([{"z": 0.0, "y": 4.0, "x": 4.0}])).items())]
    np.testing.assert_array_equal(half(pad=True), [np.nan, np.nan, 0, 0])
    np.testing.assert_array_equal(half(), [0, 0, 0, 0])  # the one voxel that is there is resampled to the output
    gone = [v for _, v in by_place(Image.open(spark, path, Spec((4, 1, 1), (4, 8, 8))).read([{"z": 900.0, "y": 4.0, "x": 4.0}])).items()]
    assert len(gone) == 4 and np.isnan(gone).all()


def test_filters_reach_the_files(spark, tmp_path):
    data, path = np.random.default_rng(0).normal(size=(6, 6, 6)).astype(np.float32), f"{tmp_path}/a.zarr"
    write(spark, path, data, (2, 3, 6))
    for name in os.listdir(f"{path}/s0"):
        if not name.startswith(("1.", ".")):
            with open(f"{path}/s0/{name}", "wb") as f:
                f.write(b"no chunk")  # opening it fails
    chunks = spark.read.format("ngff").options(path=path).load()
    for where, n in (("cz = 1", 2), ("cz > 0 and cz <= 1 and cy in (1, 7)", 1), ("cz = 1 and cy < 1 and level = 's0' and size(data) > 3", 1), ("cz = 9", 0), ("level = 's1'", 0)):
        assert chunks.where(where).count() == n
    with pytest.raises(Exception, match="(?s)cannot reshape|buffer size"):
        chunks.where("cz = 0").collect()
    reader = ngff.NgffReader({"path": path})
    left = list(reader.pushFilters([D.GreaterThanOrEqual(("cy",), 1), D.IsNotNull(("cy",)), D.EqualTo(("z0",), 2)]))
    assert [f.attribute for f in left] == [("z0",)] and sum(p.last - p.first for p in reader.partitions()) == 3


def test_a_task_opens_a_chunk_once(tmp_path, spark):
    path = f"{tmp_path}/a.zarr"
    write(spark, path, np.arange(512, dtype=np.float32).reshape(8, 8, 8), (4, 4, 4))
    meta, how = json.load(open(f"{path}/s0/.zarray")), {"out": [2, 2, 2], "fill": 0.0, "pad": True}
    stored = patches.Stored()
    for z in range(7):
        assert stored.window(f"{path}/s0", meta, how, [z, 0, 0], [2, 2, 2])[0, 0, 0] == 64 * z
    assert stored.opened == 2
    small = patches.Stored(1)
    for _ in range(2):
        small.window(f"{path}/s0", meta, how, [3, 3, 3], [2, 2, 2])
    assert small.opened == 16 and len(small.held) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def datasets(spark, tmp_path, n, open_all=True):
    data = (np.arange(216) % 5 == 0).reshape(6, 6, 6)
    paths = [f"{tmp_path}/d{i}.zarr" for i in range(n)]
    for i, path in enumerate(paths[: min(n, 2)]):
        write(spark, path, data * (i + 1.0), (4, 6, 6))
    for path in paths[2:]:
        os.symlink(paths[0], path)
    images = Image.open_all(spark, [(p, SPEC) for p in paths for _ in "ab"])
    return [Dataset({"raw": images[2 * i]}, {"a": images[2 * i + 1], "b": None}, SPEC) for i in range(n)]


def jobs(spark, run):
    group = f"g{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_many_datasets_are_one_plan_and_one_job(spark, tmp_path):
    (few, n_few), (many, n_many) = (jobs(spark, lambda n=n: datasets(spark, tmp_path / str(n), n)) for n in (2, 12))
    assert n_few == n_many
    of = lambda d: Loader(MultiDataset(d), 4, shuffle=True, seed=3).epoch_patches()
    lines = [len(plan(of(d)).splitlines()) for d in (few, many)]
    assert lines[0] == lines[1] and "CartesianProduct" not in plan(of(many))
    rows = of(many).select("pos", "dataset", "idx", "source", F.size("data").alias("n")).collect()
    assert len(rows) == 3 * 12 * 8 and {r["n"] for r in rows} == {64} and {(r["dataset"], r["idx"]) for r in rows} == {(d, i) for d in range(12) for i in range(8)}
    (a, n_a), (b, n_b) = (jobs(spark, lambda d=d: MultiDataset(d).class_counts) for d in (few, many))
    assert (a, b) == ({"a": 88, "b": 0}, {"a": 528, "b": 0}) and n_a == n_b
    part = next(iter(Loader(MultiDataset(many), 5, [0, 95, 40])))
    assert {(r["pos"], r["dataset"], r["idx"]) for r in part.select("pos", "dataset", "idx").distinct().collect()} == {(0, 0, 0), (1, 11, 7), (2, 5, 0)}


def test_transforms_are_drawn_once_for_a_sample(spark, tmp_path):
    data = MultiDataset(datasets(spark, tmp_path, 1))
    turns = {"mirror": {"x": 0.5, "z": 0.5}, "transpose": True}
    loader = Loader(data, 4, shuffle=True, turns=turns, seed=5)
    got = {(r["idx"], r["source"]): np.reshape(r["data"], r["shape"]) for r in loader.epoch_patches().collect()}
    plain = {(r["idx"], r["source"]): np.reshape(r["data"], r["shape"]) for r in Loader(data, 4).epoch_patches().collect()}
    order = loader.order(spark)
    drawn = {r["index"]: r["t"] for r in spatial.drawn(order, "pos", turns, 5, 0).withColumn("t", spatial.turn_of(spatial.drawn(order, "pos", turns, 5, 0))).collect()}
    for i in range(8):
        want = plain[i, "raw"]
        want = want[tuple(slice(None, None, -1) if f else slice(None) for f in drawn[i]["mirror"])].transpose(drawn[i]["perm"])
        np.testing.assert_array_equal(got[i, "raw"], want)
        np.testing.assert_array_equal(got[i, "a"], want)


def test_rotation_matrices_as_columns(spark):
    row = spark.createDataFrame([(20.0, -35.0)], "angle_z double, angle_x double")
    got = np.reshape(row.select(spatial.turn_of(row).alias("t")).first()["t"]["matrix"], (3, 3))
    np.testing.assert_allclose(got, spatial.rotation_matrix({"z": 20.0, "x": -35.0}), atol=1e-12)
    read = row.withColumn("t", spatial.turn_of(row)).select(patches.read_sizes(F.array(*map(F.lit, (4, 4, 4))), F.array(*[F.lit(8.0)] * 3), F.array(*[F.lit(4.0)] * 3), F.col("t.matrix")).alias("n")).first()["n"]
    assert read == [int(np.ceil(8 * np.abs(r).sum())) for r in got]


def test_functions_of_whole_patches(spark, tmp_path):
    data, path = np.random.default_rng(1).random((6, 6, 6)).astype(np.float32), f"{tmp_path}/a.zarr"
    write(spark, path, data, (3, 3, 6))
    at = [{"z": 24.0, "y": 24.0, "x": 24.0}]
    whole = lambda f: np.reshape([v for _, v in sorted(by_place(Image.open(spark, path, SPEC, transform=f).read(at)).items())], (4, 4, 4))
    x = data[1:5, 1:5, 1:5]
    np.testing.assert_allclose(whole(V.patch_contrast(0.5)), np.clip(0.5 * x + 0.5 * x.mean(0), 0, 1), atol=1e-6)
    plain = Image.open(spark, path, SPEC)
    rows = plain.read(at).drop("idx").withColumn("k", F.lit(0))
    blurred = by_place(spatial.blur(rows, ["k"], (4, 4, 4), V.gaussian_kernel(3, 0.8, 2)))
    np.testing.assert_allclose(whole(V.patch_blur(3, 0.8, 2)).ravel(), [blurred[k] for k in sorted(blurred)], atol=1e-6)
    samples = spark.createDataFrame([(7, [24.0, 24.0, 24.0])], "sample bigint, centre array<double>")
    later = patches.applied(plain.patches(samples, "raw"), {"raw": V.OfPatch(lambda p: p * 2)}).first()
    assert later["sample"] == 7 and np.allclose(np.reshape(later["data"], later["shape"]), 2 * x)


def test_transforms_of_two_kinds_do_not_mix():
    twice = V.chained(V.OfPatch(lambda p: p + 1), V.OfPatch(lambda p: p * 2))
    assert isinstance(twice, V.OfPatch) and twice(np.array([1.0]))[0] == 4
    with pytest.raises(ValueError, match="do not mix"):
        V.chained(V.binarize(), V.patch_blur())


def test_catalogue_of_many_groups(spark, tmp_path):
    for i in range(30):
        folder = tmp_path / f"g{i}.zarr"
        (folder / "s0").mkdir(parents=True)
        (folder / "s1").mkdir()
        axes = [None, ["z", "y", "x"], [{"name": a, "type": "space"} for a in "zyx"]][i % 3]
        sets = [{"path": f"s{k}", "coordinateTransformations": [{"type": "scale", "scale": [4.0 * 2**k] * 3}]} for k in range(2)]
        (folder / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": sets} | ({"axes": axes} if axes else {})]}))
        for k in range(2):
            (folder / f"s{k}" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [16 >> k] * 3, "chunks": [8] * 3, "dtype": "|u1", "compressor": None, "fill_value": 1, "order": "C", "filters": None}))
        (folder / "s0" / ".zattrs").write_text(json.dumps({"class_counts": {"mito": 100 + i}}))
    asked = spark.createDataFrame([(str(i), f"{tmp_path}/g{i}.zarr", [8.0, 8.0, 8.0]) for i in range(31)], "volume_id string, path string, target array<double>")
    rows, n = jobs(spark, lambda: catalog.opened(asked).collect())
    assert n <= 2 and len(rows) == 31  # adaptive execution may take a job for the shuffle and one for the rest
    for r in rows:
        if r["volume_id"] == "30":
            assert r["best"]["meta"] is None
        else:
            assert r["best"]["folder"].endswith(".zarr/s1") and json.loads(r["best"]["meta"])["shape"] == [8] * 3 and r["best"]["origin"] == [0.0] * 3
            assert r["first"]["level"] == 0 and r["first"]["counts"] == {"mito": 100 + int(r["volume_id"])}
    image = Image.open(spark, f"{tmp_path}/g4.zarr", SPEC)
    assert image.foreground("mito") == 104 * 64 // 512 and image.foreground("er") == 16**3 * 64 // 512  # chunks that are not there hold 1
    with pytest.raises(FileNotFoundError):
        Image.open(spark, f"{tmp_path}/none.zarr", SPEC)


def test_split_is_opened_at_once(spark, tmp_path):
    data = np.ones((6, 6, 6))
    for name in ("raw", "gt/mito", "gt/er"):
        write(spark, f"{tmp_path}/v.zarr/{name}", data * (2 if name == "raw" else 1), (6, 6, 6))
    raw, gt = f"{tmp_path}/v.zarr/raw", f"{tmp_path}/v.zarr/gt"
    rows = spark.createDataFrame([("train", raw, f"{gt}/[mito,er]"), ("Train2", raw, f"{gt}/[mito,nuc]"), ("validate", raw, f"{gt}/[er]"), ("train", f"{tmp_path}/no", gt), ("train", "", gt)], "split string, raw_path string, gt_path string")
    with pytest.warns(UserWarning, match="left out"):
        split = Split.cataloged(spark, rows, {"raw": SPEC, "wide": Spec((2, 2, 2), (16, 16, 16))}, SPEC, pad="validate", train_transform=lambda v: v + 1, validate_transform=None, target_transforms={"er": lambda v: v * 5})
    assert [[c for c, i in d.targets.items() if i] for d in split.train] == [["er", "mito"], ["mito"]] and split.train[0].classes == ["er", "gt", "mito", "nuc"]
    assert [d.inputs["raw"].pad for d in split.train + split.validate] == [False, False, True] and len(split.failed) == 1
    value = lambda d: {r["source"]: r["v"] for r in d.read([0]).where("dz = 1 and dy = 1 and dx = 1").collect()}
    got = value(split.train[0])
    assert (got["raw"], got["wide"], got["er"], got["mito"]) == (3, 3, 5, 1) and np.isnan(got["nuc"]) and value(split.validate[0])["raw"] == 2


def test_kept_counts_start_no_scan(spark, tmp_path):
    data, path, kept = np.ones((6, 6, 6)), f"{tmp_path}/a.zarr", f"{tmp_path}/counts"
    write(spark, path, data, (3, 6, 6))
    image = Image.open(spark, path, SPEC)
    assert foregrounds([("a", image)], kept) == [216]
    chunk = f"{path}/s0/0.0.0"
    told = os.stat(chunk)
    with open(chunk, "r+b") as f:
        f.write(bytes(told.st_size))  # all 0 now, but of the same size and time: an opened chunk would show
    os.utime(chunk, ns=(told.st_atime_ns, told.st_mtime_ns))
    assert foregrounds([("a", image)], kept) == [216]
    os.utime(chunk, ns=(told.st_atime_ns, told.st_mtime_ns + 10**9))
    assert foregrounds([("a", image), ("b", image)], kept) == [108, 108] and foregrounds([("a", image)]) == [108]
    assert spark.read.parquet(kept).count() == 3  # one chunk was counted again
    meta = json.load(open(f"{path}/s0/.zarray"))
    runs = stats.chunk_runs(spark.createDataFrame([("v", f"{path}/s0", json.dumps(meta))], "volume_id string, folder string, meta string"), 1)
    assert [(r["first"], r["last"]) for r in runs.orderBy("first").collect()] == [(0, 1), (1, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", rng.permuted(F.col("id"), n, 3, 1).alias("p"), rng.permuted(F.col("id"), n, 3, 2).alias("q")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["p"] == rng.permuted_index(r["id"], n, 3, 1) for r in rows)
    if n >= 64:
        assert sum(r["p"] == r["q"] for r in rows) < 10 and sum(abs(r["p"] - r["id"]) < n / 10 for r in rows) < 0.35 * n


def test_permuted_orders_spread(spark):
    """Over many keys, an index comes to all places about equally often."""
    rows = spark.range(4000).select(rng.permuted(F.lit(0), 8, F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(rows) == 8 and all(400 < r["count"] < 600 for r in rows)


def test_few_repeats(spark):
    rows = sampling.few_repeats(spark.range(23), "id", 10, 4).collect()
    assert all(sorted(r["idx"] for r in rows if r["id"] // 10 == b) == list(range(10)) for b in (0, 1)) and len({r["idx"] for r in rows if r["id"] >= 20}) == 3


MATRIX = [[True, False, False], [False, True, False], [True, True, False], [False, True, False]]


def test_balanced_draws_go_on_in_a_stream(spark, tmp_path):
    want = {e: sampling.balanced_rows(MATRIX, 12, 42, e) for e in (0, 1)}
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(MATRIX)], "crop int, a boolean, b boolean, c boolean")
    got = sampling.balanced(table, "crop", ["a", "b", "c"], 12, epochs=(0, 1)).collect()
    assert {e: [r["crop"] for r in sorted(got, key=lambda r: r["pos"]) if r["epoch"] == e] for e in (0, 1)} == want
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([(0, 5), (1, 2)], [(0, 3), (0, 4), (1, 10)]):
        spark.createDataFrame(rows, "epoch int, wanted int").coalesce(1).write.mode("append").parquet(source)
        stream = sampling.balanced_stream(spark.readStream.schema("epoch int, wanted int").parquet(source), MATRIX)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {e: [r["row"] for r in sorted(rows, key=lambda r: r["pos"]) if r["epoch"] == e] for e in (0, 1)} == want


def test_written_patches_become_a_volume(spark, tmp_path):
    """Patches about centres, saved, read again; a second save changes only its own voxels."""
    spec = Spec((2, 2, 2), (8, 8, 8))
    writer = Writer({"z": (16.0, 48.0), "y": (0.0, 40.0), "x": (0.0, 32.0)}, spec)
    centres = [{"z": z, "y": y, "x": x} for z in (24.0, 40.0) for y in (8.0, 24.0) for x in (8.0, 24.0)]
    rows = spark.createDataFrame([(i, z, y, x, 100.0 * i + 4 * z + 2 * y + x) for i in range(8) for z, y, x in np.ndindex(2, 2, 2)], "idx int, dz int, dy int, dx int, v double")
    path = f"{tmp_path}/out.zarr/pred"
    writer.save(writer.placed(rows, centres), path, chunk=(3, 2, 4))
    out = read(spark, path)
    assert out.shape == (4, 5, 4) and (out[:, 4] == 0).all() and out[2, 2, 3] == 701 and Image.open(spark, path, spec).origin["z"] == 16.0
    one = spark.createDataFrame([(0, 0, 0, 0, -1.0)], "idx int, dz int, dy int, dx int, v double")
    writer.save(writer.placed(one, [{"z": 24.0, "y": 8.0, "x": 8.0}]), path, chunk=(3, 2, 4))
    want = out.copy()
    want[0, 0, 0] = -1
    np.testing.assert_array_equal(read(spark, path), want)
    classes = DatasetWriter(writer.box, spec, ["a", "b"], ["out"])
    classes.save_classes(classes.write({"out": rows, "b": one}, centres), f"{tmp_path}/more.zarr", "overwrite")
    assert read(spark, f"{tmp_path}/more.zarr/a")[2, 2, 3] == 701 and (read(spark, f"{tmp_path}/more.zarr/b") == -1).sum() <= 1
