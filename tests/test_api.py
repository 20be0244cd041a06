import numpy as np
import pytest
from pyspark.sql import functions as F
from voxlake import boxes
from voxlake.api import Dataset, DatasetWriter, Image, Loader, MultiDataset, Spec, Split, Writer
from voxlake.functions import shapes
from voxlake.functions import values as V
from voxlake.operators import spatial, stats
from voxlake.sources import ngff


def image(spark, data, spec, origin=(0, 0, 0), voxel=(8, 8, 8), **options):
    rows = [("0", *map(int, i), float(data[i])) for i in np.ndindex(*data.shape)]
    return Image(spark.createDataFrame(rows, "volume_id string, z int, y int, x int, v double"), data.shape, voxel, origin, spec, **options)


def array(df, shape):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[r["dz"], r["dy"], r["dx"]] = r["v"]
    return out


def test_boxes():
    a, b = {"x": (-10, 70)}, {"x": (30, 95)}
    assert boxes.intersect(a, b) == {"x": (30, 70)} and boxes.intersect(a, {"x": (70, 71)}) is None and boxes.intersect(a, {"y": (0, 1)}) is None
    assert boxes.unite({"x": (2, 9)}, {"x": (11, 13), "y": (0, 1)}) == {"x": (2, 13), "y": (0, 1)}
    assert boxes.voxels({"x": (0, 10)}, {"x": 4}) == {"x": 2}
    assert boxes.tiles({"x": (5.0, 65.0)}, {"x": 4.0}, {"x": 20.0}) == [0, 5, 10]
    assert [c["x"] for c in boxes.cover({"x": (0.0, 50.0)}, {"x": 5.0}, {"x": 20.0})] == [10.0, 30.0, 40.0]


def test_read_mirror_rotate(spark):
    data = np.arange(512.0).reshape(8, 8, 8)
    im = image(spark, data, Spec((4, 4, 4), (8, 8, 8)), pad=True)
    c = [{"z": 32.0, "y": 32.0, "x": 32.0}]
    plain = array(im.read(c), (4, 4, 4))
    np.testing.assert_array_equal(plain, data[2:6, 2:6, 2:6])
    np.testing.assert_array_equal(array(im.read(c, mirror={"y": True}), (4, 4, 4)), plain[:, ::-1])
    np.testing.assert_array_equal(array(im.read(c, transpose=(1, 2, 0)), (4, 4, 4)), plain.transpose(1, 2, 0))
    turn = np.array([[1, 0, 0], [0, 0.7071, -0.7071], [0, 0.7071, 0.7071]])
    assert array(im.read(c, rotation=turn), (4, 4, 4)).shape == (4, 4, 4)
    edge = array(im.read([{"z": 4.0, "y": 32.0, "x": 32.0}]), (4, 4, 4))
    assert np.isnan(edge[0]).all() and not np.isnan(edge[3]).any()
    coarse = image(spark, data, Spec((4, 4, 4), (16, 16, 16)))
    np.testing.assert_array_equal(array(coarse.read(c), (4, 4, 4)), data[::2, ::2, ::2])


def dataset(spark):
    raw = np.arange(1000.0).reshape(10, 10, 10)
    label = np.zeros((10, 10, 10))
    label[1:5, 2:5, 3:6] = 1
    spec = Spec((4, 4, 4), (8, 8, 8))
    return Dataset({"raw": image(spark, raw, spec)}, {"mito": image(spark, label, spec, transform=V.binarize()), "er": None}, spec)


def test_dataset(spark):
    d = dataset(spark)
    assert len(d) == 6**3 and d.class_counts == {"mito": 36, "er": 0} and d.crop_class_matrix() == [[True, False]]
    rows = d.read([0, -1])
    assert rows.count() == 2 * 3 * 64 and {r["idx"] for r in rows.select("idx").distinct().collect()} == {0, -1}
    assert rows.where("source = 'er'").where(~F.isnan("v")).count() == 0
    m = MultiDataset([d, d])
    assert len(m) == 432 and m.place(216) == (1, 0) and m.class_weights == {"mito": (2000 - 72) / 72, "er": 0.0}
    assert all(0 <= i < len(m) for i in m.validation_indices()) and m.balanced(5) == m.balanced(5)
    loader = Loader(m, 5, m.balanced(12))
    assert len(loader) == 3 and next(iter(loader)).select("dataset", "idx").distinct().count() <= 5


def test_small_label_crop(spark):
    spec = Spec((4, 4, 4), (8, 8, 8))
    raw, label = np.ones((14, 15, 16)), np.ones((3, 2, 3))
    make = lambda pad: Dataset({"raw": image(spark, raw, spec, pad=pad)}, {"a": image(spark, label, spec, origin=(44, 36, 52), pad=pad)}, spec)
    assert len(make(True)) == 1 and len(make(False)) == 0 and not make(False).verify()
    with pytest.raises(IndexError):
        make(False).read([0])


def test_split_open_and_write(spark, tmp_path):
    ngff.register(spark)
    data = np.random.default_rng(0).normal(size=(4, 4, 4)).astype(np.float32)
    chunk = spark.createDataFrame([("v", "s0", 0, 0, 0, 0, 0, 0, [4, 4, 4], data.ravel().tolist(), [])], ngff.SCHEMA)
    path = f"{tmp_path}/a.zarr/raw"
    chunk.write.format("ngff").mode("append").options(path=path, shape="4,4,4", chunks="4,4,4", voxel_size="8,8,8").save()
    csv = tmp_path / "split.csv"
    csv.write_text(f'train,{path},"{tmp_path}/gt/[mito,er]"\nvalidate,{path},{path}\n\n# no\nbad,row\n')
    spec = Spec((2, 2, 2), (8, 8, 8))
    split = Split.from_csv(spark, str(csv), lambda raw, template, classes, train: Dataset({"raw": Image.open(spark, raw, spec)}, dict.fromkeys(classes), spec))
    assert [d.classes for d in split.train] == [["mito", "er"]] and [d.classes for d in split.validate] == [["raw"]]
    writer = Writer({a: (0.0, 32.0) for a in "zyx"}, spec)
    centres = [{"z": z, "y": y, "x": x} for z in (8.0, 24.0) for y in (8.0, 24.0) for x in (8.0, 24.0)]
    out = np.full((4, 4, 4), np.nan, np.float32)
    for r in writer.placed(split.train[0].inputs["raw"].read(centres), centres).collect():
        out[r["z"], r["y"], r["x"]] = r["v"]
    np.testing.assert_array_equal(out, data)
    assert writer.shape == {"z": 4, "y": 4, "x": 4} and len(writer.centres()) == 1


def test_targets_are_stacked_in_class_order_under_each_name(spark):
    spec, one = Spec((2, 2, 2), (8, 8, 8)), np.ones((6, 6, 6))
    d = Dataset({"raw": image(spark, one, spec)}, {"b": image(spark, 3 * one, spec), "gap": None, "a": image(spark, 5 * one, spec)}, spec, ("near", "far"), {"a": lambda v: v * 2, "gap": lambda v: v * 0})
    got = {(r["target"], r["channel"]): (r["n"], r["v"]) for r in d.read_targets([0, 1]).groupBy("target", "channel").agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()}
    assert set(got) == {(t, c) for t in ("near", "far") for c in range(3)} and {n for n, _ in got.values()} == {16}
    assert got["far", 0][1] == 3 and np.isnan(got["near", 1][1]) and got["near", 2][1] == 10
    assert "classes=['b', 'gap', 'a']" in repr(d)


def test_split_sources_and_views(spark):
    d = dataset(spark)

    def build(raw, template, classes, train):
        if raw == "broken":
            raise OSError("no such volume")
        return d

    paths = {"Train_1": [("a", "t"), ("broken", "t"), ("", "t")], "validate": [("b", "t")]}
    with pytest.warns(UserWarning, match="broken"):
        split = Split.of(spark, build, paths=paths, csv="unused")
    assert (len(split.train), len(split.validate), [p for p, _ in split.failed]) == (1, 1, ["broken"])
    assert len(split.train_combined) == 216 and split.validate_blocks.indices == MultiDataset([d]).validation_indices() and repr(split) == "Split(train=1, validate=1, failed=1)"
    assert len(split.validate_blocks.loader(4)) == -(-len(split.validate_blocks) // 4)
    small = Dataset({}, {"a": None}, Spec((2, 2, 2), (8, 8, 8)))
    assert Split.of(spark, build, prebuilt={"train": [small]}, paths=paths).train == [small]  # as it is, though it has no sample
    with pytest.warns(UserWarning, match="broken"):
        assert split.rebuilt(spark, lambda *row: small if row[0] != "broken" else build(*row)).train == [] and len(split.train) == 1
    assert Split.of(spark).train == []


def test_loader_orders(spark):
    m = MultiDataset([dataset(spark), dataset(spark)])
    given = Loader(m, 2, order=lambda epoch: [epoch, 216, epoch], balanced=True)
    assert len(given) == 2
    rows = given.epoch_rows()
    assert {(r["batch_id"], r["pos"], r["dataset"], r["idx"]) for r in rows.select("batch_id", "pos", "dataset", "idx").distinct().collect()} == {(0, 0, 0, 0), (0, 1, 1, 0), (1, 2, 0, 0)}
    assert rows.count() == 3 * 3 * 64
    balanced = Loader(m, 4, balanced=True, per_epoch=6)
    order = lambda loader: [r["index"] for r in loader.order(spark).orderBy("pos").collect()]
    assert len(balanced) == 2 and order(balanced) == m.balanced(6, 0, 0)
    assert order(Loader(m, 4, balanced=True, train=False)) == list(range(432))
    none = MultiDataset([Dataset({}, {"a": None}, Spec((2, 2, 2), (8, 8, 8)))])
    with pytest.warns(UserWarning, match="no dataset"):
        assert len(Loader(none, balanced=True)) == 0


def test_writer_by_name_inputs_and_read_back(spark):
    spec = Spec((2, 2, 2), (8, 8, 8))
    data = np.arange(64.0).reshape(4, 4, 4) + 1
    w = DatasetWriter({a: (0.0, 32.0) for a in "zyx"}, spec, ["mito", "er", "nuc"], ["out"], ["er", "golgi", "mito"])
    centres = [{"z": 0.0, "y": 8.0, "x": 8.0}, {"z": 24.0, "y": 24.0, "x": 24.0}]
    inputs = w.inputs(image(spark, data, spec), centres)
    first = array(inputs.where("idx = 0"), (2, 2, 2))
    assert (first[0] == 0).all() and (first[1] == data[0, :2, :2]).all()  # padded with 0
    channels = inputs.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("v", F.col("v") + 100 * F.col("channel"))
    got = {(r["class"], r["z"], r["y"], r["x"]): r["v"] for r in w.write({"idx": inputs, "other": inputs, "out": channels, "nuc": inputs}, centres).collect()}
    assert {k[0] for k in got} == {"mito", "er", "nuc"} and len(got) == 3 * (4 + 8)
    assert got["er", 0, 1, 1] == data[0, 1, 1] and got["mito", 3, 3, 3] == 264 and got["nuc", 2, 2, 2] == data[2, 2, 2]
    whole = w.write({"out": inputs}, centres)
    assert whole.groupBy("class").count().where("count = 12").count() == 3
    voxels = image(spark, data, spec).rows
    assert {(r["z"], r["y"], r["x"]) for r in w.read_back(voxels, {"z": 0.0, "y": 8.0, "x": 30.0}).collect()} == {(0, y, x) for y in (0, 1) for x in (3,)}
    with pytest.raises(TypeError, match="dz"):
        w.write({"mito": spark.createDataFrame([(0, 1.0)], "idx int, v double")}, centres)
    with pytest.raises(ValueError, match="no array"):
        w.write({"other": inputs}, centres)
    assert [len(c) for c, _ in w.blocks(image(spark, data, spec), 3)] == [len(w.centres())]


def test_draws(spark):
    ids = spark.range(400)
    rows = spatial.drawn(ids, "id", {"mirror": {"x": 1.0, "y": 0.0}, "transpose": True, "rotate": {"axes": {"z": (10, 20), "x": 5}}}).collect()
    assert all(r["mirror_x"] and not r["mirror_y"] and 10 <= r["angle_z"] <= 20 and abs(r["angle_x"]) <= 5 for r in rows)
    assert len({tuple(r["perm"]) for r in rows}) == 6 and all(sorted(r["perm"]) == [0, 1, 2] for r in rows)
    assert spatial.drawn(ids, "id", {"mirror": True}).columns == ["id", "mirror_z", "mirror_y", "mirror_x"] and spatial.drawn(ids, "id", {}).columns == ["id"]


def test_singleton_moves_at_any_depth():
    got = shapes.singleton_moved({"raw": {"shape": (4, 1, 5), "scale": (8, 4)}, "more": {"gt": {"shape": [3, 3], "scale": [1, 2, 3]}}}, 0)
    assert got == {"raw": {"shape": [1, 4, 5], "scale": [8, 8, 4]}, "more": {"gt": {"shape": [1, 3, 3], "scale": [1, 2, 3]}}}


def test_default_chains(spark):
    rows = spark.createDataFrame([(float("nan"),), (300.0,), (0.0,)], "v double")
    got = rows.select(V.raw_default()(F.col("v")).alias("r"), V.target_default()(F.col("v")).alias("t")).collect()
    assert [r["r"] for r in got] == [0.0, 300.0, 0.0] and np.isnan(got[0]["t"]) and [r["t"] for r in got[1:]] == [1.0, 0.0]


def test_stored_volume_reads_as_its_voxels_do(spark, tmp_path):
    ngff.register(spark)
    data = np.random.default_rng(4).normal(size=(7, 6, 5)).astype(np.float32)
    path, rows = f"{tmp_path}/c.zarr", []
    for z, y, x in np.ndindex(3, 2, 2):
        part = data[3 * z : 3 * z + 3, 4 * y : 4 * y + 4, 3 * x : 3 * x + 3]
        rows.append(("v", "s0", z, y, x, 3 * z, 4 * y, 3 * x, list(part.shape), part.ravel().tolist(), []))
    spark.createDataFrame(rows, ngff.SCHEMA).write.format("ngff").mode("append").options(path=path, shape="7,6,5", chunks="3,4,3", voxel_size="8,8,8").save()
    spec = Spec((4, 5, 3), (8, 8, 8))
    stored, plain = Image.open(spark, path, spec), image(spark, data, spec)
    centres = [{"z": z, "y": y, "x": x} for z in (0.0, 24.0, 56.0, 900.0) for y, x in ((8.0, 40.0), (24.0, 12.0))]
    keyed = lambda im: {(r["idx"], r["dz"], r["dy"], r["dx"]): r["v"] for r in im.read(centres).collect()}
    got, want = keyed(stored), keyed(plain)
    assert set(got) == set(want) and len(got) == 8 * 60
    np.testing.assert_array_equal([got[k] for k in sorted(got)], [want[k] for k in sorted(got)])
