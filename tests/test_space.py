from pyspark.sql import functions as F
from voxlake.functions import geometry as G
from voxlake.operators import sampling


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_bounding_and_sampling_box(spark):
    assert tuple(one(spark, G.bounding(*lit(0.0, 20, 8.0)))) == (0.0, 160.0)
    assert tuple(one(spark, G.sampling(*lit(0.0, 160.0, 32.0, 8.0, False)))) == (16.0, 144.0)
    assert one(spark, G.sampling(*lit(0.0, 80.0, 800.0, 8.0, False))) is None
    assert tuple(one(spark, G.sampling(*lit(0.0, 80.0, 800.0, 8.0, True)))) == (36.0, 44.0)
    assert tuple(one(spark, G.writer_sampling(*lit(0.0, 80.0, 800.0)))) == (40.0, 40.0)


def test_box_voxels_round_half_to_even(spark):
    assert one(spark, G.box_voxels(*lit(0.0, 12.0, 8.0))) == 2
    assert one(spark, G.box_voxels(*lit(0.0, 4.0, 8.0))) == 1
    assert one(spark, G.box_voxels(*lit(0.0, 20.0, 8.0))) == 2


def test_windows(spark):
    w = one(spark, G.read_window(*lit(10000.0, 0.0, 8.0, 4, 8)))
    assert (w["valid"], w["pad_lo"] + w["pad_hi"]) == (0, 4)
    w = one(spark, G.read_window(*lit(4.0, 0.0, 8.0, 4, 8)))
    assert (w["start"], w["pad_lo"], w["valid"], w["pad_hi"]) == (-2, 2, 2, 0)
    # reads floor and writes round: odd starts are written one voxel late
    starts = [one(spark, G.write_start(*lit((v + 2.5 + 0.5) * 8.0 - 0.0, 0.0, 8.0, 40.0))) for v in (0, 5, 10, 15)]
    assert starts == [0, 6, 10, 16]


def test_unravel_wraps(spark):
    z, y, x = G.unravel(F.lit(-1), lit(2, 3, 4))
    assert tuple(one(spark, F.array(z, y, x))) == (1, 2, 3)


def test_intersection_and_union(spark):
    boxes = spark.createDataFrame(
        [("a", 1, "x", 0.0, 100.0), ("a", 2, "x", 50.0, 150.0), ("b", 1, "x", 0.0, 50.0), ("b", 2, "x", 50.0, 80.0), ("c", 1, "x", 0.0, 50.0), ("c", 1, "y", 0.0, 1.0), ("c", 2, "x", 70.0, 120.0), ("d", 1, "z", 0.0, 1.0), ("d", 1, "x", 0.0, 9.0), ("d", 2, "x", 3.0, 12.0)],
        "k string, s int, axis string, lo double, hi double",
    )
    assert {tuple(r) for r in G.intersect_boxes(boxes, "k", "s").collect()} == {("a", "x", 50.0, 100.0), ("d", "x", 3.0, 9.0)}
    assert ("c", "x", 0.0, 120.0) in {tuple(r) for r in G.unite_boxes(boxes, "k").collect()}


def test_sample_ranges(spark):
    got = [tuple(one(spark, sampling.sample_range(*lit(r, 3, 10)))) for r in range(3)]
    assert got == [(0, 4), (4, 3), (7, 3)]
