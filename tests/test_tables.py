import difflib
import hashlib
import json
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from voxlake.functions import rng, text
from voxlake.operators import catalog, sampling, sink
from voxlake.plans import registry
from voxlake.sources import ngff
from voxlake.streaming import patches


def test_longest_common_substring(spark):
    rows = spark.createDataFrame([("blue whale", "blunt"), ("north sea", "deep sea"), ("fog", "tin"), ("", "a"), ("abab", "ba ab")], "a string, b string")
    assert [text.common_part(a, b) for a, b in (("xabcy", "zabcabcq"), ("aXbbX", "bbXaX"), (None, "a"))] == ["abc", "bbX", None]
    assert [r[0] for r in rows.select(text.longest_common_substring(F.col("a"), F.col("b"))).collect()] == ["blu", " sea", "", "", "ab"]


def test_longest_common_substring_of_all_parts(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["p_partkey"]: r["lcs"] for r in registry.QUERIES["longest_common_substring"](spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        a, b = r["p_type"], r["p_name"]
        m = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
        want[r["p_partkey"]] = a[m.a : m.a + m.size]
    assert got == want and len(got) == 2000


def test_levels_without_translation_or_scale(spark):
    attrs = json.dumps({"multiscales": [{"axes": [{"name": "c", "type": "channel"}, {"name": "y", "type": "space"}, {"name": "x"}], "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [1, 4, 8]}]}, {"path": "s1", "coordinateTransformations": []}]}]})
    got = catalog.levels(spark.createDataFrame([("v", attrs)], "volume_id string, attrs string")).orderBy("level").collect()
    assert got[0]["axes"] == ["y", "x"] and got[0]["voxel_size"] == [4.0, 8.0] and got[0]["origin"] == [0.0, 0.0]
    assert got[1]["voxel_size"] is None


def test_corrected_pyramid(spark):
    made = spark.range(1).select(F.lit("v").alias("volume_id"), catalog.multiscale_attrs(F.lit("/x.zarr/a"), [8.0] * 3, [0.0] * 3, more_levels=2, corrected=True).alias("attrs"))
    got = catalog.levels(made).orderBy("level").collect()
    assert [(r["path"], r["voxel_size"][0], r["origin"][0]) for r in got] == [("s0", 8.0, 0.0), ("s1", 16.0, 4.0), ("s2", 32.0, 12.0)]


def test_balanced_sampler():
    rare = [[True, i == 0] for i in range(10)]
    drawn = sampling.balanced_rows(rare, 100)
    assert drawn == sampling.balanced_rows(rare, 100) != sampling.balanced_rows(rare, 100, epoch=1)
    assert 40 <= drawn.count(0)
    with pytest.raises(ValueError, match="no active classes"):
        sampling.balanced_rows([[False, False]], 3)


@pytest.mark.parametrize("k", [2, 3, 7])
def test_few_repeats(spark, k):
    got = sampling.few_repeats(spark.range(k).withColumnRenamed("id", "pos"), "pos", 3).orderBy("pos").collect()
    ids = [r["idx"] for r in got]
    assert len(ids) == k and all(len(set(ids[i : i + 3])) == len(ids[i : i + 3]) for i in range(0, k, 3))


@pytest.mark.parametrize("case", ["i + 1", "7 * i", "i - 10", "i // 2"])
def test_few_repeats_over_any_keys(spark, tmp_path, case):
    """Blocks are those of the SQL where keys do not run from 0 without gaps."""
    duck = duckdb.connect()
    duck.execute(f"create table customer as select cast({case} as bigint) as c_custkey, 0 as c_nationkey from range(50) t(i)")
    duck.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    got = [tuple(r) for r in registry.QUERIES["min_redundant_inds"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duck.execute(registry.ORACLE_SQL["min_redundant_inds"]).fetchall())


def test_few_repeats_of_one_row_group_are_many_tasks(spark, tmp_path):
    spark.range(70_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = registry.QUERIES["min_redundant_inds"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == 163_333 and max(r["count"] for r in rows) < 50_000


def test_told_bits_are_those_of_md5():
    random = np.random.default_rng(5)
    for at in (0, 1, 2, 3, 4, 7, 30, 45, 47, 48, 55, 56, 64, 130):
        for most in (1, 10, 11, 9999, 10**4, 10**4 + 1, 10**8, 10**8 + 1, 10**12, 10**16, 10**16 + 1, 2**62):
            for n in (1, 3):
                heads = [random.integers(33, 127, at, np.uint8).tobytes() for _ in range(n)]
                of, numbers = random.integers(0, n, 30), np.minimum((most * 10.0 ** -random.uniform(0, 7, 30)).astype(np.int64), most - 1)
                numbers[:2] = 0, most - 1
                want = [hashlib.md5(heads[k] + str(v).encode()).hexdigest() >= "8" for k, v in zip(of, numbers, strict=True)]
                assert rng._told(heads, of, numbers).tolist() == want


def test_permutation_of_many_takes_little_time(spark):
    """A task permutes in a third of the time of a loop over hashlib, with names of several lengths and nulls in between."""
    n, m = 900_000, 8000
    rows = spark.range(0, m, 1, 1).select("id", rng.permuted(F.when(F.col("id") % 100 != 7, F.col("id")), n, 9, F.col("id") % 12).alias("p"))
    got = {r["id"]: r["p"] for r in rows.collect()}
    began = time.perf_counter()
    want = {i: None if i % 100 == 7 else rng.permuted_index(i, n, 9, i % 12) for i in range(m)}
    loop = time.perf_counter() - began
    assert got == want
    began = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 0.35 * loop


def test_ngff_round_trip(spark, tmp_path):
    ngff.register(spark)
    data = np.random.default_rng(3).normal(size=(5, 6, 7)).astype(np.float32)
    path, rows = f"{tmp_path}/out.zarr/pred", []
    for cz, cy, cx in np.ndindex(3, 2, 2):
        part = data[cz * 2 : cz * 2 + 2, cy * 3 : cy * 3 + 3, cx * 4 : cx * 4 + 4]
        rows.append(("v", "s0", cz, cy, cx, cz * 2, cy * 3, cx * 4, list(part.shape), part.ravel().tolist(), []))
    df = spark.createDataFrame(rows, ngff.SCHEMA)
    df.write.format("ngff").mode("append").options(path=path, shape="5,6,7", chunks="2,3,4", voxel_size="8,8,8", origin="1,2,3").save()
    got = spark.read.format("ngff").options(path=path, chunksPerPartition="5").load()
    assert got.rdd.getNumPartitions() == 3
    out = np.zeros_like(data)
    for r in got.collect():
        z, y, x = r["z0"], r["y0"], r["x0"]
        s = r["shape"]
        out[z : z + s[0], y : y + s[1], x : x + s[2]] = np.array(r["data"], np.float32).reshape(s)
    np.testing.assert_array_equal(out, data)
    level = catalog.levels(spark.createDataFrame([("v", ngff.read_attrs(path))], "volume_id string, attrs string")).first()
    assert level["voxel_size"] == [8.0] * 3 and level["origin"] == [1.0, 2.0, 3.0]


def test_ngff_names_an_unknown_compressor(tmp_path):
    (tmp_path / "0.0.0").write_bytes(b"x")
    with pytest.raises(ValueError, match="lz5"):
        ngff.read_chunk(str(tmp_path), {"dtype": "<f4", "chunks": [1, 1, 1], "fill_value": 0, "compressor": {"id": "lz5"}}, "0.0.0")


def test_last_write_and_clamp(spark):
    rows = spark.createDataFrame([(-1, 0, 1.0, 1), (-1, 1, 2.0, 1), (3, 0, 3.0, 2), (3, 1, 4.0, 2), (0, 0, 9.0, 3)], "z0 int, dz int, v double, seq int").withColumn("size_z", F.lit(2))
    got = {(r["z"], r["v"]) for r in sink.last_write(sink.placed(rows, {"z": 4}), ["z"], "seq").collect()}
    assert got == {(0, 9.0), (3, 3.0)}


def test_stream_of_patches(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for n, v in enumerate((1.0, 2.0)):
        spark.createDataFrame([(0, d, v + d, n) for d in range(2 - n)], "z0 int, dz int, v double, seq int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("z0 int, dz int, v double, seq int").parquet(source)
        patches.write_patches(stream, out, f"{tmp_path}/ck", ["z"], "seq", {"z": 4}).awaitTermination()
    assert {(r["z"], r["v"]) for r in patches.last_state(spark, out, ["z"]).collect()} == {(0, 2.0), (1, 2.0)}


def test_ngff_reads_chunks_and_replaces_them(spark, tmp_path):
    ngff.register(spark)
    path, data = f"{tmp_path}/w.zarr", np.arange(12 * 12 * 12, dtype=np.float32).reshape(12, 12, 12)
    at = [(z, y, x) for z in range(4) for y in range(4) for x in range(4)]
    rows = [("v", "s0", z, y, x, 3 * z, 3 * y, 3 * x, [3, 3, 3], data[3 * z : 3 * z + 3, 3 * y : 3 * y + 3, 3 * x : 3 * x + 3].ravel().tolist(), []) for z, y, x in at]
    save = lambda rows, mode, **more: spark.createDataFrame(rows, ngff.SCHEMA).write.format("ngff").mode(mode).options(**({"path": path, "shape": "12,12,12", "chunks": "3,3,3"} | more)).save()
    save(rows, "append")
    chunks = spark.read.format("ngff").options(path=path).load().where("(cz = 0 and cy in (1, 2) and cx = 2)")
    got = {(r["cz"], r["cy"], r["cx"]): r["data"] for r in chunks.collect()}
    assert set(got) == {(0, 1, 2), (0, 2, 2)} and all(got[z, y, x] == data[3 * z : 3 * z + 3, 3 * y : 3 * y + 3, 3 * x : 3 * x + 3].ravel().tolist() for z, y, x in got)
    # a part of a chunk leaves the rest; another form is refused, or replaces what was there
    save([("v", "s0", 0, 1, 2, 0, 3, 6, [1, 1, 2], [-1.0, -2.0], [])], "append")
    part = {(r["cz"], r["cy"], r["cx"]): r["data"] for r in spark.read.format("ngff").options(path=path).load().collect()}
    assert part[0, 1, 2] == [-1.0, -2.0, *got[0, 1, 2][2:]] and len(part) == 64
    with pytest.raises(Exception, match="overwrite"):
        save(rows[:1], "append", shape="6,6,6")
    save(rows[:1], "overwrite", shape="6,6,6")
    last = {(r["cz"], r["cy"], r["cx"]): r["data"] for r in spark.read.format("ngff").options(path=path).load().collect()}
    assert len(last) == 8 and last[0, 0, 0] == rows[0][9] and not any(any(v) for k, v in last.items() if k != (0, 0, 0))
