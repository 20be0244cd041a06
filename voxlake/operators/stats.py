"""Class statistics: one distributed aggregate over voxels, never a volume in memory."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from ..sources import ngff


def foreground(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_foreground: voxels other than 0 (NaN counts)."""
    return voxels.groupBy(*keys).agg(F.count_if(F.col("v") != 0).alias("n_foreground"))


def scaled_count(count: Column, stored_volume: Column, train_volume: Column) -> Column:
    """A count at the stored voxel size as one at the training size, truncated."""
    return (count * stored_volume / train_volume).cast("long")


def class_counts(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """class, total over counts (class, n): classes without a count are 0."""
    total = counts.groupBy("class").agg(F.sum("n").alias("total"))
    return classes.select("class").join(total, "class", "left").select("class", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def class_weight(total: Column, fg: Column) -> Column:
    """max(total - fg, 0) / max(fg, 1); a class never annotated (total NULL) weighs 0."""
    return F.coalesce(F.greatest(total - fg, F.lit(0)) / F.greatest(fg, F.lit(1)), F.lit(0.0))


def crop_class_matrix(pairs: DataFrame, crop: str, label: str, labels: list) -> DataFrame:
    """crop, a boolean for each label: whether the crop holds it. The labels are given, so the pivot needs no pass of its own."""
    return pairs.groupBy(crop).agg(*[F.bool_or(F.col(label) == v).alias(f"c{v}") for v in labels])


def chunk_runs(volumes: DataFrame, run: int = 256) -> DataFrame:
    """volumes (volume_id, folder, meta) as runs [first, last) of their chunks in C order, dealt over a fixed number of tasks: adaptive
    execution would put these short rows into one."""
    array = ngff.array_of(F.col("meta"))
    grid = F.transform(F.arrays_zip(array["shape"].alias("n"), array["chunks"].alias("c")), lambda x: F.ceil(x["n"] / x["c"]))
    total = F.aggregate(grid, F.lit(1).cast("bigint"), lambda a, x: a * x)
    runs = volumes.select("volume_id", "folder", "meta", total.alias("_n")).where("_n > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(run).cast("bigint"))))
    return runs.withColumn("last", F.least(F.col("first") + run, F.col("_n"))).drop("_n").repartition(int(volumes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "folder", "first")


def _over_chunks(runs: DataFrame, count: bool) -> DataFrame:
    """volume_id, folder, chunk, stamp of the chunks [first, last); or of those in the list `chunks`, with n: their voxels other than 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                meta = json.loads(r["meta"])
                grid = ngff.grid_of(meta)
                for flat in r["chunks"] if count else range(r["first"], r["last"]):
                    at = [int(i) for i in np.unravel_index(flat, grid)]
                    name = ngff.chunk_name(meta, at[:-3], ngff.spatial(at, 0))
                    try:
                        told = os.stat(f"{r['folder']}/{name}")
                        stamp = f"{told.st_mtime_ns}:{told.st_size}"
                    except FileNotFoundError:
                        stamp = f"absent:{meta['fill_value']}"
                    n = None
                    if count:
                        inside = tuple(slice(0, m - i * c) for m, c, i in zip(meta["shape"], meta["chunks"], at, strict=True))
                        n = int(np.count_nonzero(ngff.read_chunk(r["folder"], meta, name)[inside]))
                    rows.append((r["volume_id"], r["folder"], flat, stamp, n))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["volume_id", "folder", "chunk", "stamp", "n"])

    importable(runs.sparkSession)
    return runs.mapInArrow(run, "volume_id string, folder string, chunk bigint, stamp string, n bigint")


def stored_foreground(volumes: DataFrame, kept: str | None = None) -> DataFrame:
    """volume_id, n over volumes (volume_id, folder, meta): voxels other than 0 of stored arrays, counted chunk by chunk where they lie.

    kept names a table of counts by folder, chunk and stamp (time and size of the file). Chunks whose stamp it holds are not opened
    again; the others are counted and added to it, so a second call over unchanged volumes scans no voxel.
    """
    spark = volumes.sparkSession
    volumes = volumes.select(F.col("volume_id").cast("string").alias("volume_id"), "folder", "meta")
    runs = chunk_runs(volumes)
    if kept is None:
        whole = runs.withColumn("chunks", F.sequence("first", F.col("last") - 1))
        return _over_chunks(whole, True).groupBy("volume_id").agg(F.sum("n").alias("n"))
    schema = "folder string, chunk bigint, stamp string, n bigint"
    now = _over_chunks(runs, False).drop("n")
    key = ["folder", "chunk", "stamp"]

    def known() -> DataFrame | None:
        try:
            return spark.read.schema(schema).parquet(kept)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    held = known()
    lacking = (now if held is None else now.join(held, key, "left_anti")).select("folder", "chunk").distinct()
    if not lacking.isEmpty():
        lists = lacking.groupBy("folder", F.floor(F.col("chunk") / 256).alias("_run")).agg(F.collect_list("chunk").alias("chunks"))
        asked = lists.join(volumes.groupBy("folder").agg(F.first("volume_id").alias("volume_id"), F.first("meta").alias("meta")), "folder")
        _over_chunks(asked, True).select(*key, "n").write.mode("append").parquet(kept)
    counts = known().groupBy(*key).agg(F.max("n").alias("n"))
    return now.join(counts, key).groupBy("volume_id").agg(F.sum("n").alias("n"))
