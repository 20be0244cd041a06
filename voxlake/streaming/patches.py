"""Patches that arrive over time: written per micro-batch, and counted by class under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sink


def write_patches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, shape: dict[str, int]) -> StreamingQuery:
    """Write a stream of placed voxel rows into Parquet, one folder for each micro-batch, the last write of a batch per voxel.

    A batch that is run again overwrites its own folder, so each voxel write counts once. Reading: last_state().
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.last_write(sink.placed(batch, shape), keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_state(spark, path: str, keys: list[str]) -> DataFrame:
    """The volume after all batches: the write of the latest batch counts."""
    return sink.last_write(spark.read.parquet(path), keys, "batch")


def class_counts(stream: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Foreground voxels per class and event-time window; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(label)).agg(F.count_if(F.col("v") != 0).alias("n_foreground"))
