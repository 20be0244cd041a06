"""Patch reads. A request names a volume, a window start and a shape in stored voxels; voxels outside a volume are padded.

Two forms give the same values. Voxel form: a row for each voxel, joined by equality on (volume, z, y, x) to the offsets of
each request, for plans that go on relationally. Chunk form: rows hold dense chunks; a window is turned into the few chunk ids that
it touches, so the join is one of equality on the chunk key and not a range join, and NumPy assembles each patch from its
chunks. A request reads (ceil(r / C) + 1) ** 3 chunks at most, whatever the volume's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def offsets(shape: tuple[int, int, int]) -> Column:
    """All offsets of a patch as an array of structs dz, dy, dx, built row by row without a join."""
    nz, ny, nx = shape
    flat = F.sequence(F.lit(0), F.lit(nz * ny * nx - 1))
    return F.transform(flat, lambda i: F.struct(F.floor(i / (ny * nx)).cast("int").alias("dz"), (F.floor(i / nx) % ny).cast("int").alias("dy"), (i % nx).cast("int").alias("dx")))


def read_voxels(requests: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], pad_value: float = NAN) -> DataFrame:
    """requests (volume_id, patch_id, z0, y0, x0) and voxels (volume_id, z, y, x, v): a row (.., dz, dy, dx, v) for each voxel of each patch."""
    grid = requests.withColumn("_o", F.explode(offsets(shape))).select("*", "_o.dz", "_o.dy", "_o.dx").drop("_o")
    grid = grid.withColumns({a: F.col(f"{a}0") + F.col(f"d{a}") for a in "zyx"})
    read = grid.join(voxels.select("volume_id", "z", "y", "x", "v"), ["volume_id", "z", "y", "x"], "left")
    return read.select("volume_id", "patch_id", "dz", "dy", "dx", F.coalesce("v", F.lit(pad_value)).alias("v"))


def chunked(voxels: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """Chunks (volume_id, cz, cy, cx, shape, at, data) from voxels: data holds the values of the places `at` in C order.

    Absent places are padded when read. Rows of sources.ngff, with at NULL, are whole: no place is named.
    """
    ids = [F.floor(F.col(a) / c).cast("int").alias(f"c{a}") for a, c in zip("zyx", chunk, strict=True)]
    flat = (F.col("z") % chunk[0] * chunk[1] + F.col("y") % chunk[1]) * chunk[2] + F.col("x") % chunk[2]
    rows = voxels.select("volume_id", *ids, F.struct(flat.cast("int").alias("i"), F.col("v").cast("float").alias("v")).alias("_c"))
    got = rows.groupBy("volume_id", "cz", "cy", "cx").agg(F.collect_list("_c").alias("_c"))
    return got.select("volume_id", "cz", "cy", "cx", F.array(*map(F.lit, chunk)).alias("shape"), F.col("_c.i").alias("at"), F.col("_c.v").alias("data"))


def touched(start: Column, size: int, stored: Column, chunk: int) -> Column:
    """Ids of the chunks along an axis that a window touches; none if it misses the volume (sequence() would count down)."""
    lo, hi = F.floor(F.greatest(start, F.lit(0)) / chunk), F.floor((F.least(start + size, stored) - 1) / chunk)
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def read_chunks(requests: DataFrame, chunks: DataFrame, shape: tuple[int, int, int], chunk: tuple[int, int, int], pad_value: float = NAN) -> DataFrame:
    """requests (volume_id, patch_id, z0, y0, x0, nz, ny, nx) over chunked(): volume_id, patch_id, data (array<float>, C order).

    A chunk is copied into a patch by one slice; a task holds the chunks that one window touches.
    """
    ids = requests
    for a, size, c in zip("zyx", shape, chunk, strict=True):
        ids = ids.withColumn(f"c{a}", F.explode_outer(touched(F.col(f"{a}0"), size, F.col(f"n{a}"), c))).withColumn(f"c{a}", F.col(f"c{a}").cast("int"))
    met = ids.join(chunks.select("volume_id", "cz", "cy", "cx", "shape", "at", "data"), ["volume_id", "cz", "cy", "cx"], "left")

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        out = np.full(shape, pad_value, np.float32)
        first = group.iloc[0]
        start = (first.z0, first.y0, first.x0)
        for row in group.itertuples():
            if not isinstance(row.data, np.ndarray | list):
                continue  # the window misses the volume, or no such chunk is stored
            size = tuple(int(n) for n in row.shape)
            block = np.asarray(row.data, np.float32)
            if isinstance(row.at, np.ndarray | list):
                values, block = block, np.full(int(np.prod(size)), pad_value, np.float32)
                block[np.asarray(row.at)] = values
            low = [int(k * c - s) for k, c, s in zip((row.cz, row.cy, row.cx), chunk, start, strict=True)]
            into = tuple(slice(max(0, k), max(0, min(n, k + m))) for k, n, m in zip(low, shape, size, strict=True))
            out[into] = block.reshape(size)[tuple(slice(t.start - k, max(t.start, t.stop) - k) for t, k in zip(into, low, strict=True))]
        return pd.DataFrame({"volume_id": [first.volume_id], "patch_id": [first.patch_id], "data": [out.ravel()]})

    kind = requests.schema["volume_id"].dataType.simpleString()
    return met.groupBy("volume_id", "patch_id").applyInPandas(assemble, f"volume_id {kind}, patch_id {requests.schema['patch_id'].dataType.simpleString()}, data array<float>")


def as_voxels(patches: DataFrame, keys: list[str], shape: tuple[int, ...]) -> DataFrame:
    """Patch form (keys, data in C order) to voxel form: keys, dz, dy, dx, v."""
    cells = patches.select(*keys, F.posexplode("data").alias("_i", "v"))
    i, (_, ny, nx) = F.col("_i"), shape
    return cells.select(*keys, F.floor(i / (ny * nx)).cast("int").alias("dz"), (F.floor(i / nx) % ny).cast("int").alias("dy"), (i % nx).alias("dx"), F.col("v").cast("double").alias("v"))


def out_of_bounds(start: Column, size: Column, stored: Column) -> Column:
    """Whether a window has no stored voxel along an axis."""
    return (start >= stored) | (start + size <= 0)


def empty_patch(shape: tuple[int, ...]) -> Column:
    """What an unannotated class reads as: NaN everywhere."""
    n = int(np.prod(shape))
    return F.array_repeat(F.lit(NAN), n)


def stream_patches(frames: Iterator[pd.DataFrame], f) -> Iterator[pd.DataFrame]:
    """Apply f(array of a patch) to column data of pandas batches with shape; what mapInPandas calls for patch-form transforms."""
    for frame in frames:
        frame["data"] = [f(np.asarray(d, np.float32).reshape([int(n) for n in s])).ravel() for d, s in zip(frame["data"], frame["shape"], strict=True)]
        yield frame
