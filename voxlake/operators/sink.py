"""Writing patches into output volumes, as plans over voxel rows; sources.ngff writes the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def output_voxels(lo: Column, hi: Column, scale: Column) -> Column:
    return F.ceil((hi - lo) / scale)


def placed(patches: DataFrame, shape: dict[str, Column | int]) -> DataFrame:
    """Voxel rows (.., z0, y0, x0, dz, dy, dx, v) as (.., z, y, x, v) of the output; what falls outside goes, on both sides.

    Of a window that begins before the volume, the patch's beginning goes. size_z, size_y, size_x may bound the patch.
    """
    rows = patches.withColumns({a: F.col(f"{a}0") + F.col(f"d{a}") for a in shape})
    for a, n in shape.items():
        rows = rows.where((F.col(a) >= 0) & (F.col(a) < (n if isinstance(n, Column) else F.lit(n))))
        if f"size_{a}" in rows.columns:
            rows = rows.where(F.col(f"d{a}") < F.col(f"size_{a}"))
    return rows


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of writes to one voxel the last counts; a maximum is combined before the shuffle, unlike a window."""
    return rows.groupBy(*keys).agg(F.max_by("v", order).alias("v"))


def channels(patches: DataFrame, model_classes: list[str], written: list[str]) -> DataFrame:
    """Rows (.., channel, v) by class name: channel i is model_classes[i]; classes that are not written go."""
    names = F.array(*map(F.lit, model_classes))
    return patches.withColumn("class", F.get(names, F.col("channel").cast("int"))).where(F.col("class").isin(written))


def checked(patches: DataFrame) -> DataFrame:
    """patches if they are voxel rows; a table without the offsets of patches, such as one of scalars, is a TypeError."""
    if missing := {"dz", "dy", "dx", "v"} - set(patches.columns):
        raise TypeError(f"patches want the columns dz, dy, dx and v; {', '.join(sorted(missing))} not found")
    return patches


def by_class(patches: DataFrame, name: str, arrays: tuple[str, ...], written: list[str], model_classes: list[str]) -> DataFrame | None:
    """Patches under a name as rows (idx, class, dz, dy, dx, v) of the classes that are written; None if the name is unknown."""
    checked(patches)
    if name in arrays and "channel" in patches.columns:
        rows = channels(patches, model_classes, written)
    elif name in arrays and "class" in patches.columns:
        rows = patches.where(F.col("class").isin(written))
    elif name in arrays:
        rows = patches.withColumn("class", F.explode(F.array(*map(F.lit, written))))
    elif name in written:
        rows = patches.withColumn("class", F.lit(name))
    else:
        return None
    return rows.select("idx", "class", "dz", "dy", "dx", F.col("v").cast("double").alias("v"))


def window(voxels: DataFrame, ranges: dict[str, tuple[Column | int, Column | int]]) -> DataFrame:
    """The voxels with each axis in [start, stop): nothing is padded."""
    for a, (start, stop) in ranges.items():
        voxels = voxels.where((F.col(a) >= start) & (F.col(a) < stop))
    return voxels


def stacked(rows: DataFrame, source: str, classes: list[str], names: tuple[str, ...]) -> DataFrame:
    """Rows of sources as channels of a target: the classes in their order, the same stack under each target name; other sources go."""
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(source)).cast("int") - 1
    out = rows.withColumn("channel", at).where(F.col("channel") >= 0).withColumn("target", F.explode(F.array(*map(F.lit, names))))
    return out.select(*[c for c in rows.columns if c not in (source, "dz", "dy", "dx", "v")], "target", "channel", "dz", "dy", "dx", "v")


def chunk_rows(voxels: DataFrame, chunk: tuple[int, ...], level: str = "s0") -> DataFrame:
    """Voxels (volume_id, z, y, x, v) as rows of sources.ngff: a row for each chunk that some voxel falls into, with the places of its voxels.

    One shuffle by chunk, so each chunk has one writer; what its other places hold is the writer's business.
    """
    size = (1,) * (3 - len(chunk)) + tuple(chunk)
    held = scan.chunked(voxels, size)
    first = [(F.col(f"c{a}") * n).alias(f"{a}0") for a, n in zip("zyx", size, strict=True)]
    return held.select(F.col("volume_id").cast("string").alias("volume_id"), F.lit(level).alias("level"), "cz", "cy", "cx", *first, "shape", "data", F.array().cast("array<int>").alias("lead"), "at")
