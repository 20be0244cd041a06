"""World boxes, sampling grids and read windows as column expressions; coordinates are nanometres in doubles.

Python's rounding is half to even, so sizes use bround. A missing box is NULL, a missing value in a patch NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def box_voxels(lo: Column, hi: Column, scale: Column) -> Column:
    """Voxels along an axis: at least one."""
    return F.greatest(F.lit(1).cast("long"), half_even((hi - lo) / scale))


def bounding(origin: Column, voxels: Column, voxel_size: Column) -> Column:
    return F.struct(origin.cast("double").alias("lo"), (origin + voxels * voxel_size).cast("double").alias("hi"))


def sampling(lo: Column, hi: Column, size: Column, scale: Column, pad: Column) -> Column:
    """Where centres may lie: the box less half an output at each end; too small, one voxel at the centre if padded, else NULL."""
    a, b, mid = lo + size / 2, hi - size / 2, (lo + hi) / 2
    return F.when(a < b, F.struct(a.alias("lo"), b.alias("hi"))).when(pad, F.struct((mid - scale / 2).alias("lo"), (mid + scale / 2).alias("hi")))


def writer_sampling(lo: Column, hi: Column, size: Column) -> Column:
    """The writer's box: too small, both ends are the centre."""
    a, b, mid = lo + size / 2, hi - size / 2, (lo + hi) / 2
    return F.when(a < b, F.struct(a.alias("lo"), b.alias("hi"))).otherwise(F.struct(mid.alias("lo"), mid.alias("hi")))


def read_voxels(out_voxels: Column, scale: Column, voxel_size: Column) -> Column:
    """Stored voxels that cover an output of out_voxels at scale."""
    return F.greatest(F.lit(1).cast("long"), half_even(out_voxels * scale / voxel_size))


def rotated_voxels(base: list[Column], matrix: list[list[Column]]) -> list[Column]:
    """Read shape under a rotation: ceil(base_i * sum_j |R_ij|)."""
    return [F.ceil(b * sum((F.abs(r) for r in row[1:]), F.abs(row[0]))) for b, row in zip(base, matrix, strict=True)]


def read_window(centre: Column, origin: Column, voxel_size: Column, read: Column, stored: Column) -> Column:
    """start, pad_lo, valid, pad_hi of a read of `read` voxels about a centre, against `stored` voxels."""
    start = F.floor((centre - origin) / voxel_size - read / 2)
    pad_lo = F.greatest(F.lit(0), F.least(read, -start))
    first = F.greatest(F.lit(0), start)
    valid = F.greatest(F.lit(0), F.least(stored, first + read - pad_lo) - first)
    return F.struct(start.alias("start"), pad_lo.alias("pad_lo"), valid.alias("valid"), (read - pad_lo - valid).alias("pad_hi"))


def write_start(centre: Column, offset: Column, scale: Column, size: Column) -> Column:
    """The voxel at which a patch is written: rounded half to even, unlike a read's, which is floored."""
    return half_even((centre - size / 2 - offset) / scale)


def whole(a: Column, b: Column) -> Column:
    """The quotient of whole numbers, none of them negative, exact beyond the 53 bits of a double."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def unravel(index: Column, shape: list[Column]) -> list[Column]:
    """C-order indices of a flat index; negative and large ones wrap."""
    total = shape[0]
    for s in shape[1:]:
        total = total * s
    rest, out = F.pmod(index, total), []
    for s in reversed(shape):
        out.append(F.pmod(rest, s))
        rest = whole(rest, s)
    return out[::-1]


def centre_of(lo: Column, voxel: Column, scale: Column) -> Column:
    return lo + (voxel + 0.5) * scale


def tile_count(lo: Column, hi: Column, tile: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), half_even((hi - lo) / tile))


def tile_voxel(k: Column, grid: Column, tiles: Column) -> Column:
    return whole(k * grid, tiles)


def intersect_boxes(boxes: DataFrame, key: str, source: str) -> DataFrame:
    """key, axis, lo, hi over boxes (key, source, axis, lo, hi): the common box of a key's sources.

    Axes that a source lacks are dropped; a key whose sources touch or miss each other along a shared axis, or share none, has no row.
    """
    of_source = boxes.groupBy(key, source, "axis").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    # A source's axes become one row for each, and one without an axis that counts the source: sums go up by key before they meet.
    axes = of_source.groupBy(key, source).agg(F.collect_list(F.struct("axis", *[F.col(c).cast("double").alias(c) for c in ("lo", "hi")])).alias("a"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("axis"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
    each = axes.select(key, F.explode(F.concat("a", none)).alias("a")).groupBy(key, "a.axis").agg(F.max("a.lo").alias("lo"), F.min("a.hi").alias("hi"), F.count("*").alias("with"))
    rows = each.groupBy(key).agg(F.max(F.when(F.col("axis").isNull(), F.col("with"))).alias("n"), F.collect_list(F.when(F.col("axis").isNotNull(), F.struct("axis", "lo", "hi", "with"))).alias("a"))
    shared = rows.withColumn("a", F.filter("a", lambda x: x["with"] == F.col("n"))).where(~F.exists("a", lambda x: x["lo"] >= x["hi"]))
    return shared.select(key, F.explode("a").alias("a")).select(key, "a.axis", "a.lo", "a.hi")


def unite_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """key, axis, lo, hi: the least box around a key's boxes; axes of one source alone stay."""
    return boxes.groupBy(key, "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
