"""Array shapes as arrays of ints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_2d(shape: Column) -> Column:
    return F.coalesce(F.size(shape) == 2, F.lit(False))


def has_singleton(shape: Column) -> Column:
    return F.coalesce(F.array_contains(shape, 1), F.lit(False))


def squeezed(shape: Column) -> Column:
    """Without the axes of size 1; [1] if none is left."""
    rest = F.filter(shape, lambda d: d != 1)
    return F.when(F.size(rest) == 0, F.array(F.lit(1))).otherwise(rest)


def with_channel(shape: Column) -> Column:
    return F.concat(F.array(F.lit(1)), F.filter(shape, lambda d: d != 1))


def sliced(shape: Column, axis: Column) -> Column:
    """The shape with its axis of size 1 moved to `axis`, or, if it has none, one put there."""
    at = F.array_position(shape, 1).cast("int")
    rest = F.when(at > 0, F.concat(F.slice(shape, F.lit(1), at - 1), F.slice(shape, at + 1, F.size(shape)))).otherwise(shape)
    return F.concat(F.slice(rest, F.lit(1), axis), F.array(F.lit(1)), F.slice(rest, axis + 1, F.size(rest)))


def singleton_moved(arrays: dict, axis: int) -> dict:
    """Array specifications (shape, scale), at any depth of a dict, with the axis of size 1 at `axis` and three scales; the input stays."""
    if "shape" in arrays and "scale" in arrays:
        shape, scale = list(arrays["shape"]), list(arrays["scale"])
        if 1 in shape:
            shape.remove(1)
        return arrays | {"shape": shape[:axis] + [1] + shape[axis:], "scale": scale[:1] + scale if len(scale) == 2 else scale}
    return {name: singleton_moved(inner, axis) for name, inner in arrays.items()}
