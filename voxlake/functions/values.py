"""Value transforms over patches held as arrays of floats, and over single values.

NaN means unknown: it stays in binarize and is replaced where the transform says so. Spark holds NaN above all numbers,
so each comparison guards it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028234663852886e38
#: The largest of each stored integer type; other types count as 1.
TYPE_MAX = {"uint8": 255, "int8": 127, "int16": 32767, "int32": 2147483647, "int64": 9223372036854775807}


def type_max(name: Column) -> Column:
    out = F.lit(1).cast("long")
    for k, v in TYPE_MAX.items():
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return out


def each(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A transform of one value as a transform of an array."""
    return lambda data: F.transform(data, f)


def binarize(threshold: float = 0.0) -> Callable[[Column], Column]:
    return lambda v: F.when(F.isnan(v), v).otherwise((v > threshold).cast("int").cast("double"))


def nan_to_num(nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Callable[[Column], Column]:
    hi, lo = FLOAT_MAX if posinf is None else posinf, -FLOAT_MAX if neginf is None else neginf
    return lambda v: F.when(F.isnan(v), F.lit(nan)).when(v == float("inf"), F.lit(hi)).when(v == float("-inf"), F.lit(lo)).otherwise(v)


class OfPatch:
    """A NumPy function of a whole patch (its leading axes, then z, y, x) where a transform wants more than one value at a time.

    It runs in the Arrow pass that makes the patch, or over patches by operators.patches.applied.
    """

    def __init__(self, f: Callable[[np.ndarray], np.ndarray]):
        self.f = f

    def __call__(self, patch: np.ndarray) -> np.ndarray:
        return self.f(patch)


def patch_contrast(ratio: float, bound: float = 1.0) -> OfPatch:
    """contrast() of a patch: the mean runs along its first spatial axis."""

    def run(x: np.ndarray) -> np.ndarray:
        y = ratio * x + (1 - ratio) * x.mean(axis=-3, keepdims=True)
        return np.clip(np.nan_to_num(y, nan=0.0, posinf=bound, neginf=0.0), 0.0, bound)

    return OfPatch(run)


def patch_blur(size: int = 3, sigma: float = 0.1, dim: int = 2) -> OfPatch:
    """A Gaussian blur of a patch's last axes with replicated borders."""
    kernel, arm = gaussian_kernel(size, sigma, dim), size // 2

    def run(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, [(0, 0)] * (x.ndim - dim) + [(arm, arm)] * dim, mode="edge")
        parts = (w * wide[(..., *(slice(arm + o, arm + o + n) for o, n in zip(at, x.shape[-dim:], strict=True)))] for at, w in kernel)
        return sum(parts, np.zeros_like(x, dtype=float))

    return OfPatch(run)


def chained(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The steps one after another, as one transform; steps of whole patches make one of whole patches, and do not mix with others."""
    whole = [isinstance(step, OfPatch) for step in steps]
    if any(whole):
        if not all(whole):
            raise ValueError("transforms of values and of whole patches do not mix in one source")
        return OfPatch(lambda patch: reduce(lambda x, step: step(x), steps, patch))

    def run(v: Column) -> Column:
        for step in steps:
            v = step(v)
        return v

    return run


def raw_default() -> Callable[[Column], Column]:
    """What raw arrays get unless told otherwise: doubles, which are not rescaled as they are no integers, and NaN as 0."""
    return chained(lambda v: v.cast("double"), nan_to_num(0.0))


def target_default() -> Callable[[Column], Column]:
    """What targets get unless told otherwise: 1 above 0, NaN kept."""
    return chained(lambda v: v.cast("double"), binarize(0.0))


def add_noise(v: Column, z: Column, mean: float = 0.0, std: float = 0.1) -> Column:
    return v + mean + std * z


def contrast(v: Column, mean: Column, ratio: Column, bound: float = 1.0) -> Column:
    """ratio * v + (1 - ratio) * mean over the first axis, clamped to [0, bound]."""
    x = ratio * v + (1 - ratio) * mean
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(finite_or_bound(x, bound), F.lit(0.0)), F.lit(bound)))


def finite_or_bound(x: Column, bound: float) -> Column:
    return F.when(x == float("inf"), F.lit(bound)).when(x == float("-inf"), F.lit(0.0)).otherwise(x)


def gamma(v: Column, exponent: Column, full: float | None = None) -> Column:
    """clamp(v ** exponent, 0, 1), NaN as 0; full divides stored integers first."""
    x = F.pow(v / full if full else v, exponent)
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def gaussian_kernel(size: int = 3, sigma: float = 0.1, dim: int = 2) -> list[tuple[tuple[int, ...], float]]:
    """[(offsets, weight)] of an isotropic kernel whose weights sum to 1; the size is odd, the dimension 2 or 3."""
    import itertools
    import math

    if size % 2 == 0 or dim not in (2, 3):
        raise ValueError("the kernel size must be odd and dim 2 or 3")
    offsets = list(itertools.product(range(-(size // 2), size // 2 + 1), repeat=dim))
    raw = [math.exp(-sum(o * o for o in c) / (2 * sigma * sigma)) for c in offsets]
    return [(c, w / sum(raw)) for c, w in zip(offsets, raw, strict=True)]
