"""Spatial transforms. Nearest resampling, mirror, transpose, crop and enforced shape remap indices in voxel form (dz, dy, dx, v);
linear resampling and rotation work on patches as NumPy arrays.

The order is fixed: pad, resample, rotate, crop, mirror, transpose, enforce shape.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform

NAN = float("nan")


def nearest_source(i: Column, size_in: int, size_out: int) -> Column:
    return F.least(F.floor(i * size_in / size_out), F.lit(size_in - 1))


def linear_taps(size_in: int, size_out: int) -> list[tuple[int, int, int, float]]:
    """(out, lower in, upper in, weight of the upper) with half-pixel centres."""
    out = []
    for o in range(size_out):
        r = max(0.0, (o + 0.5) * size_in / size_out - 0.5)
        i = min(int(r), size_in - 1)
        out.append((o, i, min(i + 1, size_in - 1), r - i))
    return out


def resample_nearest(patch: DataFrame, keys: list[str], shape_in: tuple[int, ...], shape_out: tuple[int, ...]) -> DataFrame:
    """A row for each output voxel: keys, dz, dy, dx, v."""
    from .scan import offsets

    ids = patch.select(*keys).distinct().withColumn("_o", F.explode(offsets(shape_out))).select(*keys, *[F.col(f"_o.d{a}").alias(f"o{a}") for a in "zyx"])
    for a, i, o in zip("zyx", shape_in, shape_out, strict=True):
        ids = ids.withColumn(f"d{a}", nearest_source(F.col(f"o{a}"), i, o).cast("int"))
    got = ids.join(patch, [*keys, "dz", "dy", "dx"])
    return got.select(*keys, *[F.col(f"o{a}").alias(f"d{a}") for a in "zyx"], "v")


def resample_linear(patch: DataFrame, keys: list[str], shape_in: tuple[int, ...], shape_out: tuple[int, ...]) -> DataFrame:
    """Separable: each axis is a join of the voxels with the two taps that its outputs have, as a literal array, and a sum."""
    for a, i, o in zip("zyx", shape_in, shape_out, strict=True):
        use: dict[int, list[tuple[int, float]]] = {k: [] for k in range(i)}
        for out, low, high, w in linear_taps(i, o):
            use[low].append((out, 1 - w))
            use[high].append((out, w))
        taps = F.array(*[F.array(*[F.struct(F.lit(k).alias("o"), F.lit(w).alias("w")) for k, w in use[s]]) if use[s] else F.array().cast("array<struct<o:int,w:double>>") for s in range(i)])
        others = [f"d{b}" for b in "zyx" if b != a]
        patch = patch.withColumn("_tap", F.explode(F.get(taps, F.col(f"d{a}").cast("int")))).groupBy(*keys, *others, F.col("_tap.o").alias(f"d{a}")).agg(F.sum(F.col("v") * F.col("_tap.w")).alias("v"))
    return patch.select(*keys, "dz", "dy", "dx", "v")


def mirror(patch: DataFrame, shape: tuple[int, ...], flags: dict[str, Column | bool]) -> DataFrame:
    cols = {f"d{a}": F.when(flags[a] if isinstance(flags[a], Column) else F.lit(flags[a]), n - 1 - F.col(f"d{a}")).otherwise(F.col(f"d{a}")) for a, n in zip("zyx", shape, strict=True) if a in flags}
    return patch.withColumns(cols)


def transpose(patch: DataFrame, perm: tuple[int, int, int]) -> DataFrame:
    """Output axis i is input axis perm[i]."""
    names = ["dz", "dy", "dx"]
    return patch.withColumns({names[i]: F.col(names[p]) for i, p in enumerate(perm)})


def centre_crop(patch: DataFrame, shape: tuple[int, ...], target: tuple[int, ...]) -> DataFrame:
    for a, n, t in zip("zyx", shape, target, strict=True):
        if n > t:
            low = (n - t) // 2
            patch = patch.withColumn(f"d{a}", F.col(f"d{a}") - low).where((F.col(f"d{a}") >= 0) & (F.col(f"d{a}") < t))
    return patch


def enforce_shape(patch: DataFrame, keys: list[str], shape: tuple[int, ...], target: tuple[int, ...], pad_value: float = NAN) -> DataFrame:
    """Centre-crop axes that are too long, pad the others on both sides, the odd voxel at the end."""
    from .scan import offsets

    patch = centre_crop(patch, shape, target)
    for a, n, t in zip("zyx", shape, target, strict=True):
        if n < t:
            patch = patch.withColumn(f"d{a}", F.col(f"d{a}") + (t - n) // 2)
    ids = patch.select(*keys).distinct().withColumn("_o", F.explode(offsets(target))).select(*keys, "_o.*")
    return ids.join(patch, [*keys, "dz", "dy", "dx"], "left").select(*keys, "dz", "dy", "dx", F.coalesce("v", F.lit(pad_value)).alias("v"))


def rotation_matrix(degrees: dict[str, float], axes: str = "zyx") -> np.ndarray | None:
    """The product, in the order given, of rotations about each axis in the plane of the other two; None for the identity."""
    out = np.eye(len(axes))
    for axis, angle in degrees.items():
        i, j = (k for k, a in enumerate(axes) if a != axis)
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        one = np.eye(len(axes))
        one[i, i], one[i, j], one[j, i], one[j, j] = c, -s, s, c
        out = out @ one
    return None if np.allclose(out, np.eye(len(axes))) else out


def drawn(samples: DataFrame, key: str, config: dict, seed: int = 0, epoch: int = 0, axes: str = "zyx") -> DataFrame:
    """samples with mirror_<axis> (boolean), perm (an order of the axes) and angle_<axis> (degrees), as far as config asks for them.

    config: mirror, a probability by axis (or {"axes": ..}; anything else that is true is 0.5 for all); transpose; rotate, a pair
    or a largest angle by axis. All sources of a sample share its row, and hash draws make reruns agree.
    """
    u = lambda *parts: uniform(seed, epoch, key, *map(F.lit, parts))
    of = lambda c: c.get("axes", c) if isinstance(c, dict) else None
    out = samples
    if config.get("mirror"):
        odds = of(config["mirror"])
        for a, p in (odds if isinstance(odds, dict) else dict.fromkeys(axes, 0.5)).items():
            out = out.withColumn(f"mirror_{a}", u("mirror", a) < float(p))
    if config.get("transpose"):
        order = F.array_sort(F.array(*[F.struct(u("transpose", a).alias("u"), F.lit(i).alias("i")) for i, a in enumerate(axes)]))
        out = out.withColumn("perm", F.transform(order, lambda x: x["i"]))
    angles = of(config.get("rotate"))
    for a, most in (angles if isinstance(angles, dict) else {}).items():
        low, high = most if isinstance(most, list | tuple) else (-most, most)
        out = out.withColumn(f"angle_{a}", F.lit(float(low)) + (float(high) - float(low)) * u("rotate", a))
    return out


def turn_of(samples: DataFrame, axes: str = "zyx") -> Column:
    """What drawn() has given a sample, as patches.TURN: the matrix of its angles in their order, its flags and its order of axes."""
    null = lambda kind: F.lit(None).cast(f"array<{kind}>")
    have = samples.columns
    product = None
    for axis in [c[6:] for c in have if c.startswith("angle_")]:
        i, j = (k for k, a in enumerate(axes) if a != axis)
        c, s = F.cos(F.radians(f"angle_{axis}")), F.sin(F.radians(f"angle_{axis}"))
        one = [[F.lit(1.0 if a == b else 0.0) for b in range(3)] for a in range(3)]
        one[i][i], one[i][j], one[j][i], one[j][j] = c, -s, s, c
        product = one if product is None else [[product[a][0] * one[0][b] + product[a][1] * one[1][b] + product[a][2] * one[2][b] for b in range(3)] for a in range(3)]
    matrix = null("double") if product is None else F.array(*[x for row in product for x in row])
    flags = F.array(*[F.coalesce(F.col(f"mirror_{a}"), F.lit(False)) if f"mirror_{a}" in have else F.lit(False) for a in axes])
    mirror = flags if any(c.startswith("mirror_") for c in have) else null("boolean")
    return F.struct(matrix.alias("matrix"), mirror.alias("mirror"), (F.col("perm") if "perm" in have else null("int")).alias("perm"))


def rotate(data: np.ndarray, matrix: np.ndarray, mode: str = "nearest", pad_value: float = NAN, convention: str = "reference") -> np.ndarray:
    """Sample a patch (z, y, x) at the rotated places of its voxels in coordinates that run from -1 to 1 along each axis.

    `reference` applies the matrix to coordinates ordered x, y, z; `world` applies it to z, y, x, as the matrix is named. Places
    outside read 0, and pad_value where a coordinate leaves [-1, 1], unless pad_value is 0.
    """
    shape = np.array(data.shape)
    base = np.stack(np.meshgrid(*[(2 * np.arange(n) + 1) / n - 1 for n in shape], indexing="ij"), -1)
    r = np.asarray(matrix, float)
    g = (base[..., ::-1] @ r)[..., ::-1] if convention == "reference" else base @ r
    at = ((g + 1) * shape - 1) / 2
    if mode == "nearest":
        taps = [(np.rint(at).astype(int), np.ones(data.shape))]
    else:
        low = np.floor(at).astype(int)
        f = at - low
        taps = []
        for corner in np.ndindex(2, 2, 2):
            c = np.array(corner)
            taps.append((low + c, np.prod(np.where(c == 1, f, 1 - f), -1)))
    out = np.zeros(data.shape, np.float64)
    for i, w in taps:
        inside = ((i >= 0) & (i < shape)).all(-1)
        i = np.clip(i, 0, shape - 1)
        out += np.where(inside, data[i[..., 0], i[..., 1], i[..., 2]] * w, 0.0)
    if pad_value != 0:
        out[(np.abs(g) > 1).any(-1)] = pad_value
    return out.astype(np.float32)


def resample_patch(data: np.ndarray, target: tuple[int, ...], mode: str = "nearest") -> np.ndarray:
    """The NumPy form of both resamplings."""
    if mode == "nearest":
        return data[np.ix_(*[np.minimum(np.arange(o) * i // o, i - 1) for i, o in zip(data.shape, target, strict=True)])]
    for axis, (i, o) in enumerate(zip(data.shape, target, strict=True)):
        _, low, high, w = map(np.array, zip(*linear_taps(i, o), strict=True))
        w = w.reshape([-1 if k == axis else 1 for k in range(data.ndim)])
        data = np.take(data, low, axis) * (1 - w) + np.take(data, high, axis) * w
    return data


def blur(patch: DataFrame, keys: list[str], shape: tuple[int, ...], kernel: list[tuple[tuple[int, ...], float]]) -> DataFrame:
    """Weighted sum over a kernel's offsets with replicated borders. Each voxel sends its value to the outputs that use it,
    so no self-join is needed: output o uses clamp(o + c); all o with that source are emitted for each offset c."""
    dims = len(kernel[0][0])
    axes = ["dz", "dy", "dx"][3 - dims :]
    sizes = dict(zip(["dz", "dy", "dx"], shape, strict=True))
    arms = F.array(*[F.struct(*[F.lit(o).alias(a) for a, o in zip(axes, c, strict=True)], F.lit(w).alias("w")) for c, w in kernel])
    out = patch.withColumn("_arm", F.explode(arms))
    for a in axes:
        n, c = sizes[a], F.col(f"_arm.{a}")
        low = F.when(F.col(a) == 0, F.lit(0)).otherwise(F.col(a) - c)
        high = F.when(F.col(a) == n - 1, F.lit(n - 1)).otherwise(F.col(a) - c)
        low, high = F.greatest(F.least(low, F.col(a) - c), F.lit(0)), F.least(F.greatest(high, F.col(a) - c), F.lit(n - 1))
        out = out.withColumn(f"o_{a}", F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))).withColumn(f"o_{a}", F.explode(f"o_{a}"))
    kept = [a for a in ("dz", "dy", "dx") if a not in axes]
    return out.groupBy(*keys, *kept, *[F.col(f"o_{a}").alias(a) for a in axes]).agg(F.sum(F.col("v") * F.col("_arm.w")).alias("v")).select(*keys, "dz", "dy", "dx", "v")
