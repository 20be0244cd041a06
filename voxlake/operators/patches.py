"""Patches of stored and of relational volumes, each made in one Arrow pass: read, pad, resample, rotate, crop, mirror, transpose, fit.

A request is a row: which sample and source it is for, where its window starts, and the form that its patch gets. Requests of any number
of volumes, levels and sources are one relation, so a plan has the same size for a thousand datasets as for one.

Stored volumes: requests are laid out by the chunk in which they begin, so that neighbours meet in a task; that is the one
shuffle, and it moves requests, not voxels. The task opens the chunks that a window touches and keeps the last ones, up to a bound.
The sample is part of the layout's key, so a chunk that many windows touch is spread like any other.

Relational volumes (`scan.chunked`): requests are joined by equality on the chunk key, and the chunks of a patch meet in its task.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from ..sources import ngff
from . import spatial

AXES = "zyx"
NAN = float("nan")
FORM = "struct<out:array<int>,resample:boolean,mode:string,pad:boolean,fill:float>"
#: Transforms of a sample, NULL for none: a matrix row by row, a flag and a place for each axis.
TURN = "struct<matrix:array<double>,mirror:array<boolean>,perm:array<int>>"
PATCH = "sample bigint, source string, shape array<int>, data array<float>"
#: What a sample may carry to its patches, so that no patch has to meet its sample again.
CARRIED = {"dataset": ("int", pa.int32()), "index": ("bigint", pa.int64())}
#: Bytes of decoded chunks that a task keeps, and of patches that it makes, about.
CACHE_BYTES, TASK_BYTES = 64 << 20, 256 << 20


def vector(values, kind: str = "double") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def form(out: list[int] | tuple[int, ...], resample: bool | Column, mode: str, pad: bool, fill: float) -> Column:
    resample = resample if isinstance(resample, Column) else F.lit(resample)
    return F.struct(vector(out, "int").alias("out"), resample.alias("resample"), F.lit(mode).alias("mode"), F.lit(pad).alias("pad"), F.lit(fill).cast("float").alias("fill"))


def read_sizes(out: Column, scale: Column, voxel: Column, matrix: Column | None = None) -> Column:
    """Stored voxels along each axis that cover an output, and those that its rotation wants besides: ceil(base_i sum_j |R_ij|)."""
    base = F.transform(F.arrays_zip(out.alias("n"), scale.alias("s"), voxel.alias("v")), lambda x: F.greatest(F.lit(1), F.bround(x["n"] * x["s"] / x["v"]).cast("int")))
    if matrix is None:
        return base
    wide = F.transform(base, lambda b, i: F.ceil(b * F.aggregate(F.slice(matrix, i * 3 + 1, F.lit(3)), F.lit(0.0), lambda a, r: a + F.abs(r))).cast("int"))
    return F.when(matrix.isNull(), base).otherwise(wide)


def starts(centre: Column, origin: Column, voxel: Column, read: Column) -> Column:
    """The first voxel of a window about a centre: floored."""
    return F.transform(F.arrays_zip(centre.alias("c"), origin.alias("o"), voxel.alias("v"), read.alias("n")), lambda x: F.floor((x["c"] - x["o"]) / x["v"] - x["n"] / 2).cast("bigint"))


def differs(voxel: Column, scale: Column) -> Column:
    """Whether a level is resampled: some axis is off by more than 1 %."""
    return F.exists(F.arrays_zip(voxel.alias("v"), scale.alias("s")), lambda x: F.abs(x["v"] - x["s"]) / F.greatest(x["s"], F.lit(1e-9)) > 0.01)


def valid(start: list[int], read: list[int], stored: list[int]) -> list[tuple[int, int]]:
    """The part [from, to) of a window that a volume holds, in places of the window."""
    out = []
    for s, n, m in zip(start, read, stored, strict=True):
        low = max(0, min(n, -s))
        out.append((low, max(low, min(n, m - s))))
    return out


def fitted(data: np.ndarray, target: list[int], fill: float) -> np.ndarray:
    """The last axes cut about their centre where they are too long, and padded on both sides where short, the odd voxel at the end."""
    n = len(target)
    cut = [slice(None)] * (data.ndim - n)
    pads = [(0, 0)] * (data.ndim - n)
    for have, want in zip(data.shape[-n:], target, strict=True):
        low = max(0, (have - want) // 2)
        cut.append(slice(low, low + min(have, want)))
        lack = max(0, want - have)
        pads.append((lack // 2, lack - lack // 2))
    data = data[tuple(cut)]
    return np.pad(data, pads, constant_values=fill) if any(p != (0, 0) for p in pads) else data


def finished(data: np.ndarray, how: dict, turn: dict | None, kind: type = np.float32) -> np.ndarray:
    """A window's voxels in the form asked for. data has any leading axes before the last three.

    A centre crop of a turned patch that is smaller than the output (it was not padded) takes what is there.
    """
    out, fill = how["out"], how["fill"]
    lead = data.shape[:-3]
    blocks = data.reshape((math.prod(lead), *data.shape[-3:]))
    if how["resample"] and blocks.size:
        blocks = np.stack([spatial.resample_patch(b, tuple(out), how["mode"]) for b in blocks])
    turn = turn or {}
    if turn.get("matrix"):
        matrix = np.reshape(turn["matrix"], (3, 3))
        blocks = np.stack([spatial.rotate(b, matrix, "nearest" if how["mode"] == "nearest" else "linear", fill) for b in blocks]) if blocks.size else blocks
        blocks = blocks[(slice(None), *(slice((n - t) // 2, (n - t) // 2 + t) if n > t else slice(None) for n, t in zip(blocks.shape[1:], out, strict=True)))]
    if turn.get("mirror"):
        blocks = np.flip(blocks, [1 + i for i, f in enumerate(turn["mirror"]) if f])
    if turn.get("perm"):
        blocks = blocks.transpose(0, *(1 + p for p in turn["perm"]))
    if list(blocks.shape[1:]) != list(out):
        blocks = fitted(blocks, out, fill)
    return np.ascontiguousarray(blocks, kind).reshape((*lead, *out))


def window_of(how: dict, start: list[int], read: list[int], stored: list[int], lead: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An empty patch, and the part of the window that it stands for: all of it if padded, else what the volume holds."""
    part = [(0, n) for n in read] if how["pad"] else valid(start, read, stored)
    return np.full((*lead, *(b - a for a, b in part)), how["fill"], np.float32), part


def copied(patch: np.ndarray, part: list[tuple[int, int]], block: np.ndarray, low: list[int], lead: tuple[int, ...] = ()) -> None:
    """Copy a block that begins at `low` of the window, and at `lead` of the leading axes, into a patch."""
    into = [slice(i, i + n) for i, n in zip(lead, block.shape[: len(lead)], strict=True)]
    of: list[slice] = [slice(None)] * len(lead)
    for at, n, (a, b) in zip(low, block.shape[len(lead) :], part, strict=True):
        first, last = max(at, a), min(at + n, b)
        if last <= first:
            return
        into.append(slice(first - a, last - a))
        of.append(slice(first - at, last - at))
    patch[tuple(into)] = block[tuple(of)]


class Stored:
    """The chunks of stored arrays that a task has opened, the last ones of them."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held, self.size, self.opened = most, OrderedDict(), 0, 0

    def chunk(self, folder: str, meta: dict, name: str) -> np.ndarray:
        key = (folder, name)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        found = ngff.read_chunk(folder, meta, name)
        self.opened += 1
        self.held[key] = found
        self.size += found.nbytes
        while self.size > self.most and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return found

    def window(self, folder: str, meta: dict, how: dict, start: list[int], read: list[int]) -> np.ndarray:
        """Leading axes are taken whole."""
        shape, chunks = meta["shape"], meta["chunks"]
        n = min(3, len(shape))
        stored, size = ngff.spatial(shape[-n:], 1), ngff.spatial(chunks[-n:], 1)
        ahead, ahead_size = shape[:-n], chunks[:-n]
        patch, part = window_of(how, start, read, stored, tuple(ahead))
        ranges = [range((s + a) // c, -(-(s + b) // c)) for s, c, (a, b) in zip(start, size, valid(start, read, stored), strict=True)]
        if patch.size and all(b > a for a, b in valid(start, read, stored)):
            for lead in np.ndindex(*[-(-m // c) for m, c in zip(ahead, ahead_size, strict=True)]):
                for key in np.ndindex(*map(len, ranges)):
                    at = [r[i] for r, i in zip(ranges, key, strict=True)]
                    block = self.chunk(folder, meta, ngff.chunk_name(meta, lead, at))
                    block = block.reshape((*block.shape[:-n], *ngff.spatial(list(block.shape[-n:]), 1)))
                    begin = [i * c for i, c in zip(lead, ahead_size, strict=True)]
                    ends = [min(c, m - b) for c, m, b in zip(ahead_size, ahead, begin, strict=True)] + [min(c, m - i * c) for c, m, i in zip(size, stored, at, strict=True)]
                    copied(patch, part, block[tuple(slice(0, e) for e in ends)], [i * c - s for i, c, s in zip(at, size, start, strict=True)], tuple(begin))
        return patch


def rows_of(made: list[tuple], kind: type = np.float32, carried: tuple[str, ...] = ()) -> pa.RecordBatch:
    """(sample, source, patch, what else is carried) as rows."""
    ends = np.cumsum([0, *(m[2].size for m in made)])
    values = pa.array(np.concatenate([m[2].ravel() for m in made]) if made else np.zeros(0, kind), pa.from_numpy_dtype(kind))
    shapes = pa.array([[int(n) for n in m[2].shape] for m in made], pa.list_(pa.int32()))
    more = [pa.array([m[3 + i] for m in made], CARRIED[c][1]) for i, c in enumerate(carried)]
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), shapes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), *more], ["sample", "source", "shape", "data", *carried])


def schema_of(carried: tuple[str, ...]) -> str:
    return ", ".join([PATCH, *(f"{c} {CARRIED[c][0]}" for c in carried)])


Transform = Callable[[np.ndarray], np.ndarray] | dict[str, Callable[[np.ndarray], np.ndarray]] | None


def transformed(patch: np.ndarray, source: str, transform: Transform) -> np.ndarray:
    """A patch under the function for all sources, or for its own."""
    f = transform.get(source) if isinstance(transform, dict) else transform
    return patch if f is None else np.asarray(f(patch), np.float32)


def read_stored(requests: DataFrame, n_partitions: int = 0, transform: Transform = None) -> DataFrame:
    """requests (sample, source, folder, meta, start, read, form, turn) of stored arrays to patches (sample, source, shape, data).

    Columns of CARRIED go along. A request without a folder is one of a class that nobody annotated: NaN, under no transform. transform: a function of a whole patch, or
    one by source. The layout has n_partitions, or as many as the session's shuffles: always a number, as adaptive execution would put these
    short rows into one task and not see that each becomes a patch.
    """
    importable(requests.sparkSession)
    kind = requests.schema["turn"].dataType.simpleString() if "turn" in requests.columns else TURN
    carried = tuple(c for c in CARRIED if c in requests.columns)
    rows = requests if "turn" in requests.columns else requests.withColumn("turn", F.lit(None).cast(TURN))
    begin = ngff.array_of(F.col("meta"))["chunks"]
    first = [F.floor(F.greatest(F.get("start", F.lit(i)), F.lit(0)) / F.greatest(F.coalesce(F.try_element_at(begin, F.lit(i - 3)), F.lit(1)), F.lit(1))).alias(f"_{a}") for i, a in enumerate(AXES)]
    rows = rows.select("sample", "source", "folder", "meta", "start", "read", "form", F.col("turn").cast(kind).alias("turn"), *carried, *first)
    order = ["folder", "_z", "_y", "_x", "sample"]
    n_partitions = n_partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n_partitions, *order).sortWithinPartitions(*order).drop("_z", "_y", "_x")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        stored, metas = Stored(), {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["folder"] is None:  # nobody annotated it
                    yield r["sample"], r["source"], np.full(r["form"]["out"], NAN, np.float32), *(r[c] for c in carried)
                    continue
                if r["meta"] not in metas:
                    metas[r["meta"]] = json.loads(r["meta"])
                window = stored.window(r["folder"], metas[r["meta"]], r["form"], r["start"], r["read"])
                yield r["sample"], r["source"], transformed(finished(window, r["form"], r["turn"]), r["source"], transform), *(r[c] for c in carried)

    return rows.mapInArrow(lambda batches: batched(made(batches), carried=carried), schema_of(carried))


def partitions_for(spark: SparkSession, n_patches: int, shape: tuple[int, ...]) -> int:
    """So many tasks that each makes some TASK_BYTES of patches at most, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_patches * math.prod(shape) * 4 / TASK_BYTES))


def batched(made: Iterator[tuple], kind: type = np.float32, carried: tuple[str, ...] = (), most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Patches as batches of some bytes."""
    out, size = [], 0
    for one in made:
        out.append(one)
        size += one[2].nbytes
        if size > most:
            yield rows_of(out, kind, carried)
            out, size = [], 0
    if out:
        yield rows_of(out, kind, carried)


def read_relation(requests: DataFrame, chunks: DataFrame, chunk: tuple[int, int, int], transform: Transform = None) -> DataFrame:
    """requests (sample, source, volume_id, stored, start, read, form, turn) over scan.chunked() chunks to patches.

    stored is the volume's shape; axes before its last three are whole in each chunk. A window that touches no chunk has its row
    too. Places that no chunk names are filled. One join on the chunk key and one shuffle of the chunks that windows touch.
    """
    importable(requests.sparkSession)
    rows = requests if "turn" in requests.columns else requests.withColumn("turn", F.lit(None).cast(TURN))
    carried = tuple(c for c in CARRIED if c in requests.columns)
    ids = rows.select("sample", "source", "volume_id", "stored", "start", "read", "form", "turn", *carried)
    for i, (a, c) in enumerate(zip(AXES, chunk, strict=True)):
        at, n, m = F.get("start", F.lit(i)), F.get("read", F.lit(i)), F.element_at("stored", i - 3)
        low, high = F.floor(F.greatest(at, F.lit(0)) / c), F.floor((F.least(at + n, m) - 1) / c)
        ids = ids.withColumn(f"c{a}", F.explode_outer(F.when(high >= low, F.sequence(low, high)))).withColumn(f"c{a}", F.col(f"c{a}").cast("int"))
    met = ids.join(chunks.select("volume_id", "cz", "cy", "cx", "shape", "at", "data"), ["volume_id", "cz", "cy", "cx"], "left")
    key = ["sample", "source"]
    rest = ["cz", "cy", "cx", "stored", "start", "read", "form", "turn", *carried, "shape", "at", "data"]
    met = met.repartition(*key).sortWithinPartitions(*key).select(*key, *rest)

    def patches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, patch, part, how = None, None, None, None
        for batch in batches:
            blocks, places = ngff.arrays_of(batch.column("data")), ngff.arrays_of(batch.column("at"))
            for r, block, places_of in zip(batch.drop_columns(["data", "at"]).to_pylist(), blocks, places, strict=True):
                if (r["sample"], r["source"]) != last:
                    if last is not None:
                        yield *last, transformed(finished(patch, how["form"], how["turn"]), last[1], transform), *(how[c] for c in carried)
                    last, how = (r["sample"], r["source"]), r
                    patch, part = window_of(r["form"], r["start"], r["read"], r["stored"][-3:], tuple(r["stored"][:-3]))
                if block is None:
                    continue
                if places_of is not None:
                    values, block = block, np.full(math.prod(r["shape"]), r["form"]["fill"], np.float32)
                    block[places_of] = values
                low = [k * c - s for k, c, s in zip((r["cz"], r["cy"], r["cx"]), chunk, r["start"], strict=True)]
                copied(patch, part, block.reshape(r["shape"]), low, (0,) * (patch.ndim - 3))
        if last is not None:
            yield *last, transformed(finished(patch, how["form"], how["turn"]), last[1], transform), *(how[c] for c in carried)

    return met.mapInArrow(lambda batches: batched(patches_of(batches), carried=carried), schema_of(carried))


def finish(rows: DataFrame, double: bool = False) -> DataFrame:
    """What comes after reading, over windows that are there: rows (sample, source, shape, data, form, and turn) to patches.

    double keeps the values' precision, which patches of the readers do not.
    """
    importable(rows.sparkSession)
    kind = np.float64 if double else np.float32
    more = ["turn"] if "turn" in rows.columns else []

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r, data in zip(batch.drop_columns(["data"]).to_pylist(), ngff.arrays_of(batch.column("data")), strict=True):
                yield r["sample"], r["source"], finished(data.astype(kind).reshape(r["shape"]), r["form"], r.get("turn"), kind)

    return rows.select("sample", "source", "shape", "data", "form", *more).mapInArrow(lambda b: batched(made(b), kind), PATCH.replace("array<float>", "array<double>") if double else PATCH)


def as_voxels(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Patches to a row for each voxel: keys, channel, dz, dy, dx, v; channel runs over the leading axes in C order."""
    n = lambda i: F.element_at("shape", i)
    i, plane = F.col("_i"), n(-1) * n(-2)
    cells = patches.select(*keys, "shape", F.posexplode("data").alias("_i", "v"))
    return cells.select(*keys, F.expr("cast(_i div (element_at(shape, -1) * element_at(shape, -2) * element_at(shape, -3)) as int)").alias("channel"), F.pmod(F.floor(i / plane), n(-3)).cast("int").alias("dz"), F.pmod(F.floor(i / n(-1)), n(-2)).cast("int").alias("dy"), F.pmod(i, n(-1)).cast("int").alias("dx"), F.col("v").cast("double").alias("v"))


def applied(patches: DataFrame, transform: Transform) -> DataFrame:
    """A function of whole patches, or one by source, over patches (sample, source, shape, data) in Arrow batches."""
    importable(patches.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for sample, source, shape, data in zip(*(batch.column(c).to_pylist() for c in ("sample", "source", "shape")), ngff.arrays_of(batch.column("data")), strict=True):
                yield sample, source, transformed(data.astype(np.float32).reshape(shape), source, transform)

    return patches.select("sample", "source", "shape", "data").mapInArrow(lambda batches: batched(run(batches)), PATCH)
