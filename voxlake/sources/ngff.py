"""A Python data source `ngff` for zarr v2 arrays of any rank with multiscale attributes: chunks as rows, volumes written from rows.

A chunk's key is its place along the last three axes (cz, cy, cx; 0 for an axis that the array lacks) and `lead`, its places along the
axes before them. Rows: volume_id, level, cz, cy, cx, z0, y0, x0, shape (all axes), data (C order), lead.

Reading: options path (a group or array folder), level (a dataset's path, or nothing for all), volume_id. Each partition is a run of
chunk keys. Comparisons of level, cz, cy and cx with constants are pushed down: chunks that they rule out are not opened.
Supported compressors: none, blosc, zlib, gzip, bz2, lzma and zstd; others raise an error that names them.

Writing: rows of that form, each a whole chunk, or its first corner, or, with a column `at`, the values of those places of it. Options path, shape, chunks, voxel_size and origin
as comma-separated numbers, dtype (float32), unit, level (s0). Chunks go to a staging folder; when all tasks have succeeded, they take the
place of the old array (overwrite) or of single chunks of it (append, which wants an array of the same form); when one
fails, the staging folder goes and the old array stays as it was. Paths are on a file system that driver and executors share.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import math
import os
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..session import importable
from . import blosc

SCHEMA = "volume_id string, level string, cz int, cy int, cx int, z0 int, y0 int, x0 int, shape array<int>, data array<float>, lead array<int>"
KEY = ("cz", "cy", "cx")
#: Arrow batches are bounded by bytes, as a row holds a chunk.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


DECODERS = {"blosc": blosc.decode, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _zstd}


def local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def read_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def level_paths(group: str) -> list[str]:
    """Folders of a group's arrays in the order of its attributes; the folder itself if it is an array."""
    if os.path.exists(f"{group}/.zarray"):
        return [""]
    return [d["path"] for d in read_json(f"{group}/.zattrs")["multiscales"][0]["datasets"]]


def spatial(xs: list[int], absent: int) -> list[int]:
    """The last three entries of a list with one for each axis; `absent` for axes that the array lacks."""
    return [absent] * (3 - len(xs)) + list(xs[-3:])


def arrays_of(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of an Arrow column as arrays that share its memory; None for null."""
    values, ends, there = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], there, strict=True)]


def chunk_name(meta: dict, lead: Iterable[int], key: Iterable[int]) -> str:
    n = len(meta["shape"])
    return meta.get("dimension_separator", ".").join(str(int(i)) for i in [*lead, *[*key][-min(3, n) :]])


def read_chunk(folder: str, meta: dict, name: str) -> np.ndarray:
    """A chunk as stored (edge chunks are stored whole), or the fill value where there is no file."""
    path = f"{folder}/{name}"
    dtype = np.dtype(meta["dtype"])
    if not os.path.exists(path):
        fill = meta["fill_value"]
        return np.full(meta["chunks"], float(fill) if isinstance(fill, str) else fill or 0, dtype)
    with open(path, "rb") as f:
        raw = f.read()
    if meta.get("filters"):
        raise ValueError(f"filters are not supported: {meta['filters']}")
    if kind := (meta.get("compressor") or {}).get("id"):
        if kind not in DECODERS:
            raise ValueError(f"compressor {kind!r} is not supported; use one of {', '.join(DECODERS)} or none")
        raw = DECODERS[kind](raw)
    return np.frombuffer(raw, dtype).reshape(meta["chunks"], order=meta.get("order", "C"))


def grid_of(meta: dict) -> list[int]:
    return [-(-n // c) for n, c in zip(meta["shape"], meta["chunks"], strict=True)]


class Chunks(D.InputPartition):
    """The chunks [first, last) in C order of the keys that `along` has for each axis."""

    def __init__(self, folder: str, level: str, along: list[range | list[int]], first: int, last: int):
        self.folder, self.level, self.along, self.first, self.last = folder, level, along, first, last


class NgffReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.level = local(options["path"]), options.get("level")
        self.volume, self.run = options.get("volume_id") or os.path.basename(self.path), int(options.get("chunksperpartition", 64))
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        kinds = (D.EqualTo, D.In, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)
        for f in filters:
            if isinstance(f, kinds) and f.attribute in [(k,) for k in (*KEY, "level")]:
                self.filters.append(f)
            elif not (isinstance(f, D.IsNotNull) and f.attribute in [(k,) for k in (*KEY, "level")]):
                yield f

    def _kept(self, name: str, values: Iterable) -> list:
        """The values that all filters on the column leave."""
        holds = {D.EqualTo: lambda x, v: x == v, D.In: lambda x, v: x in v, D.GreaterThan: lambda x, v: x > v, D.GreaterThanOrEqual: lambda x, v: x >= v, D.LessThan: lambda x, v: x < v, D.LessThanOrEqual: lambda x, v: x <= v}
        mine = [f for f in self.filters if f.attribute == (name,)]
        return [x for x in values if all(holds[type(f)](x, f.value) for f in mine)]

    def partitions(self) -> list[Chunks]:
        out = []
        for level in self._kept("level", level_paths(self.path)):
            if self.level in (None, level):
                folder = f"{self.path}/{level}".rstrip("/")
                grid = grid_of(read_json(f"{folder}/.zarray"))
                n = min(3, len(grid))
                if any(not self._kept(k, [0]) for k in KEY[: 3 - n]):
                    continue
                along = [*map(range, grid[:-n]), *(self._kept(k, range(g)) for k, g in zip(KEY[3 - n :], grid[-n:], strict=True))]
                total = math.prod(map(len, along))
                out += [Chunks(folder, level, along, i, min(total, i + self.run)) for i in range(0, total, self.run)]
        return out

    def read(self, part: Chunks | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no chunk is left
            return
        meta = read_json(f"{part.folder}/.zarray")
        shape, chunks = meta["shape"], meta["chunks"]
        for flat in range(part.first, part.last):
            at = [int(k[i]) for k, i in zip(part.along, np.unravel_index(flat, [*map(len, part.along)]), strict=True)]
            start = [i * c for i, c in zip(at, chunks, strict=True)]
            lead, key = at[:-3], spatial(at, 0)
            data = read_chunk(part.folder, meta, chunk_name(meta, lead, key))[tuple(slice(0, min(c, n - s)) for c, n, s in zip(chunks, shape, start, strict=True))]
            values = np.ascontiguousarray(data, np.float32).ravel()
            cols = {"volume_id": pa.array([self.volume], pa.string()), "level": pa.array([part.level], pa.string())}
            cols |= {k: pa.array([v], pa.int32()) for k, v in zip((*KEY, "z0", "y0", "x0"), (*key, *spatial(start, 0)), strict=True)}
            cols["shape"] = pa.array([[int(n) for n in data.shape]], pa.list_(pa.int32()))
            cols["data"] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            cols["lead"] = pa.array([lead], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)


class Written(D.WriterCommitMessage):
    def __init__(self, chunks: int):
        self.chunks = chunks


class NgffWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        nums = lambda k, d: [float(x) for x in options.get(k, d).split(",")]
        self.path, self.level = local(options["path"]), options.get("level", "s0")
        if ".zarr" not in self.path:
            raise ValueError("the output path must hold .zarr")
        self.shape, self.chunks = [int(x) for x in nums("shape", "")], [int(x) for x in nums("chunks", "")]
        if len(self.shape) != len(self.chunks):
            raise ValueError(f"shape has {len(self.shape)} axes and chunks {len(self.chunks)}")
        self.voxel_size, self.origin = ([absent] * (len(self.shape) - len(x)) + x[-len(self.shape) :] for x, absent in ((nums("voxel_size", "1,1,1"), 1.0), (nums("origin", "0,0,0"), 0.0)))
        self.dtype, self.unit, self.overwrite = options.get("dtype", "float32"), options.get("unit", "nanometer"), overwrite
        self.array = {"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": np.dtype(self.dtype).str, "compressor": None, "fill_value": 0, "order": "C", "filters": None}
        self.final = f"{self.path}/{self.level}"
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        if not overwrite and os.path.exists(f"{self.final}/.zarray"):
            meta = read_json(f"{self.final}/.zarray")
            if (meta["shape"], meta["chunks"], np.dtype(meta["dtype"])) != (self.shape, self.chunks, np.dtype(self.dtype)) or meta.get("compressor"):
                raise ValueError("what is there differs in shape, chunks, dtype or compressor; overwrite it")
            self.array["dimension_separator"] = meta.get("dimension_separator", ".")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Whole chunks in the staging folder: where a row is smaller than its chunk, the rest is what an append finds there, or 0."""
        n = 0
        os.makedirs(self.staging, exist_ok=True)
        for batch in batches:
            values = arrays_of(batch.column("data"))
            places = arrays_of(batch.column("at")) if "at" in batch.schema.names else [None] * len(values)
            rest = batch.select([c for c in batch.schema.names if c not in ("data", "at")]).to_pylist()
            for row, data, at in zip(rest, values, places, strict=True):
                self._write(row, data, at)
                n += 1
        return Written(n)

    def _write(self, row: dict, data: np.ndarray, at: np.ndarray | None) -> None:
        lead = list(row.get("lead") or [])
        name = chunk_name(self.array, [0] * (len(self.shape) - 3 - len(lead)) + lead, [row[k] for k in KEY])
        whole = np.zeros(self.chunks, self.dtype) if self.overwrite else read_chunk(self.final, self.array, name).copy()
        if at is not None:
            whole.reshape(-1)[at] = data.astype(self.dtype)
        else:
            data = data.reshape(row["shape"])
            data = data.reshape(data.shape[-len(self.shape) :] if data.ndim > len(self.shape) else (1,) * (len(self.shape) - data.ndim) + data.shape)
            if any(a > b for a, b in zip(data.shape, self.chunks, strict=True)):
                raise ValueError(f"a row of shape {data.shape} is larger than a chunk of {self.chunks}")
            whole[tuple(slice(0, k) for k in data.shape)] = data.astype(self.dtype)
        self._put(name, whole)

    def _put(self, name: str, whole: np.ndarray) -> None:
        """A chunk's file; a task that runs twice leaves one whole chunk."""
        place = f"{self.staging}/{name}"
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(f"{place}.{uuid.uuid4().hex}.tmp", "wb") as f:
            f.write(whole.tobytes())
        os.replace(f.name, place)

    def commit(self, messages: list) -> None:
        os.makedirs(self.staging, exist_ok=True)
        for folder, _, names in os.walk(self.staging):
            for name in names:
                if name.endswith(".tmp"):  # of a task that was lost while it wrote
                    os.remove(f"{folder}/{name}")
        for name, value in ((".zarray", self.array), (".zattrs", {})):
            with open(f"{self.staging}/{name}", "w") as f:
                json.dump(value, f)
        if os.path.exists(self.final) and not self.overwrite:
            for folder, _, names in os.walk(self.staging):
                into = f"{self.final}/{os.path.relpath(folder, self.staging)}"
                os.makedirs(into, exist_ok=True)
                for name in names:
                    if name not in (".zarray", ".zattrs"):
                        os.replace(f"{folder}/{name}", f"{into}/{name}")
            shutil.rmtree(self.staging)
        else:
            old = f"{self.staging}-old"
            if os.path.exists(self.final):
                os.rename(self.final, old)
            os.makedirs(os.path.dirname(self.final), exist_ok=True)
            os.rename(self.staging, self.final)
            shutil.rmtree(old, ignore_errors=True)
        parts = self.path.split("/")
        first = next(i for i, p in enumerate(parts) if ".zarr" in p)
        for i in range(first, len(parts)):
            with open("/".join(parts[: i + 1]) + "/.zgroup", "w") as f:
                json.dump({"zarr_format": 2}, f)
        if self.overwrite or not os.path.exists(f"{self.path}/.zattrs"):
            n = len(self.shape)
            lead = [{"name": "c" if i == n - 4 else f"d{i}", "type": "channel" if i == n - 4 else "other"} for i in range(n - 3)]
            transforms = [{"type": "scale", "scale": self.voxel_size}, {"type": "translation", "translation": self.origin}]
            image = {"axes": lead + [{"name": a, "type": "space", "unit": self.unit} for a in "zyx"[-n:]], "datasets": [{"path": self.level, "coordinateTransformations": transforms}], "name": self.path.split(".zarr")[-1], "version": "0.4"}
            with open(f"{self.path}/.zattrs", "w") as f:
                json.dump({"multiscales": [image]}, f)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class NgffSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "ngff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NgffReader:
        return NgffReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NgffWriter:
        return NgffWriter(self.options, overwrite)


def register(spark) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    size = spark.conf.get(BATCH, None) or ""
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:  # chunks are large rows
        spark.conf.set(BATCH, str(BATCH_BYTES))
    spark.dataSource.register(NgffSource)


def read_attrs(path: str) -> str:
    """A group's attributes as JSON text, for operators.catalog.levels."""
    with open(f"{local(path)}/.zattrs") as f:
        return f.read()


def groups(paths: DataFrame) -> DataFrame:
    """paths (path, and any other columns) with `attrs`, `arrays` and `counts`: what executors find there, in one pass without a shuffle.

    attrs: the group's attributes as text, NULL where there is none; arrays: the description of each array by its path (that of the
    folder itself under ''); counts: the class counts kept in the attributes of an array, by path and class, joined by a tab.
    """

    def text(path: str) -> str | None:
        try:
            with open(path) as f:
                return f.read()
        except OSError:
            return None

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            attrs, arrays, counts = [], [], []
            for path in batch.column("path"):
                folder = local(path.as_py() or "")
                attrs.append(text(f"{folder}/.zattrs"))
                try:
                    names = level_paths(folder)
                except (OSError, ValueError, KeyError, IndexError, TypeError):
                    names = []
                found = {n: text(f"{folder}/{n}/.zarray") for n in names}
                arrays.append([(n, t) for n, t in found.items() if t])
                kept = {n: json.loads(text(f"{folder}/{n}/.zattrs") or "{}").get("class_counts") or {} for n in names if n}
                counts.append([(f"{n}\t{c}", int(k)) for n, of in kept.items() for c, k in of.items()])
            more = [pa.array(attrs, pa.string()), pa.array(arrays, pa.map_(pa.string(), pa.string())), pa.array(counts, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "attrs", "arrays", "counts"])

    importable(paths.sparkSession)
    schema = StructType([*paths.schema.fields]).add("attrs", "string").add("arrays", T.MapType(T.StringType(), T.StringType())).add("counts", T.MapType(T.StringType(), T.LongType()))
    return paths.mapInArrow(opened, schema)


def present(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with `present`: whether there is a folder, as executors see it."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = [bool(p.as_py()) and os.path.isdir(local(p.as_py())) for p in batch.column(path)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there, pa.bool_())], [*batch.schema.names, "present"])

    importable(paths.sparkSession)
    return paths.mapInArrow(seen, StructType([*paths.schema.fields]).add("present", "boolean"))


def array_of(meta: Column) -> Column:
    """Shape, chunks and rank of an array's description."""
    return F.from_json(meta, "shape array<bigint>, chunks array<bigint>, dtype string")
