"""Images, datasets, splits, loaders and writers over Spark: small metadata on the driver, voxels in DataFrames.

A dataset's samples are a DataFrame (idx, source, dz, dy, dx, v): reading many samples is one plan, not a loop. NaN marks what is
unknown: out of bounds, or a class that nobody annotated.
"""

from __future__ import annotations

import copy
import json
import math
import warnings
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boxes
from .functions import geometry, rng
from .functions import values as V
from .operators import catalog, patches, sampling, scan, sink, spatial, stats
from .sources import ngff

AXES = "zyx"
NAN = float("nan")


class Spec:
    """An output array: shape in voxels, scale in nanometres; two entries are padded to three in front."""

    def __init__(self, shape: Iterable[int], scale: Iterable[float]):
        shape, scale = list(shape), list(scale)
        self.shape = tuple([1] * (3 - len(shape)) + shape)
        self.scale = dict(zip(AXES, [float(s) for s in [scale[0]] * (3 - len(scale)) + scale], strict=True))
        self.size = {a: n * self.scale[a] for a, n in zip(AXES, self.shape, strict=True)}

    def __repr__(self) -> str:
        return f"Spec({self.shape}, {self.scale})"


class Image:
    """One level of a volume, read about world centres: voxels (volume_id, z, y, x, v) of a relation, or the chunks of a stored array.

    A stored array of two axes counts as one slice; axes before the last three are taken whole and numbered by `channel`.
    transform is a function of a column that holds one value, or a values.OfPatch, a NumPy function of a whole patch.
    """

    #: Of a stored volume: its folder and description, those of its finest level with that level's voxel size, and class counts kept there.
    folder, meta, finest, kept_counts = None, None, None, {}

    def __init__(self, voxels: DataFrame | None, shape: Iterable[int], voxel_size: Iterable[float], origin: Iterable[float], spec: Spec, pad: bool = False, pad_value: float = NAN, interpolation: str = "nearest", volume_id="0", transform: Callable | None = None, spark: SparkSession | None = None):
        self.voxels, self.shape, self.spec, self.pad, self.pad_value, self.interpolation, self.volume_id, self.transform = voxels, tuple(shape), spec, pad, pad_value, interpolation, volume_id, transform
        self.voxel_size, self.origin = dict(zip(AXES, map(float, voxel_size), strict=True)), dict(zip(AXES, map(float, origin), strict=True))
        self.spark = spark or voxels.sparkSession

    @staticmethod
    def open(spark: SparkSession, path: str, spec: Spec, **options) -> Image:
        """A group's level nearest to the scale asked for; nothing of it is read before a patch is."""
        return Image.open_all(spark, [(path, spec)], **options)[0]

    @staticmethod
    def open_all(spark: SparkSession, asked: list[tuple[str, Spec]], **options) -> list[Image]:
        """Any number of groups in one job: executors read their descriptions, and the driver gets one row for each."""
        ngff.register(spark)
        rows = [(str(i), path, [spec.scale[a] for a in AXES]) for i, (path, spec) in enumerate(asked)]
        found = {r["volume_id"]: r for r in catalog.opened(spark.createDataFrame(rows, "volume_id string, path string, target array<double>").repartition(min(len(rows), 64) or 1)).collect()}
        return [Image._of(spark, found[str(i)], spec, options) for i, (_, spec) in enumerate(asked)]

    @staticmethod
    def _of(spark: SparkSession, row, spec: Spec, options: dict) -> Image:
        best, first = row["best"], row["first"]
        if best is None or best["meta"] is None:
            raise FileNotFoundError(f"no multiscale group at {row['path']}")
        scale = list(spec.scale.values())
        size, origin = list(best["voxel_size"] or scale), list(best["origin"])
        image = Image(None, ngff.spatial(json.loads(best["meta"])["shape"], 1), scale[: 3 - len(size)] + size[-3:], [0.0] * (3 - len(origin)) + origin[-3:], spec, volume_id=row["path"], spark=spark, **options)
        image.folder, image.meta = ngff.local(best["folder"]), best["meta"]
        fine = list(first["voxel_size"] or scale)
        image.finest, image.kept_counts = (ngff.local(first["folder"]), first["meta"], math.prod(scale[: 3 - len(fine)] + fine[-3:])), dict(first["counts"] or {})
        return image

    def __repr__(self) -> str:
        return f"Image({self.volume_id}, shape={self.shape}, voxel_size={self.voxel_size}, spec={self.spec})"

    @property
    def rows(self) -> DataFrame:
        """The voxels (volume_id, z, y, x, v), also of a stored volume of at most three axes; the scan takes filters of cz, cy, cx."""
        if self.voxels is not None:
            return self.voxels
        ngff.register(self.spark)
        if len(json.loads(self.meta)["shape"]) > 3:
            raise ValueError("a volume with leading axes has no plain voxels; read patches of it")
        return voxels_of(self.spark.read.format("ngff").options(path=self.folder, volume_id=self.volume_id).load())

    @property
    def bounding_box(self) -> boxes.Box:
        return {a: (self.origin[a], self.origin[a] + n * self.voxel_size[a]) for a, n in zip(AXES, self.shape, strict=True)}

    @property
    def sampling_box(self) -> boxes.Box | None:
        return boxes.shrunk(self.bounding_box, self.spec.size, self.spec.scale, self.pad)

    @property
    def total_voxels(self) -> int:
        return math.prod(boxes.voxels(self.bounding_box, self.spec.scale).values())

    def centre(self, index: int) -> dict[str, float]:
        if self.sampling_box is None:
            raise ValueError("the array is too small for the patch")
        return boxes.centre(self.sampling_box, self.spec.scale, index)

    def foreground(self, label: str | None = None, kept: str | None = None) -> int:
        """Voxels other than 0 at the finest level, as a count at the output's scale, truncated; kept as in foregrounds()."""
        return foregrounds([(label, self)], kept)[0]

    def source_row(self, name: str) -> tuple:
        """The image as a row of SOURCES: what a plan over many volumes knows of it."""
        spec = self.spec
        differs = any(abs(self.voxel_size[a] - spec.scale[a]) / max(spec.scale[a], 1e-9) > 0.01 for a in AXES)
        mode = "nearest" if self.interpolation == "nearest" else "linear"
        how = (list(spec.shape), differs, mode, self.pad, float(self.pad_value))
        lists = [[float(x[a]) for a in AXES] for x in (self.voxel_size, self.origin, spec.scale)]
        return (name, str(self.volume_id), self.folder, self.meta, [int(n) for n in self.shape], *lists, how)

    def patches(self, samples: DataFrame, name: str = "") -> DataFrame:
        """sample, source, shape, data of the patch about each centre of samples (sample, centre, and turn if there are transforms)."""
        sources = self.spark.createDataFrame([(0, *self.source_row(name))], SOURCES)
        return valued(read(samples.withColumn("dataset", F.lit(0)), sources, {(0, name): self}), {name: self.transform}).drop("dataset")

    def read(self, centres: list[dict[str, float]], rotation: np.ndarray | None = None, mirror: dict[str, bool] | None = None, transpose: tuple[int, int, int] | None = None) -> DataFrame:
        """idx, dz, dy, dx, v of the patch about each centre, and channel where there are leading axes; NaN where the volume has nothing."""
        rows = [(i, [float(c[a]) for a in AXES]) for i, c in enumerate(centres)]
        samples = self.spark.createDataFrame(rows, "sample bigint, centre array<double>").withColumn("turn", turn(rotation, mirror, transpose))
        voxels = patches.as_voxels(self.patches(samples), ["sample"]).withColumn("idx", F.col("sample").cast("int"))
        lead = self.meta is not None and len(json.loads(self.meta)["shape"]) > 3
        return voxels.select("idx", *["channel"] * lead, "dz", "dy", "dx", "v")


#: The sources of datasets as a relation; voxel sizes, origins and scales by axis.
SOURCES = "dataset int, source string, volume_id string, folder string, meta string, stored array<bigint>, voxel array<double>, origin array<double>, scale array<double>, form " + patches.FORM


def turn(rotation=None, mirror: dict[str, bool] | None = None, transpose: Iterable[int] | None = None) -> Column:
    """Transforms that all samples share, as patches.TURN; NULL for none."""
    if rotation is None and not mirror and transpose is None:
        return F.lit(None).cast(patches.TURN)
    null = lambda kind: F.lit(None).cast(f"array<{kind}>")
    parts = [
        null("double") if rotation is None else patches.vector(np.asarray(rotation, float).ravel().tolist()),
        patches.vector([bool(mirror.get(a)) for a in AXES], "boolean") if mirror else null("boolean"),
        null("int") if transpose is None else patches.vector(transpose, "int"),
    ]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("matrix", "mirror", "perm"), strict=True)]).cast(patches.TURN)


def read(samples: DataFrame, sources: DataFrame, images: dict[tuple[int, str], Image | None], n_samples: int = 0) -> DataFrame:
    """sample, source, shape, data for samples (sample, dataset, centre, turn) over SOURCES: one plan for all stored volumes and all classes
    without a volume, and one more for each relation of voxels."""
    met = samples.join(sources, "dataset")
    if "turn" not in samples.columns:
        met = met.withColumn("turn", F.lit(None).cast(patches.TURN))
    met = met.withColumn("read", patches.read_sizes(F.col("form.out"), F.col("scale"), F.col("voxel"), F.col("turn.matrix")))
    met = met.withColumn("start", patches.starts(F.col("centre"), F.col("origin"), F.col("voxel"), F.col("read")))
    plain, parts = [i for i in images.values() if i is not None and i.voxels is not None], []
    if len(plain) < len(images):
        whole = {n: i.transform.f for (_, n), i in images.items() if i is not None and i.voxels is None and isinstance(i.transform, V.OfPatch)}
        stored = met.where("meta is not null or volume_id is null") if plain else met
        largest = max((i.spec.shape for i in images.values() if i is not None), key=math.prod, default=(1, 1, 1))
        names = len({n for _, n in images})
        parts.append(patches.read_stored(stored, patches.partitions_for(samples.sparkSession, n_samples * names, largest), whole or None))
    for (d, name), image in images.items():
        if image is None or image.voxels is None:
            continue
        chunk = tuple(max(1, min(64, n)) for n in image.shape)
        mine = met.where((F.col("dataset") == d) & (F.col("source") == name)).withColumn("volume_id", F.lit(image.volume_id))
        held = scan.chunked(image.voxels.where(F.col("volume_id") == F.lit(image.volume_id)), chunk)
        parts.append(patches.read_relation(mine, held, chunk, image.transform.f if isinstance(image.transform, V.OfPatch) else None))
    return reduce(DataFrame.unionByName, parts)


def valued(rows: DataFrame, transforms: dict[str, Callable | None]) -> DataFrame:
    """Patches under the value transforms of their sources, as one expression; functions of whole patches have been applied when read."""
    of = {n: f for n, f in transforms.items() if f is not None and not isinstance(f, V.OfPatch)}
    if not of:
        return rows
    each = lambda f: F.transform("data", lambda v: f(v.cast("double"))).cast("array<float>")
    value, same = F.col("data"), {}
    for name, f in of.items():
        same.setdefault(f, []).append(name)
    for f, names in same.items():
        value = F.when(F.col("source").isin(names), each(f)).otherwise(value)
    return rows.withColumn("data", value)


def foregrounds(images: list[tuple[str | None, Image | None]], kept: str | None = None) -> list[int]:
    """For each (class, image) its voxels other than 0 at the finest level, as a count at the output's scale, truncated; one job for all.

    Counts that a volume's attributes keep for the class are taken from there. kept names a table of counts by chunk: only chunks
    that changed since are opened (stats.stored_foreground).
    """
    out, stored, plain = [0] * len(images), {}, {}
    scaled = lambda n, size, image: int(n * size / math.prod(image.spec.scale.values()))
    for i, (label, image) in enumerate(images):
        if image is None:
            continue
        if image.voxels is not None:
            plain[i] = image
        elif label in image.kept_counts:
            out[i] = scaled(image.kept_counts[label], image.finest[2], image)
        else:
            stored[i] = image
    parts = []
    if stored:
        spark = next(iter(stored.values())).spark
        volumes = spark.createDataFrame([(str(i), *image.finest[:2]) for i, image in stored.items()], "volume_id string, folder string, meta string")
        parts.append(stats.stored_foreground(volumes, kept).select(F.col("volume_id").cast("int").alias("i"), "n"))
    for i, image in plain.items():
        parts.append(image.voxels.where((F.col("v") != 0) & (F.col("volume_id") == F.lit(image.volume_id))).agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n"))
    for r in reduce(DataFrame.unionByName, parts).collect() if parts else []:  # a row for each image
        image = images[r["i"]][1]
        out[r["i"]] = scaled(r["n"], image.finest[2] if image.finest else math.prod(image.voxel_size.values()), image)
    return out


def voxels_of(chunks: DataFrame) -> DataFrame:
    """The voxels (volume_id, z, y, x, v) of ngff chunks of at most three axes."""
    n = lambda i: F.coalesce(F.try_element_at("shape", F.lit(i)), F.lit(1))
    cells = chunks.select("volume_id", "z0", "y0", "x0", "shape", F.posexplode("data").alias("i", "v"))
    return cells.select("volume_id", (F.col("z0") + F.floor(F.col("i") / (n(-2) * n(-1)))).cast("int").alias("z"), (F.col("y0") + F.floor(F.col("i") / n(-1)) % n(-2)).cast("int").alias("y"), (F.col("x0") + F.col("i") % n(-1)).alias("x"), F.col("v").cast("double").alias("v"))


class Dataset:
    """Inputs by name, and an image for each class (None: not annotated there, which reads as NaN).

    target_names are the names under which a model asks for the classes; transforms gives a class's values a transform, or all
    classes one; unannotated classes get none.
    """

    def __init__(self, inputs: dict[str, Image], targets: dict[str, Image | None], target_spec: Spec, target_names: Iterable[str] = ("target",), transforms: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] | None = None):
        self.inputs, self.targets, self.spec, self.classes, self.target_names, self.transforms = inputs, targets, target_spec, list(targets), tuple(target_names), transforms

    def __repr__(self) -> str:
        return f"Dataset(inputs={list(self.inputs)}, classes={self.classes}, spec={self.spec}, samples={len(self)})"

    def _images(self) -> list[Image]:
        return [*self.inputs.values(), *(t for t in self.targets.values() if t)]

    def _common(self, kind: str) -> boxes.Box | None:
        found = [getattr(i, kind) for i in self._images()]
        return reduce(lambda a, b: a and b and boxes.intersect(a, b), found) if found else None

    @property
    def bounding_box(self) -> boxes.Box | None:
        return self._common("bounding_box")

    @property
    def sampling_box(self) -> boxes.Box | None:
        return self._common("sampling_box")

    def __len__(self) -> int:
        box = self.sampling_box
        return math.prod(boxes.voxels(box, self.spec.scale).values()) if box else 0

    def verify(self) -> bool:
        return len(self) > 0

    def indices(self, size: dict[str, float] | None = None) -> list[int]:
        box = self.sampling_box
        return boxes.tiles(box, self.spec.scale, size or self.spec.size) if box else []

    def _of(self, name: str) -> Callable | None:
        """The transform of a source: the image's own, then the class's."""
        image = self.inputs[name] if name in self.inputs else self.targets[name]
        own = image.transform if image else None
        if name in self.inputs or image is None:
            return own
        more = self.transforms.get(name) if isinstance(self.transforms, dict) else self.transforms
        return V.chained(own, more) if own and more else own or more

    def sources(self, number: int = 0) -> tuple[list[tuple], dict[tuple[int, str], Image | None], dict[str, Callable | None]]:
        """Rows of SOURCES, the images by (number, name), and the transforms by name."""
        images = {**self.inputs, **self.targets}
        empty = lambda name: (number, name, None, None, None, [1, 1, 1], *[[1.0] * 3] * 2, [self.spec.scale[a] for a in AXES], (list(self.spec.shape), False, "nearest", True, NAN))
        rows = [(number, *image.source_row(name)) if image else empty(name) for name, image in images.items()]
        return rows, {(number, n): self._with(n, i) for n, i in images.items()}, {n: self._of(n) for n, i in images.items() if i}

    def _with(self, name: str, image: Image | None) -> Image | None:
        """The image with the transform that its source has here."""
        if image is None or self._of(name) is image.transform:
            return image
        changed = copy.copy(image)
        changed.transform = self._of(name)
        return changed

    def grid_row(self, number: int = 0) -> tuple:
        """(dataset, lo, step, grid): what turns a local index into a centre."""
        box = self.sampling_box
        grid = boxes.voxels(box, self.spec.scale)
        return (number, [float(box[a][0]) for a in AXES], [self.spec.scale[a] for a in AXES], [int(grid[a]) for a in AXES])

    def patches(self, samples: DataFrame) -> DataFrame:
        """sample, source, shape, data of all sources for samples (sample, local index `index`, and turn, which all sources share)."""
        if self.sampling_box is None:
            raise IndexError("the dataset is empty")
        return MultiDataset([self]).patches(samples.withColumn("dataset", F.lit(0)))

    def read(self, indices: list[int], rotation=None, mirror=None, transpose=None) -> DataFrame:
        """idx, source, dz, dy, dx, v of all sources about the centres of the indices; transforms are shared by all sources."""
        spark = self._images()[0].spark if self._images() else SparkSession.active()
        samples = spark.createDataFrame([(int(i),) for i in indices], "index bigint").select(F.col("index").alias("sample"), "index").distinct()
        read = self.patches(samples.withColumn("turn", turn(rotation, mirror, transpose)))
        voxels = patches.as_voxels(read, ["sample", "source"])
        return voxels.select(F.col("sample").cast("int").alias("idx"), "source", "dz", "dy", "dx", "v")

    def read_targets(self, indices: list[int], **transforms) -> DataFrame:
        """idx, target, channel, dz, dy, dx, v: the classes in their order as channels, the same under each target name."""
        return sink.stacked(self.read(indices, **transforms), "source", self.classes, self.target_names)

    @property
    def class_counts(self) -> dict[str, int]:
        return MultiDataset([self]).class_counts

    def crop_class_matrix(self) -> list[list[bool]]:
        return [[i is not None for i in self.targets.values()]]


class MultiDataset:
    """Datasets one after another; global index = offset + local index."""

    def __init__(self, datasets: list[Dataset]):
        self.datasets, self.classes = datasets, datasets[0].classes if datasets else []
        self.offsets = [sum(len(d) for d in datasets[:i]) for i in range(len(datasets))]

    def __len__(self) -> int:
        return sum(map(len, self.datasets))

    def place(self, index: int) -> tuple[int, int]:
        """The dataset and the local index of a global one."""
        d = max(i for i, o in enumerate(self.offsets) if o <= index and len(self.datasets[i]))
        return d, index - self.offsets[d]

    def places(self, rows: DataFrame, index: str = "index") -> DataFrame:
        """rows with dataset and local index (`index`) of a global one."""
        table = rows.sparkSession.createDataFrame([(d, first, len(x)) for d, (x, first) in enumerate(zip(self.datasets, self.offsets, strict=True))], "dataset int, first bigint, n bigint")
        return sampling.placed(rows, table, len(self), len(self.datasets), index)

    def patches(self, samples: DataFrame, n_samples: int = 0) -> DataFrame:
        """sample, source, shape, data, dataset, index of all sources for samples (sample, dataset, local index `index`, turn): one plan, whose size does not
        grow with the number of stored datasets. Indices wrap, so -1 is a dataset's last sample."""
        spark, rows, images, transforms, grids = samples.sparkSession, [], {}, {}, []
        for number, data in enumerate(self.datasets):
            if data.sampling_box is not None:
                mine, found, of = data.sources(number)
                rows, images, transforms = rows + mine, images | found, transforms | of
                grids.append(data.grid_row(number))
        grid = spark.createDataFrame(grids, "dataset int, lo array<double>, step array<double>, grid array<bigint>")
        at = geometry.unravel(F.col("index"), [F.get("grid", F.lit(i)) for i in range(3)])
        centre = F.array(*[F.get("lo", F.lit(i)) + (k + 0.5) * F.get("step", F.lit(i)) for i, k in enumerate(at)])
        placed = samples.join(grid, "dataset").withColumn("centre", centre).drop("lo", "step", "grid")
        return valued(read(placed, spark.createDataFrame(rows, SOURCES), images, n_samples), transforms)

    def counts(self, kept: str | None = None) -> dict[str, int]:
        """Foreground by class over all datasets, in one job; kept as in foregrounds()."""
        asked = [(c, d.targets[c]) for d in self.datasets for c in self.classes]
        out = dict.fromkeys(self.classes, 0)
        for (c, _), n in zip(asked, foregrounds(asked, kept), strict=True):
            out[c] += n
        return out

    @property
    def class_counts(self) -> dict[str, int]:
        return self.counts()

    @property
    def class_weights(self) -> dict[str, float]:
        counts = self.class_counts
        total = {c: sum(d.targets[c].total_voxels for d in self.datasets if d.targets[c]) for c in self.classes}
        return {c: max(total[c] - counts[c], 0) / max(counts[c], 1) if total[c] else 0.0 for c in self.classes}

    def crop_class_matrix(self) -> list[list[bool]]:
        return [row for d in self.datasets for row in d.crop_class_matrix()]

    def validation_indices(self) -> list[int]:
        return [o + i for d, o in zip(self.datasets, self.offsets, strict=True) for i in d.indices()]

    def verify(self) -> bool:
        return len(self) > 0

    def balanced_order(self, spark: SparkSession, n: int, seed: int = 42, epoch: int = 0) -> DataFrame:
        """pos, index: n draws of an epoch, balanced over classes, made by a task; a dataset's sample is a uniform draw of its own."""
        if not all(len(d) for d, row in zip(self.datasets, self.crop_class_matrix(), strict=True) if any(row)):
            raise ValueError("a dataset without samples could be drawn")
        names = [f"c{i}" for i in range(len(self.classes))]
        table = [(d, *map(bool, row), first, len(x)) for d, (x, row, first) in enumerate(zip(self.datasets, self.crop_class_matrix(), self.offsets, strict=True))]
        matrix = spark.createDataFrame(table, "crop int, " + "".join(f"{c} boolean, " for c in names) + "first bigint, size bigint")
        drawn = sampling.balanced(matrix, "crop", names, n, seed, [epoch]).join(matrix.select("crop", "first", "size"), "crop")
        local = F.floor(rng.uniform(seed, epoch, "pos", F.lit("sample")) * F.col("size"))
        return drawn.select(F.col("pos").cast("bigint").alias("pos"), (F.col("first") + local).cast("bigint").alias("index"))

    def balanced(self, n: int | None = None, seed: int = 42, epoch: int = 0) -> list[int]:
        """n global indices (None or 0: as many as samples), balanced over classes."""
        n = n or len(self)
        out = []
        for i, row in enumerate(sampling.balanced_rows(self.crop_class_matrix(), n, seed, epoch)):
            if not len(self.datasets[row]):
                raise ValueError("a dataset without samples was drawn")
            out.append(self.offsets[row] + int(sampling.unit(seed, epoch, i, "sample") * len(self.datasets[row])))
        return out


class Blocks:
    """Tiles of a MultiDataset that cover each of its datasets once: what validation reads."""

    def __init__(self, data: MultiDataset):
        self.data, self.indices = data, data.validation_indices()

    def __len__(self) -> int:
        return len(self.indices)

    def loader(self, batch_size: int = 1) -> Loader:
        return Loader(self.data, batch_size, self.indices)


class Split:
    """Training and validation datasets. They are prebuilt, or built from rows (split, raw_path, gt_path) by `build(raw, template,
    classes, train)`: a row's name begins with `train`, in any case, or it validates.

    A row without a raw path goes. A dataset that cannot be built is kept in `failed` with its error, and one without samples goes
    unless `force` is set. Prebuilt datasets are taken as they are.
    """

    def __init__(self, spark: SparkSession | None = None, rows: DataFrame | None = None, build: Callable[[str, str, list[str], bool], Dataset] | None = None, force: bool = False, prebuilt: dict[str, list[Dataset]] | None = None):
        self.rows, self.build, self.force, self.failed = rows, build, force, []
        self.train, self.validate = (list((prebuilt or {}).get(k, [])) for k in ("train", "validate"))
        if prebuilt is not None or rows is None:
            return
        rows = rows.where("raw_path <> ''").withColumns({"t": catalog.split_target(F.col("gt_path")), "train": catalog.is_training(F.col("split"))})
        for r in rows.collect():  # a catalogue of volumes: small by nature
            try:
                dataset = build(r["raw_path"], r["t"]["template"], list(r["t"]["classes"]), r["train"])
                good = force or dataset.verify()
            except Exception as error:  # one volume that cannot be opened does not stop the others
                warnings.warn(f"{r['raw_path']} is left out: {error}", stacklevel=2)
                self.failed.append((r["raw_path"], error))
                continue
            if good:
                (self.train if r["train"] else self.validate).append(dataset)

    @staticmethod
    def from_csv(spark: SparkSession, path: str, build, force: bool = False) -> Split:
        return Split(spark, catalog.read_splits(spark, path), build, force)

    @staticmethod
    def from_dict(spark: SparkSession, paths: dict[str, list[tuple[str, str]]], build, force: bool = False) -> Split:
        """From (raw path, target path) pairs by split name."""
        rows = [(name, raw, target) for name, pairs in paths.items() for raw, target in pairs]
        return Split(spark, spark.createDataFrame(rows, "split string, raw_path string, gt_path string"), build, force)

    @staticmethod
    def cataloged(spark: SparkSession, rows: DataFrame, inputs: dict[str, Spec], target: Spec, classes: list[str] | None = None, pad: bool | str = False, force: bool = False, train_transform=None, validate_transform=None, target_transforms=None, target_names: Iterable[str] = ("target",)) -> Split:
        """A split whose volumes are all opened in one job, however many: rows (split, raw_path, gt_path) as for Split.

        A class is annotated in a dataset if its row names it and a folder of it is there. pad may name splits instead of being
        true or false: it holds where the row's split is a part of the text. train_transform is for inputs of training rows,
        validate_transform for those of the others. classes None: all that some row names, in order of their names.
        """
        ngff.register(spark)
        named = rows.where("raw_path <> ''").withColumns({"t": catalog.split_target(F.col("gt_path")), "train": catalog.is_training(F.col("split"))})
        array = lambda spec: patches.vector([spec.scale[a] for a in AXES])
        ask = lambda kind, name, path, spec: F.struct(F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), array(spec).alias("target"))
        raw = F.array(*[ask("input", F.lit(n), F.col("raw_path"), spec) for n, spec in inputs.items()])
        gt = F.transform("t.classes", lambda c: ask("class", c, F.replace(F.col("t.template"), F.lit("{label}"), c), target))
        asked = named.withColumn("row", F.monotonically_increasing_id()).withColumn("a", F.explode(F.concat(raw, gt))).select("row", "split", "train", "raw_path", "a.*")
        asked = ngff.present(asked.withColumn("volume_id", F.concat_ws("|", "row", "kind", "name"))).repartition(min(64, max(1, spark.sparkContext.defaultParallelism)))
        found = sorted(catalog.opened(asked).collect(), key=lambda r: r["row"])  # a row for each volume that is asked for
        out = Split(prebuilt={})
        out.rows, out.force = rows, force
        classes = classes or sorted({r["name"] for r in found if r["kind"] == "class"})
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r["row"], []).append(r)
        for mine in by.values():
            first = mine[0]
            padded = pad if isinstance(pad, bool) else first["split"].lower() in pad.lower()
            try:
                of_inputs = {r["name"]: Image._of(spark, r, inputs[r["name"]], {"pad": padded, "interpolation": "nearest", "transform": train_transform if r["train"] else validate_transform}) for r in mine if r["kind"] == "input"}
                held = {r["name"]: Image._of(spark, r, target, {"pad": padded}) for r in mine if r["kind"] == "class" and r["present"] and r["name"] in classes}
            except FileNotFoundError as error:
                warnings.warn(f"{first['raw_path']} is left out: {error}", stacklevel=2)
                out.failed.append((first["raw_path"], error))
                continue
            data = Dataset({n: of_inputs[n] for n in inputs}, {c: held.get(c) for c in classes}, target, target_names, target_transforms)
            if force or data.verify():
                (out.train if first["train"] else out.validate).append(data)
        return out

    @staticmethod
    def of(spark: SparkSession, build=None, prebuilt=None, paths=None, csv: str | None = None, force: bool = False) -> Split:
        """From what is given: prebuilt datasets before paths by split before a file; from nothing, an empty split."""
        if prebuilt is not None:
            return Split(prebuilt=prebuilt)
        if paths is not None:
            return Split.from_dict(spark, paths, build, force)
        return Split.from_csv(spark, csv, build, force) if csv is not None else Split()

    def rebuilt(self, spark: SparkSession, build=None, force: bool | None = None) -> Split:
        """A split of the same rows with other arrays, transforms or force; this one stays as it is."""
        return Split(spark, self.rows, build or self.build, self.force if force is None else force)

    @property
    def train_combined(self) -> MultiDataset:
        return MultiDataset(self.train)

    @property
    def validate_combined(self) -> MultiDataset:
        return MultiDataset(self.validate)

    @property
    def train_blocks(self) -> Blocks:
        return Blocks(self.train_combined)

    @property
    def validate_blocks(self) -> Blocks:
        return Blocks(self.validate_combined)

    @property
    def class_counts(self) -> dict[str, dict[str, int]]:
        return {"train": self.train_combined.class_counts, "validate": self.validate_combined.class_counts}

    def __repr__(self) -> str:
        return f"Split(train={len(self.train)}, validate={len(self.validate)}, failed={len(self.failed)})"


class Loader:
    """Batches of samples in an order that is given (a list, or a function of the epoch), balanced over classes, or shuffled by hash.

    An order that is given comes before `balanced`, which is for training and wants a class that some dataset holds; without one a
    warning says so and the order is plain. The last batch may be short. Orders that are not given are column expressions over a
    range, so an epoch of any length is a plan of one size. turns draws spatial transforms (spatial.drawn), once for each position.
    """

    def __init__(self, data: MultiDataset, batch_size: int = 1, indices: list[int] | None = None, shuffle: bool = False, seed: int = 0, order: Callable[[int], list[int]] | None = None, balanced: bool = False, train: bool = True, per_epoch: int | None = None, turns: dict | None = None):
        self.data, self.batch_size, self.shuffle, self.seed, self.epoch, self.given, self.turns = data, batch_size, shuffle, seed, 0, order, turns
        self.indices = indices
        self.balanced = order is None and balanced and train and any(map(any, data.crop_class_matrix()))
        if order is None and balanced and train and not self.balanced:
            warnings.warn("no dataset holds a class, so samples are not balanced", stacklevel=2)
        self.per_epoch = per_epoch or len(data)

    def _size(self) -> int:
        if self.given:
            return len(self.given(self.epoch))
        return self.per_epoch if self.balanced else len(self.data) if self.indices is None else len(self.indices)

    def __len__(self) -> int:
        return -(-self._size() // self.batch_size)

    def __repr__(self) -> str:
        return f"Loader({self.data}, batch_size={self.batch_size}, epoch={self.epoch})"

    def order(self, spark: SparkSession, epoch: int | None = None) -> DataFrame:
        """pos, index: the global index at each position of an epoch."""
        epoch, n = self.epoch if epoch is None else epoch, self._size()
        if self.given or self.indices is not None and not self.balanced:
            listed = self.given(epoch) if self.given else list(self.indices)
            rows = spark.createDataFrame(list(enumerate(map(int, listed))), "pos bigint, index bigint")
            if self.given or not self.shuffle:
                return rows
            return rows.withColumn("pos", rng.permuted(F.col("pos"), max(1, n), self.seed, epoch))
        if self.balanced:
            return self.data.balanced_order(spark, n, self.seed, epoch)
        at = spark.range(n).select(F.col("id").alias("pos"))
        return at.withColumn("index", rng.permuted(F.col("pos"), max(1, n), self.seed, epoch) if self.shuffle else F.col("pos"))

    def epoch_patches(self, epoch: int | None = None) -> DataFrame:
        """batch_id, pos, dataset, idx, source, shape, data of an epoch: each position's patches, its transforms shared by its sources."""
        spark, epoch = SparkSession.active(), self.epoch if epoch is None else epoch
        return self._patches(self.order(spark, epoch), epoch, self._size())

    def _patches(self, order: DataFrame, epoch: int, n: int) -> DataFrame:
        at = self.data.places(order)
        if self.turns:
            drawn = spatial.drawn(at, "pos", self.turns, self.seed, epoch)
            at = drawn.withColumn("turn", spatial.turn_of(drawn)).select(*at.columns, "turn")
        met = self.data.patches(at.withColumn("sample", F.col("pos")).drop("pos"), n)
        batch = F.floor(F.col("sample") / self.batch_size).cast("int")
        return met.select(batch.alias("batch_id"), F.col("sample").cast("int").alias("pos"), "dataset", F.col("index").cast("int").alias("idx"), "source", "shape", "data")

    def epoch_rows(self) -> DataFrame:
        """All batches of the next epoch in one plan, a row for each voxel: what is written out or fed on by partition."""
        rows = self.epoch_patches()
        self.epoch += 1
        return patches.as_voxels(rows, ["batch_id", "pos", "dataset", "idx", "source"]).drop("channel")

    def __iter__(self) -> Iterator[DataFrame]:
        spark, epoch = SparkSession.active(), self.epoch
        order, n = self.order(spark, epoch), self._size()
        self.epoch += 1
        for at in range(0, n, self.batch_size):
            rows = self._patches(order.where((F.col("pos") >= at) & (F.col("pos") < at + self.batch_size)), epoch, self.batch_size)
            yield patches.as_voxels(rows, ["pos", "dataset", "idx", "source"]).drop("channel")


class Writer:
    """An output volume over a world box: patches about centres become voxels, the last write of each counts."""

    def __init__(self, box: boxes.Box, spec: Spec):
        self.box, self.spec = box, spec
        self.shape = {a: math.ceil((hi - lo) / spec.scale[a]) for a, (lo, hi) in box.items()}

    def centres(self) -> list[dict[str, float]]:
        inner = {a: ((lo + self.spec.size[a] / 2, hi - self.spec.size[a] / 2) if hi - lo > self.spec.size[a] else ((lo + hi) / 2,) * 2) for a, (lo, hi) in self.box.items()}
        return [boxes.centre(inner, self.spec.scale, i) for i in boxes.tiles(inner, self.spec.scale, self.spec.size)]

    def blocks(self, image: Image, batch_size: int = 1) -> Iterator[tuple[list[dict[str, float]], DataFrame]]:
        """The tiles in batches: their centres, and the input patches (idx, dz, dy, dx, v) about them."""
        centres = self.centres()
        for at in range(0, len(centres), batch_size):
            yield centres[at : at + batch_size], self.inputs(image, centres[at : at + batch_size])

    def inputs(self, image: Image, centres: list[dict[str, float]]) -> DataFrame:
        """Input patches about the writer's centres: padded with 0 and resampled linearly, whatever the image is set to."""
        padded = copy.copy(image)
        padded.pad, padded.pad_value, padded.interpolation = True, 0.0, "linear"
        return padded.read(centres)

    def read_back(self, voxels: DataFrame, centre: dict[str, float]) -> DataFrame:
        """Of the output's voxels (z, y, x, v) the window about a centre, clamped to the output and not padded."""
        starts = {a: round((centre[a] - self.spec.size[a] / 2 - self.box[a][0]) / self.spec.scale[a]) for a in AXES}
        return sink.window(voxels, {a: (max(0, starts[a]), min(starts[a] + n, self.shape[a])) for a, n in zip(AXES, self.spec.shape, strict=True)})

    def __repr__(self) -> str:
        return f"Writer(box={self.box}, spec={self.spec})"

    def placed(self, patches: DataFrame, centres: list[dict[str, float]], keys: Iterable[str] = ()) -> DataFrame:
        """z, y, x, v of patches (idx, dz, dy, dx, v) written about centres[idx], in order of idx."""
        sink.checked(patches)
        spark = patches.sparkSession
        starts = [(i, *[round((c[a] - self.spec.size[a] / 2 - self.box[a][0]) / self.spec.scale[a]) for a in AXES]) for i, c in enumerate(centres)]
        at = spark.createDataFrame(starts, "idx int, z0 int, y0 int, x0 int")
        rows = patches.join(at, "idx").withColumns({f"size_{a}": F.lit(n) for a, n in zip(AXES, self.spec.shape, strict=True)})
        return sink.last_write(sink.placed(rows, dict(self.shape)), [*keys, "z", "y", "x"], "idx")


    def save(self, voxels: DataFrame, path: str, mode: str = "append", chunk: Iterable[int] | None = None, dtype: str = "float32") -> None:
        """Voxels (z, y, x, v) of placed() as a stored volume at the path; chunks are as large as patches unless told otherwise.

        append changes the voxels that it is given and no others; overwrite leaves 0 elsewhere.
        """
        spark = voxels.sparkSession
        ngff.register(spark)
        chunk = tuple(chunk or self.spec.shape)
        text = lambda x: ",".join(map(str, x))
        options = {"path": path, "shape": text(self.shape[a] for a in AXES), "chunks": text(chunk), "voxel_size": text(self.spec.scale[a] for a in AXES), "origin": text(self.box[a][0] for a in AXES), "dtype": dtype}
        sink.chunk_rows(voxels.select(F.lit(path).alias("volume_id"), *AXES, "v"), chunk).write.format("ngff").mode(mode).options(**options).save()


class DatasetWriter(Writer):
    """An output volume for each class. model_classes name the channels of what a model gives, in their order."""

    def __init__(self, box: boxes.Box, spec: Spec, classes: list[str], arrays: Iterable[str], model_classes: list[str] | None = None):
        super().__init__(box, spec)
        self.classes, self.arrays, self.model_classes = list(classes), tuple(arrays), list(model_classes or classes)

    def write(self, arrays: dict[str, DataFrame], centres: list[dict[str, float]]) -> DataFrame:
        """class, z, y, x, v of patches by name: an array's name has rows (idx, class or channel, dz, dy, dx, v), a class's name
        has rows (idx, dz, dy, dx, v); `idx`, `__metadata__` and names of neither kind are left out. idx is a place in centres.

        Rows with neither class nor channel under an array's name are written to all classes, as a patch without channels is.
        """
        parts = [sink.by_class(rows, name, self.arrays, self.classes, self.model_classes) for name, rows in arrays.items() if name not in ("idx", "__metadata__")]
        parts = [p for p in parts if p is not None]
        if not parts:
            raise ValueError(f"no array is named like one of {self.arrays} or {self.classes}")
        return self.placed(reduce(DataFrame.unionByName, parts), centres, ["class"])

    def save_classes(self, voxels: DataFrame, folder: str, mode: str = "append", **options) -> None:
        """Voxels (class, z, y, x, v) of write() as a volume for each class, under the folder and the class's name."""
        for name in self.classes:
            self.save(voxels.where(F.col("class") == name), f"{folder}/{name}", mode, **options)
