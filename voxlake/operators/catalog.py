"""Volume metadata and split catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ngff

ATTRS = "multiscales array<struct<axes:array<string>,datasets:array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>,translation:array<double>>>>>,name:string,version:string>>"


def levels(attrs: DataFrame, text: str = "attrs", *more: str, configured: str = "zyx", outer: bool = False) -> DataFrame:
    """volume_id, level, path, axes, voxel_size, origin of each level of JSON attributes (volume_id, text), and the columns `more`.
    outer keeps attributes without levels, as one row.

    Axes are those of type space (the default type), given as objects or as plain names; where none is given, the configured ones.
    Scale and translation are the last entries, one for each axis; without a translation the origin is 0, without a scale
    voxel_size is NULL.
    """
    m = attrs.withColumn("m", F.get(F.from_json(text, ATTRS)["multiscales"], F.lit(0)))
    object_of = lambda a: a.startswith("{")
    space = F.filter("m.axes", lambda a: ~object_of(a) | (F.coalesce(F.get_json_object(a, "$.type"), F.lit("space")) == "space"))
    named = F.transform(space, lambda a: F.when(object_of(a), F.get_json_object(a, "$.name")).otherwise(a))
    axes = F.when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, configured)))
    m = m.withColumn("axes", axes).select("volume_id", *more, "axes", (F.posexplode_outer if outer else F.posexplode)("m.datasets").alias("level", "d"))
    pick = lambda kind: F.get(F.transform(F.filter("d.coordinateTransformations", lambda t: t["type"] == kind), lambda t: t[kind]), F.lit(0))
    last = lambda x: F.when(F.size(x) >= F.size("axes"), F.slice(x, -F.size("axes"), F.size("axes")))
    zero = F.transform("axes", lambda a: F.lit(0.0))
    return m.select("volume_id", "level", F.col("d.path").alias("path"), "axes", last(pick("scale")).alias("voxel_size"), F.coalesce(last(pick("translation")), zero).alias("origin"), *more)


def level_score(voxel_size: Column, target: Column) -> Column:
    """Sum over axes of the relative difference; a level without a scale scores 0."""
    diff = F.zip_with(voxel_size, target, lambda v, t: F.abs(v - t) / F.greatest(t, F.lit(1e-9)))
    return F.coalesce(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def nearest_level(table: DataFrame, target: Column, keys: list[str]) -> DataFrame:
    """keys, level: the least score, ties by order."""
    return table.groupBy(*keys).agg(F.min(F.struct(level_score(F.col("voxel_size"), target).alias("s"), "level")).alias("b")).select(*keys, F.col("b.level").alias("level"))


def opened(asked: DataFrame, configured: str = "zyx") -> DataFrame:
    """asked (volume_id, path, target: scales by axis, and more) with `best`, the level nearest to the target, and `first`, the finest: level,
    folder, meta, voxel_size, origin, counts (kept class counts). Their meta is NULL where there is no group or no array.

    One pass over the groups, on executors, and one shuffle of its rows. volume_id tells the rows of asked apart.
    """
    rest = [c for c in asked.columns if c != "volume_id"]
    found = ngff.groups(asked).withColumnRenamed("path", "group")
    carried = ["group" if c == "path" else c for c in rest]
    table = levels(found, "attrs", *carried, "arrays", "counts", configured=configured, outer=True).withColumnRenamed("path", "array")
    prefix = F.concat("array", F.lit("\t"))
    counts = F.transform_keys(F.map_filter("counts", lambda k, v: k.startswith(prefix)), lambda k, v: F.substr(k, F.length("array") + 2))
    row = F.struct("level", F.rtrim(F.concat_ws("/", "group", "array"), F.lit("/")).alias("folder"), F.col("arrays")[F.col("array")].alias("meta"), "voxel_size", "origin", counts.alias("counts"))
    score = F.struct(level_score(F.col("voxel_size"), F.col("target")), "level")
    kept = [F.first(c).alias("path" if c == "group" else c) for c in carried]
    return table.groupBy("volume_id").agg(*kept, F.min_by(row, score).alias("best"), F.min_by(row, F.coalesce("level", F.lit(0))).alias("first"))


def coarsest_not_exceeding(table: DataFrame, target: Column, keys: list[str]) -> DataFrame:
    """keys, level: the one before the first level with an axis coarser than the target, or the first, or the last."""
    over = F.exists(F.zip_with("voxel_size", target, lambda v, t: v > t), lambda x: x)
    got = table.groupBy(*keys).agg(F.min(F.when(over, F.col("level"))).alias("k"), F.max("level").alias("last"))
    return got.select(*keys, F.coalesce(F.greatest(F.col("k") - 1, F.lit(0)), F.col("last")).alias("level"))


def joined_path(left: Column, right: Column) -> Column:
    """Path join: an absolute right part stands alone."""
    return F.when(right.startswith("/"), right).when(left.endswith("/") | (left == ""), F.concat(left, right)).otherwise(F.concat(left, F.lit("/"), right))


def split_rows(lines: DataFrame, *more: str) -> DataFrame:
    """split, raw_path, gt_path, and the columns `more`, from CSV lines (value): blank and # lines go, as do those with fewer than three cells; three or
    four cells give columns 1 and 2, five or more join 1 with 2 and 3 with 4. Quoted cells may hold commas."""
    cells = F.transform(F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    rows = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).withColumn("c", cells)
    # the pattern also matches once at the end of the line
    rows = rows.withColumn("c", F.when(F.col("value").endswith(","), F.col("c")).otherwise(F.slice("c", 1, F.size("c") - 1))).where(F.size("c") >= 3)
    cell = lambda i: F.get("c", F.lit(i))
    wide = F.size("c") >= 5
    return rows.select(*more, cell(0).alias("split"), F.when(wide, joined_path(cell(1), cell(2))).otherwise(cell(1)).alias("raw_path"), F.when(wide, joined_path(cell(3), cell(4))).otherwise(cell(2)).alias("gt_path"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return split_rows(spark.read.text(path))


def split_target(path: Column) -> Column:
    """`a/[c1,c2]/b` as (`a/{label}/b`, [c1, c2]); any other count of brackets gives the path and its last part."""
    count = lambda c: F.length(path) - F.length(F.replace(path, F.lit(c), F.lit("")))
    good = (count("[") == 1) & (F.size(F.split(F.element_at(F.split(path, r"\["), -1), r"\]")) == 2)
    good = good & ~F.element_at(F.split(path, r"\["), 1).contains("]") | (good & (count("]") == 1))
    head, rest = F.element_at(F.split(path, r"\["), 1), F.element_at(F.split(path, r"\["), -1)
    classes, tail = F.element_at(F.split(rest, r"\]"), 1), F.element_at(F.split(rest, r"\]"), -1)
    return F.when(good, F.struct(F.concat(head, F.lit("{label}"), tail).alias("template"), F.split(classes, ",").alias("classes"))).otherwise(F.struct(path.alias("template"), F.array(F.element_at(F.split(path, "/"), -1)).alias("classes")))


def is_training(split: Column) -> Column:
    return F.startswith(F.lower(split), F.lit("train"))


def verified(datasets: DataFrame, n: Column, forced: Column | bool = False) -> DataFrame:
    """Datasets that have samples, and those that are forced to stay."""
    return datasets.where((n > 0) | (forced if isinstance(forced, Column) else F.lit(forced)))


def multiscale_attrs(name: Column, voxel_size: list[float | Column], origin: list[float | Column], unit: str = "nanometer", axes: str = "zyx", base_level: int = 0, more_levels: int = 0, corrected: bool = False) -> Column:
    """OME-NGFF 0.4 attributes as JSON. Added levels take scale and origin by 2 ** level and the name of the next level, as
    readers of such files are used to; corrected=True gives each level the scale of its own name."""
    sets = [(base_level, voxel_size, origin)]
    for k in range(base_level, base_level + more_levels):
        p = k + 1 - base_level if corrected else k
        sets.append((k + 1, [v * 2**p for v in voxel_size], [v * (2 ** (p - 1) - 0.5) + o for v, o in zip(voxel_size, origin, strict=True)]))
    nums = lambda xs: F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in xs])
    one = lambda k, s, t: F.struct(F.array(F.struct(F.lit("scale").alias("type"), nums(s).alias("scale"), F.lit(None).cast("array<double>").alias("translation")), F.struct(F.lit("translation").alias("type"), F.lit(None).cast("array<double>").alias("scale"), nums(t).alias("translation"))).alias("coordinateTransformations"), F.lit(f"s{k}").alias("path"))
    image = F.struct(
        F.array(*[F.struct(F.lit(a).alias("name"), F.lit("space").alias("type"), F.lit(unit).alias("unit")) for a in axes]).alias("axes"),
        F.array(F.struct(F.lit("scale").alias("type"), nums([1.0] * len(axes)).alias("scale"))).alias("coordinateTransformations"),
        F.array(*[one(*s) for s in sets]).alias("datasets"), F.element_at(F.split(name, r"\.zarr"), -1).alias("name"), F.lit("0.4").alias("version"),
    )
    return F.to_json(F.struct(F.array(image).alias("multiscales")))
