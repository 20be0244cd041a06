"""Queries over patches: reads, spatial transforms and value transforms. NaN is given as a flag and a value of 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..functions import values as V
from ..functions.rng import normal, uniform
from ..operators import patches, scan, spatial
from . import relations as R

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _told(df, *keys):
    """Keys with is_nan and a value rounded to 6 digits."""
    return df.select(*keys, F.isnan("v").alias("is_nan"), F.round(F.when(F.isnan("v"), 0.0).otherwise(F.col("v")), 6).alias("v"))


TOLD = "isnan(v) as is_nan, round(case when isnan(v) then 0 else v end, 6) as v"
#: Reads of 3 x 3 x 3 whose start depends on the volume, some of them over the edge.
READ = "with " + R.CUBES + ", " + R.grid(3, 3, 3) + """, req as (select distinct volume_id, cast(volume_id % 5 as int) - 2 as z0, cast(volume_id % 4 as int) as y0, cast(volume_id % 3 as int) - 1 as x0 from cubes),
read as (select r.volume_id, dz, dy, dx, coalesce(c.v, 'NaN'::double) as v from req r cross join grid g left join cubes c on c.volume_id = r.volume_id and c.z = z0 + dz and c.y = y0 + dy and c.x = x0 + dx) """


def _requests(spark, sf_dir):
    ids = R.table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("volume_id")).distinct()
    return ids.select("volume_id", F.lit(0).alias("patch_id"), ((F.col("volume_id") % 5).cast("int") - 2).alias("z0"), (F.col("volume_id") % 4).cast("int").alias("y0"), ((F.col("volume_id") % 3).cast("int") - 1).alias("x0"))


def _read(spark, sf_dir):
    return scan.read_voxels(_requests(spark, sf_dir), R.cubes(spark, sf_dir), (3, 3, 3)).drop("patch_id")


@query(READ + "select volume_id, dz, dy, dx, " + TOLD + " from read")
def patch_read_padded(spark, sf_dir):
    return _told(_read(spark, sf_dir), "volume_id", "dz", "dy", "dx")


@query(READ + "select volume_id, dz, dy, dx, " + TOLD + " from read")
def patch_read_chunked(spark, sf_dir):
    """The same reads over 2 x 2 x 2 chunks, joined on chunk ids and assembled with NumPy."""
    req = _requests(spark, sf_dir).withColumns({a: F.lit(4) for a in ("nz", "ny", "nx")})
    got = scan.read_chunks(req, scan.chunked(R.cubes(spark, sf_dir), (2, 2, 2)), (3, 3, 3), (2, 2, 2))
    return _told(scan.as_voxels(got, ["volume_id"], (3, 3, 3)), "volume_id", "dz", "dy", "dx")


def _asked(spark, sf_dir, stored, out, pad, start, read=None):
    """A window of each volume as a request of operators.patches."""
    ids = R.cube_patches(spark, sf_dir).select("sample", "source", F.col("sample").alias("volume_id"))
    return ids.select("*", F.array(*map(F.lit, stored)).alias("stored"), F.array(*start).cast("array<bigint>").alias("start"), F.array(*map(F.lit, read or out)).alias("read"), patches.form(out, False, "nearest", pad, float("nan")).alias("form"))


_VALID = ", ".join(f"greatest(0, -{a}0) as l{a}, least(3, 4 - {a}0) - greatest(0, -{a}0) as n{a}" for a in "zyx")
_MIDDLE = " and ".join(f"d{a} - (3 - n{a}) // 2 >= 0 and d{a} - (3 - n{a}) // 2 < n{a} and c.{a} = {a}0 + l{a} + d{a} - (3 - n{a}) // 2" for a in "zyx")


@query(READ.split("read as (")[0] + f"u as (select *, {_VALID} from req), got as (select u.volume_id, dz, dy, dx, coalesce(c.v, 'NaN'::double) as v from u cross join grid left join cubes c on c.volume_id = u.volume_id and {_MIDDLE}) select volume_id, dz, dy, dx, " + TOLD + " from got")
def patch_read_unpadded(spark, sf_dir):
    """The same windows without padding: what is there is put in the middle of the patch."""
    n = F.col("volume_id")
    asked = _asked(spark, sf_dir, (4, 4, 4), (3, 3, 3), False, [n % 5 - 2, n % 4, n % 3 - 1])
    got = patches.read_relation(asked, R.whole_chunks(spark, sf_dir, 4, 4, 4), (4, 4, 4))
    return _told(patches.as_voxels(got, ["sample"]).withColumnRenamed("sample", "volume_id"), "volume_id", "dz", "dy", "dx")


@query("with e as (select vec_id as volume_id, v, i from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) where i < 64), c as (select volume_id, i // 32 as channel, i // 16 % 2 as z, i // 4 % 4 as y, i % 4 as x, cast(v as double) as v from e), " + R.grid(2, 3, 3) + ", got as (select r.volume_id, k.channel, dz, dy, dx, coalesce(c.v, 'NaN'::double) as v from (select distinct volume_id from e) r cross join grid cross join (select unnest([0, 1]) as channel) k left join c on c.volume_id = r.volume_id and c.channel = k.channel and c.z = r.volume_id % 3 - 1 + dz and c.y = r.volume_id % 4 - 1 + dy and c.x = r.volume_id % 5 - 2 + dx) select volume_id, cast(channel as int) as channel, dz, dy, dx, " + TOLD + " from got")
def patch_read_leading_axes(spark, sf_dir):
    """Windows of volumes with four axes: the first is taken whole."""
    n = F.col("volume_id")
    asked = _asked(spark, sf_dir, (2, 2, 4, 4), (2, 3, 3), True, [n % 3 - 1, n % 4 - 1, n % 5 - 2])
    got = patches.read_relation(asked, R.whole_chunks(spark, sf_dir, 2, 2, 4, 4), (2, 4, 4))
    return _told(patches.as_voxels(got, ["sample"]).withColumnRenamed("sample", "volume_id"), "volume_id", "channel", "dz", "dy", "dx")


#: Three arrays of each volume about one centre: at the stored scale, at twice and at half of it, the nearest voxels of what covers them.
SOURCES = "with " + R.CUBES + ", " + R.grid(2, 2, 2) + """, s as (select * from (values ('fine', 8.0), ('wide', 16.0), ('near', 4.0)) t(source, scale)),
q as (select distinct volume_id, (volume_id % 9) * 4.0 as cz, (volume_id % 7) * 5.0 as cy, 16.0 as cx from cubes),
w as (select volume_id, source, n, cast(floor(cz / 8 - n / 2.0) as bigint) as z0, cast(floor(cy / 8 - n / 2.0) as bigint) as y0, cast(floor(cx / 8 - n / 2.0) as bigint) as x0 from q cross join (select source, greatest(1, cast(round_even(2 * scale / 8, 0) as int)) as n from s) s),
got as (select w.volume_id, source, dz, dy, dx, coalesce(c.v, 'NaN'::double) as v from w cross join grid left join cubes c on c.volume_id = w.volume_id and c.z = z0 + dz * n // 2 and c.y = y0 + dy * n // 2 and c.x = x0 + dx * n // 2) """


@query(SOURCES + "select volume_id, source, dz, dy, dx, " + TOLD + " from got")
def co_registered_read(spark, sf_dir):
    """Samples meet the sources of their dataset, and every source is read about the sample's centre at its own scale."""
    ids = R.cube_patches(spark, sf_dir).select(F.col("sample").alias("dataset"))
    array = lambda x: patches.vector([x] * 3)
    scales = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("fine", "wide", "near"))), F.array(array(16.0 / 2), array(16.0), array(4.0)))).alias("source", "scale")
    sources = ids.select("dataset", scales).withColumns({"voxel": array(8.0), "origin": array(0.0), "volume_id": F.col("dataset"), "stored": F.array(*map(F.lit, (4, 4, 4)))})
    sources = sources.withColumn("form", patches.form((2, 2, 2), patches.differs(F.col("voxel"), F.col("scale")), "nearest", True, float("nan")))
    samples = ids.select(F.col("dataset").alias("sample"), "dataset", F.array((F.col("dataset") % 9) * 4.0, (F.col("dataset") % 7) * 5.0, F.lit(16.0)).alias("centre"))
    met = samples.join(sources, "dataset").withColumn("read", patches.read_sizes(F.col("form.out"), F.col("scale"), F.col("voxel")))
    met = met.withColumn("start", patches.starts(F.col("centre"), F.col("origin"), F.col("voxel"), F.col("read")))
    got = patches.read_relation(met, R.whole_chunks(spark, sf_dir, 4, 4, 4), (4, 4, 4))
    return _told(patches.as_voxels(got, ["sample", "source"]).withColumnRenamed("sample", "volume_id"), "volume_id", "source", "dz", "dy", "dx")


@query("with " + R.CUBES + ", req as (select distinct volume_id, cast(volume_id % 9 as int) * 2 - 6 as z0 from cubes) select volume_id, z0, z0 >= 4 or z0 + 3 <= 0 as oob, cast(27 - (select count(*) from cubes c where c.volume_id = r.volume_id and c.z >= z0 and c.z < z0 + 3 and c.y < 3 and c.x < 3) as bigint) as n_nan from req r")
def patch_read_fully_oob(spark, sf_dir):
    req = _requests(spark, sf_dir).select("volume_id", "patch_id", ((F.col("volume_id") % 9).cast("int") * 2 - 6).alias("z0"), F.lit(0).alias("y0"), F.lit(0).alias("x0"))
    read = scan.read_voxels(req, R.cubes(spark, sf_dir), (3, 3, 3))
    n = read.groupBy("volume_id").agg(F.count_if(F.isnan("v")).alias("n_nan"))
    return req.join(n, "volume_id").select("volume_id", "z0", scan.out_of_bounds(F.col("z0"), F.lit(3), F.lit(4)).alias("oob"), "n_nan")


@query("with c as (select distinct vec_id % 50 as crop, label from embeddings), k as (select unnest(range(12)) as label) select cast(crops.crop as int) as crop, cast(k.label as int) as class, c.label is null as is_empty, cast(case when c.label is null then 8 else 0 end as bigint) as n_nan from (select distinct crop from c) crops cross join k left join c on c.crop = crops.crop and c.label = k.label")
def patch_empty_class(spark, sf_dir):
    """Every crop and class, with a patch of NaN where the crop does not hold the class."""
    held = R.crops(spark, sf_dir)
    asked = held.select("crop").distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(11))))
    got = asked.join(held.withColumn("there", F.lit(True)), ["crop", "class"], "left")
    patch = F.when(F.col("there").isNull(), scan.empty_patch((2, 2, 2))).otherwise(F.array_repeat(F.lit(1.0), 8))
    return got.select("crop", "class", F.col("there").isNull().alias("is_empty"), F.size(F.filter(patch, lambda x: F.isnan(x))).cast("long").alias("n_nan"))


@query(READ + "select volume_id, case when volume_id % 2 = 0 then 2 - dz else dz end as dz, dy, case when volume_id % 3 = 0 then 2 - dx else dx end as dx, " + TOLD + " from read")
def patch_mirror(spark, sf_dir):
    even = spatial.mirror(_read(spark, sf_dir), (3, 3, 3), {"z": F.col("volume_id") % 2 == 0, "x": F.col("volume_id") % 3 == 0})
    return _told(even, "volume_id", "dz", "dy", "dx")


@query(READ + "select volume_id, dx as dz, dz as dy, dy as dx, " + TOLD + " from read")
def patch_transpose(spark, sf_dir):
    return _told(spatial.transpose(_read(spark, sf_dir), (2, 0, 1)), "volume_id", "dz", "dy", "dx")


@query("with " + R.CUBES + ", " + R.grid(6, 2, 5) + " select v.volume_id, dz, dy, dx, isnan(coalesce(c.v, 'NaN'::double)) as is_nan, round(coalesce(c.v, 0), 6) as v from (select distinct volume_id from cubes) v cross join grid left join cubes c on c.volume_id = v.volume_id and c.z = dz - 1 and c.y = dy + 1 and c.x = dx")
def patch_enforce_shape(spark, sf_dir):
    return _finished(R.cube_patches(spark, sf_dir), (6, 2, 5))


def _finished(rows, out, resample=False, mode="nearest", turn=None):
    """Windows in the form asked for, in one Arrow pass, as voxels."""
    rows = rows.withColumn("form", patches.form(out, resample, mode, True, float("nan")))
    rows = rows.withColumn("turn", turn) if turn is not None else rows
    voxels = patches.as_voxels(patches.finish(rows, double=True), ["sample"])
    return _told(voxels.withColumnRenamed("sample", "volume_id"), "volume_id", "dz", "dy", "dx")


@query(SQL["patch_enforce_shape"])
def patch_enforce_shape_voxels(spark, sf_dir):
    """The same in voxel form, for plans that go on relationally."""
    return _told(spatial.enforce_shape(_whole(spark, sf_dir), ["volume_id"], (4, 4, 4), (6, 2, 5)), "volume_id", "dz", "dy", "dx")


def _whole(spark, sf_dir):
    return R.cubes(spark, sf_dir).select("volume_id", F.col("z").alias("dz"), F.col("y").alias("dy"), F.col("x").alias("dx"), "v")


@query("with " + R.CUBES + ", " + R.grid(3, 6, 2) + " select c.volume_id, dz, dy, dx, isnan(v) as is_nan, round(v, 6) as v from grid join cubes c on c.z = least(dz * 4 // 3, 3) and c.y = least(dy * 4 // 6, 3) and c.x = least(dx * 4 // 2, 3)")
def resample_nearest(spark, sf_dir):
    return _finished(R.cube_patches(spark, sf_dir), (3, 6, 2), True)


def _taps(a: str, o: int) -> str:
    r = f"greatest(0.0, (o + 0.5) * 4 / {o} - 0.5)"
    return f"t{a} as (select o, i, sum(w) as w from (select o, cast(floor({r}) as int) as i, 1 - ({r} - floor({r})) as w from (select unnest(range({o})) as o) union all select o, least(cast(floor({r}) as int) + 1, 3), {r} - floor({r}) from (select unnest(range({o})) as o)) group by all)"


@query("with " + R.CUBES + ", " + ", ".join(_taps(a, o) for a, o in (("z", 3), ("y", 6), ("x", 2))) + " select volume_id, cast(tz.o as int) as dz, cast(ty.o as int) as dy, cast(tx.o as int) as dx, false as is_nan, round(sum(v * tz.w * ty.w * tx.w), 6) as v from cubes join tz on tz.i = z join ty on ty.i = y join tx on tx.i = x group by all")
def resample_linear(spark, sf_dir):
    return _finished(R.cube_patches(spark, sf_dir), (3, 6, 2), True, "linear")


@query(SQL["resample_nearest"])
def resample_nearest_voxels(spark, sf_dir):
    """The same in voxel form, for plans that go on relationally."""
    return _told(spatial.resample_nearest(_whole(spark, sf_dir), ["volume_id"], (4, 4, 4), (3, 6, 2)), "volume_id", "dz", "dy", "dx")


@query(SQL["resample_linear"])
def resample_linear_voxels(spark, sf_dir):
    """The same in voxel form, for plans that go on relationally."""
    return _told(spatial.resample_linear(_whole(spark, sf_dir), ["volume_id"], (4, 4, 4), (3, 6, 2)), "volume_id", "dz", "dy", "dx")


@query(
    "with " + R.CUBES + ", " + R.grid(4, 4, 4) + " select g2.volume_id, dz, dy, dx, isnan(v) as is_nan, round(v, 6) as v from (select v.volume_id, dz, dy, dx, dx as sz, dy as sy, 3 - dz as sx from (select distinct volume_id from cubes) v cross join grid) g2 join cubes c on c.volume_id = g2.volume_id and c.z = sz and c.y = sy and c.x = sx"
)
def rotate_nearest(spark, sf_dir):
    """A quarter turn about y of whole volumes, as arrays in Arrow batches."""
    matrix = spatial.rotation_matrix({"y": 90.0})
    rows = R.cube_patches(spark, sf_dir).withColumnRenamed("sample", "volume_id").select("volume_id", "shape", "data")

    def turn(frames):
        return scan.stream_patches(frames, lambda d: spatial.rotate(d, matrix, "nearest", convention="world"))

    turned = rows.mapInPandas(turn, "volume_id long, shape array<int>, data array<double>")
    return _told(scan.as_voxels(turned, ["volume_id"], (4, 4, 4)), "volume_id", "dz", "dy", "dx")


@query(READ + "select volume_id, dz, dy, dx, isnan(v) as is_nan, case when isnan(v) then 0.0::double when v > 0.25 then 1.0::double else 0.0::double end as v from read")
def binarize(spark, sf_dir):
    return _told(_read(spark, sf_dir).withColumn("v", V.binarize(0.25)(F.col("v"))), "volume_id", "dz", "dy", "dx")


@query(READ + "select volume_id, dz, dy, dx, false as is_nan, case when isnan(v) then 7.0::double when isinf(w) and w > 0 then 9.0::double when isinf(w) then -9.0::double else round(w, 6) end as v from (select *, case when v > 1.5 and not isnan(v) then 'Infinity'::double when v < -1.5 then '-Infinity'::double else v end as w from read)")
def nan_to_num(spark, sf_dir):
    inf = float("inf")
    w = F.when(F.isnan("v"), F.col("v")).when(F.col("v") > 1.5, F.lit(inf)).when(F.col("v") < -1.5, F.lit(-inf)).otherwise(F.col("v"))
    return _told(_read(spark, sf_dir).withColumn("v", w).withColumn("v", V.nan_to_num(7.0, 9.0, -9.0)(F.col("v"))), "volume_id", "dz", "dy", "dx")


_U = "(('0x' || substr(md5({0}), 1, 8))::bigint / 4294967296.0)"


@query(READ + ", n as (select *, v + 0.5 + 0.1 * sqrt(-2 * ln(greatest(" + _U.format("concat_ws(':', 3, volume_id, dz, dy, dx, 'a')") + ", 1e-12))) * cos(2 * pi() * " + _U.format("concat_ws(':', 3, volume_id, dz, dy, dx, 'b')") + ") as w from read) select volume_id, dz, dy, dx, isnan(w) as is_nan, round(case when isnan(w) then 0 else w end, 6) as v from n")
def gaussian_noise(spark, sf_dir):
    z = normal(3, "volume_id", "dz", "dy", "dx")
    return _told(_read(spark, sf_dir).withColumn("v", V.add_noise(F.col("v"), z, 0.5, 0.1)), "volume_id", "dz", "dy", "dx")


@query("with " + R.CUBES + ", m as (select volume_id, y, x, avg(v) as mean from cubes group by all), r as (select c.*, mean, 0.5 + " + _U.format("concat_ws(':', 11, volume_id)") + " as ratio from cubes c join m using (volume_id, y, x)) select volume_id, z as dz, y as dy, x as dx, false as is_nan, round(least(greatest(ratio * v + (1 - ratio) * mean, 0), 1), 6) as v from r")
def random_contrast(spark, sf_dir):
    """One ratio for each volume; the mean runs along z, the first axis."""
    c = _whole(spark, sf_dir)
    mean = c.groupBy("volume_id", "dy", "dx").agg(F.avg("v").alias("mean"))
    ratio = uniform(11, "volume_id") * (1.5 - 0.5) + 0.5
    return _told(c.join(mean, ["volume_id", "dy", "dx"]).withColumn("v", V.contrast(F.col("v"), F.col("mean"), ratio)), "volume_id", "dz", "dy", "dx")


@query("with " + R.CUBES + ", r as (select *, 0.5 + " + _U.format("concat_ws(':', 12, volume_id)") + " as g from cubes) select volume_id, z as dz, y as dy, x as dx, false as is_nan, round(case when v < 0 then 0 when v = 0 then 0 else least(power(v, g), 1) end, 6) as v from r")
def random_gamma(spark, sf_dir):
    g = uniform(12, "volume_id") * (1.5 - 0.5) + 0.5
    return _told(_whole(spark, sf_dir).withColumn("v", V.gamma(F.col("v"), g)), "volume_id", "dz", "dy", "dx")


_KERNEL = "k as (select a, b, exp(-(a * a + b * b) / (2 * 0.64)) / sum(exp(-(a * a + b * b) / (2 * 0.64))) over () as w from (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b))"


@query("with " + R.CUBES + ", " + _KERNEL + " select o.volume_id, o.z as dz, o.y as dy, o.x as dx, false as is_nan, round(sum(c.v * w), 6) as v from cubes o cross join k join cubes c on c.volume_id = o.volume_id and c.z = o.z and c.y = least(greatest(o.y + a, 0), 3) and c.x = least(greatest(o.x + b, 0), 3) group by all")
def gaussian_blur(spark, sf_dir):
    return _told(spatial.blur(_whole(spark, sf_dir), ["volume_id"], (4, 4, 4), V.gaussian_kernel(3, 0.8, 2)), "volume_id", "dz", "dy", "dx")


@query("with " + R.CUBES + " select volume_id, y - 1 as dy, x - 1 as dx, round(v, 6) as v from cubes where z = 2 and y >= 1 and y < 3 and x >= 1 and x < 3")
def mid_slice_fov(spark, sf_dir):
    """The middle slice and the centred field of view of an image grid."""
    c = _whole(spark, sf_dir).where(F.col("dz") == 4 // 2).withColumn("dz", F.lit(0))
    return spatial.centre_crop(c, (1, 4, 4), (1, 2, 2)).select("volume_id", "dy", "dx", F.round("v", 6).alias("v"))


@query("with " + R.CUBES + ", u as (select distinct volume_id, " + _U.format("concat_ws(':', 1, 0, volume_id, 'mirror', 'z')") + " as uz, " + _U.format("concat_ws(':', 1, 0, volume_id, 'mirror', 'x')") + " as ux, " + _U.format("concat_ws(':', 1, 0, volume_id, 'rotate', 'z')") + " as r from cubes) select volume_id, uz < 0.5 as mirror_z, ux < 0.3 as mirror_x, round(-20 + 40 * r, 6) as angle_z from u")
def transform_draw(spark, sf_dir):
    """Parameters of mirror and rotation, drawn once for each sample and shared by all of its sources."""
    ids = spatial.drawn(_requests(spark, sf_dir).select("volume_id"), "volume_id", {"mirror": {"axes": {"z": 0.5, "x": 0.3}}, "rotate": {"z": 20}}, seed=1)
    return ids.withColumn("angle_z", F.round("angle_z", 6))


_SHAPES = """with s as (select p_partkey, case p_partkey % 5 when 0 then [p_size, 4] when 1 then [1, p_size, 4] when 2 then [p_size, 1, 5] when 3 then [1, 1] else [2, 3, p_size] end as s from part),
q as (select *, list_filter(s, lambda d: d <> 1) as q, coalesce(list_position(s, 1), 0) as one from s),
r as (select *, case when one > 0 then s[:one - 1] || s[one + 1:] else s end as r from q)
"""


def _text_sql(x: str) -> str:
    return f"'[' || array_to_string({x}, ', ') || ']'"


@query(_SHAPES + f"select p_partkey, {_text_sql('s')} as shape, len(s) = 2 as is_2d, one > 0 as singleton, {_text_sql('case when len(q) = 0 then [1] else q end')} as squeezed, {_text_sql('[1] || q')} as channel, {_text_sql('[1] || r')} as sliced, {_text_sql('r[:1] || [1] || r[2:]')} as sliced_1 from r")
def shape_functions(spark, sf_dir):
    """Shapes made of the parts' sizes."""
    n, size = F.col("p_partkey") % 5, F.col("p_size")
    of = lambda *xs: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in xs])
    shape = F.when(n == 0, of(size, 4)).when(n == 1, of(1, size, 4)).when(n == 2, of(size, 1, 5)).when(n == 3, of(1, 1)).otherwise(of(2, 3, size))
    rows = R.table(spark, sf_dir, "part").select("p_partkey", shape.alias("shape"))
    text = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    s = F.col("shape")
    columns = {"shape": text(s), "is_2d": shapes.is_2d(s), "singleton": shapes.has_singleton(s), "squeezed": text(shapes.squeezed(s)), "channel": text(shapes.with_channel(s)), "sliced": text(shapes.sliced(s, F.lit(0))), "sliced_1": text(shapes.sliced(s, F.lit(1)))}
    return rows.select("p_partkey", *[c.alias(k) for k, c in columns.items()])


@query("with " + R.CUBES + ", u as (select distinct volume_id, " + ", ".join(_U.format(f"concat_ws(':', 3, 2, volume_id, 'transpose', '{a}')") + f" as u{a}" for a in "zyx") + " from cubes) select volume_id, array_to_string(list_transform(list_sort([{'u': uz, 'i': 0}, {'u': uy, 'i': 1}, {'u': ux, 'i': 2}]), lambda s: s.i), ',') as perm from u")
def transpose_draw(spark, sf_dir):
    """A random order of the axes for each sample."""
    ids = spatial.drawn(_requests(spark, sf_dir).select("volume_id"), "volume_id", {"transpose": True}, seed=3, epoch=2)
    return ids.select("volume_id", F.array_join(F.col("perm").cast("array<string>"), ",").alias("perm"))


def _turned_sql(gx: str, gy: str, gz: str, linear: bool) -> str:
    """A rotation as SQL: places g of output voxels from coordinates qx, qy, qz, and the voxels about each place with their weights."""
    at = ", ".join(f"((g{a} + 1) * 4 - 1) / 2 as {a}" for a in "zyx")
    head = "with " + R.CUBES + ", " + R.grid(4, 4, 4) + ", b as (select dz, dy, dx, (2 * dz + 1) / 4.0::double - 1 as qz, (2 * dy + 1) / 4.0::double - 1 as qy, (2 * dx + 1) / 4.0::double - 1 as qx from grid)"
    head += f", g as (select dz, dy, dx, {gx} as gx, {gy} as gy, {gz} as gz from b), p as (select dz, dy, dx, greatest(abs(gz), abs(gy), abs(gx)) > 1 as rim, {at} from g)"
    if linear:
        taps = "select unnest([0, 1]) as k"
        weight = lambda a: f"case when {a}k.k = 1 then {a} - floor({a}) else 1 - ({a} - floor({a})) end"
        head += f", t as (select dz, dy, dx, rim, " + ", ".join(f"cast(floor({a}) as int) + {a}k.k as s{a}" for a in "zyx") + ", " + " * ".join(f"({weight(a)})" for a in "zyx") + f" as w from p, ({taps}) zk, ({taps}) yk, ({taps}) xk)"
    else:
        head += ", t as (select dz, dy, dx, rim, " + ", ".join(f"cast(round_even({a}, 0) as int) as s{a}" for a in "zyx") + ", 1.0::double as w from p)"
    ids = "(select distinct volume_id from cubes) i"
    summed = "select i.volume_id, dz, dy, dx, case when bool_or(rim) then 'NaN'::double else cast(cast(coalesce(sum(c.v * w), 0) as float) as double) end as v"
    return head + f", o as ({summed} from {ids} cross join t left join cubes c on c.volume_id = i.volume_id and c.z = sz and c.y = sy and c.x = sx group by all) select volume_id, dz, dy, dx, {TOLD} from o"


def _turned(spark, sf_dir, degrees, mode):
    matrix = spatial.rotation_matrix(degrees)
    turn = F.struct(patches.vector(matrix.ravel().tolist()).alias("matrix"), F.lit(None).cast("array<boolean>").alias("mirror"), F.lit(None).cast("array<int>").alias("perm"))
    return _finished(R.cube_patches(spark, sf_dir), (4, 4, 4), mode=mode, turn=turn)


@query(_turned_sql("qx * cos(radians(45)) + qy * cos(radians(30)) * sin(radians(45)) + qz * sin(radians(30)) * sin(radians(45))", "-qx * sin(radians(45)) + qy * cos(radians(30)) * cos(radians(45)) + qz * sin(radians(30)) * cos(radians(45))", "-qy * sin(radians(30)) + qz * cos(radians(30))", True))
def rotate_linear_two_axes(spark, sf_dir):
    """30 degrees about z, then 45 about x, in the default convention, with the padded rim."""
    return _turned(spark, sf_dir, {"z": 30.0, "x": 45.0}, "linear")


@query(_turned_sql("qx", "qy * cos(radians(30)) + qz * sin(radians(30))", "-qy * sin(radians(30)) + qz * cos(radians(30))", False))
def rotate_nearest_default(spark, sf_dir):
    """30 degrees about z in the default convention: as the matrix is applied to x, y, z, it turns the plane of y and z."""
    return _turned(spark, sf_dir, {"z": 30.0}, "nearest")
