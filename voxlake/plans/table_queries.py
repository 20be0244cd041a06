"""Queries over classes, catalogues, samples, batches and written volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions import values as V
from ..operators import catalog, sampling, sink, stats
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


COUNTS = "with " + R.CUBES + ", fg as (select volume_id, label, count(*) filter (where w <> 0) as n from (select *, case when v > 0 then 1 else 0 end as w from cubes) group by all), k as (select unnest(range(12)) as class), c as (select k.class, coalesce(sum(n), 0) as total, count(n) as volumes from k left join fg on label = class group by 1) "


def _foreground(spark, sf_dir):
    marks = R.cubes(spark, sf_dir).withColumn("v", V.binarize(0.0)(F.col("v")))
    return stats.foreground(marks, ["volume_id", "label"])


def _classes(spark):
    return spark.range(12).select(F.col("id").cast("int").alias("class"))


@query(COUNTS + "select cast(class as int) as class, cast(total as bigint) as total from c")
def class_counts(spark, sf_dir):
    fg = _foreground(spark, sf_dir).select(F.col("label").alias("class"), F.col("n_foreground").alias("n"))
    return stats.class_counts(fg, _classes(spark))


@query("with " + R.CUBES + " select volume_id, count(*) filter (where v > 0) as n_foreground, count(*) as total_voxels, cast(trunc(count(*) filter (where v > 0) * 512.0 / 1000.0) as bigint) as scaled from cubes group by 1")
def foreground_counts(spark, sf_dir):
    fg = _foreground(spark, sf_dir).select("volume_id", "n_foreground")
    return fg.select("volume_id", "n_foreground", F.lit(64).cast("long").alias("total_voxels"), stats.scaled_count(F.col("n_foreground"), F.lit(512.0), F.lit(1000.0)).alias("scaled"))


@query("select volume_id, cast((greatest(1, cast(round_even(56.0 / s, 0) as bigint)) * greatest(1, cast(round_even(44.0 / s, 0) as bigint)) * greatest(1, cast(round_even(100.0 / s, 0) as bigint))) as bigint) as total_voxels from (select p_partkey as volume_id, p_size * 1.5 as s from part)")
def total_voxels(spark, sf_dir):
    from ..functions import geometry as G

    p = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("volume_id"), (F.col("p_size") * 1.5).alias("s"))
    one = lambda n: G.box_voxels(F.lit(0.0), F.lit(n), F.col("s"))
    return p.select("volume_id", (one(56.0) * one(44.0) * one(100.0)).alias("total_voxels"))


@query(COUNTS + "select cast(class as int) as class, round(case when volumes = 0 then 0.0 else greatest(volumes * 64 - total, 0) / greatest(total, 1) end, 9) as weight from c")
def class_weights(spark, sf_dir):
    fg = _foreground(spark, sf_dir).groupBy(F.col("label").alias("class")).agg(F.sum("n_foreground").alias("fg"), (F.count("*") * 64).alias("total"))
    return _classes(spark).join(fg, "class", "left").select("class", F.round(stats.class_weight(F.col("total"), F.col("fg")), 9).alias("weight"))


@query("with " + R.CUBES + ", s as (select case when volume_id % 5 = 0 then 'validate' else 'train' end as split, label, v from cubes) select split, label as class, count(*) filter (where v > 0) as n from s group by grouping sets ((split, label), (label))")
def split_class_counts(spark, sf_dir):
    """Per split and over all, in one pass."""
    fg = _foreground(spark, sf_dir).withColumn("split", F.when(F.col("volume_id") % 5 == 0, "validate").otherwise("train"))
    return fg.groupingSets([["split", "label"], ["label"]], "split", "label").agg(F.sum("n_foreground").alias("n")).select("split", F.col("label").alias("class"), "n")


@query("with " + R.CROPS + " select crop, " + ", ".join(f"bool_or(class = {k}) as c{k}" for k in range(10)) + " from crops group by 1")
def crop_class_matrix(spark, sf_dir):
    return stats.crop_class_matrix(R.crops(spark, sf_dir), "crop", "class", list(range(10)))


@query("with " + R.CROPS + " select class, count(*) as n_crops, min(crop) as first_crop from crops group by 1")
def active_classes(spark, sf_dir):
    return R.crops(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n_crops"), F.min("crop").alias("first_crop"))


#: The draws as a recursion over (draw, counts of the active classes, row): the least seen class, one of its crops, its classes counted.
BALANCED = f"""with recursive mat as (select crop, [{", ".join(f"cast(c{k} as int)" for k in range(10))}] as has, row_number() over (order by crop) as r from ({SQL["crop_class_matrix"]})),
k as (select list(has order by crop) as has, list(crop order by crop) as crops from mat),
o as (select list(c order by c) as active, list(rows order by c) as rows from (select c, list(r order by r) as rows from mat, (select unnest(range(1, 11)) as c) x where has[c] = 1 group by c)),
run(i, seen, r) as (select -1, list_transform(active, lambda c: 0), cast(0 as bigint) from o
 union all select i + 1, list_transform(range(1, len(seen) + 1), lambda j: seen[j] + k.has[drawn][o.active[j]]), drawn from (
  select i, seen, o.rows[c][1 + cast(floor(u2 * len(o.rows[c])) as bigint)] as drawn from (
   select i, seen, tied[1 + cast(floor(u1 * len(tied)) as bigint)] as c, u2 from (
    select i, seen, list_filter(range(1, len(seen) + 1), lambda j: seen[j] = list_min(seen)) as tied,
     cast(('0x' || substr(md5('42:0:' || (i + 1) || ':class'), 1, 8)) as bigint) / 4294967296.0 as u1, cast(('0x' || substr(md5('42:0:' || (i + 1) || ':crop'), 1, 8)) as bigint) / 4294967296.0 as u2
    from run where i < 199) a) b, o) d, o, k)
select cast(i as int) as pos, cast(k.crops[r] as int) as crop from run, k where i >= 0"""


@query(BALANCED)
def balanced_sampler(spark, sf_dir):
    """200 draws over the 50 crops, made by a task; the matrix has 50 rows whatever the table's size."""
    drawn = sampling.balanced(crop_class_matrix(spark, sf_dir), "crop", [f"c{k}" for k in range(10)], 200)
    return drawn.select("pos", "crop")


@query("select cast(r as int) as row, cast(case when r < o % 7 then r * (o // 7 + 1) else (o % 7) * (o // 7 + 1) + (r - o % 7) * (o // 7) end as bigint) as start, cast(case when r < o % 7 then o // 7 + 1 else o // 7 end as bigint) as width from (select count(*) as o from orders), (select unnest(range(7)) as r)")
def row_to_sample(spark, sf_dir):
    n = R.table(spark, sf_dir, "orders").agg(F.count("*").alias("n")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(6))))
    s = n.withColumn("s", sampling.sample_range(F.col("row"), F.lit(7), F.col("n")))
    return s.select("row", F.col("s.start").cast("long").alias("start"), F.col("s.width").cast("long").alias("width"))


_COUNTED = "with c as (select c_custkey as i, c_nationkey, count(*) over () as n from customer) "


def _n(spark, sf_dir):
    return R.table(spark, sf_dir, "customer").count()


@query(_COUNTED + ", p as (select b * n + i as pos, n, b from c, (select unnest(range(3)) as b)) select pos, " + R.permuted_sql("pos % n", "n", "('9:' || b)") + " as idx from p where pos < 2 * n + n // 3")
def min_redundant_inds(spark, sf_dir):
    """Two and a third times as many positions as there are customers: each block of positions is a permutation of its own.

    Customers are dealt to tasks first, as a file may hold them all in one row group and a position costs far more than its row.
    """
    n = _n(spark, sf_dir)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(2)))
    dealt = R.table(spark, sf_dir, "customer").select("c_custkey").repartition(max(1, -(-n // 20_000)))
    pos = dealt.select("c_custkey", blocks.alias("b")).select((F.col("b") * n + F.col("c_custkey")).alias("pos"), "b")
    return sampling.few_repeats(pos.where(F.col("pos") < 2 * n + n // 3), "pos", n, 9, block="b").drop("b")


@query(_COUNTED + "select i as c_custkey, " + R.permuted_sql("i", "n", "'4:2'") + " as pos from c")
def epoch_shuffle(spark, sf_dir):
    """An epoch's order as positions: a bijection of the index, so no row meets another."""
    return sampling.shuffled(R.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _n(spark, sf_dir), 4, 2)


@query(_COUNTED + ", p as (select i as pos, " + R.permuted_sql("i", "n", "'6:1'") + " as g from c), d as (select c_nationkey as dataset, count(*) as k from customer group by 1), o as (select dataset, k, coalesce(sum(k) over (order by dataset rows between unbounded preceding and 1 preceding), 0) as first from d) select pos, dataset, cast(g - first as bigint) as index from p join o on g >= first and g < first + k")
def loader_places(spark, sf_dir):
    """An epoch's order over datasets that follow one another, one for each nation, and the place of each sample in its own."""
    rows = R.table(spark, sf_dir, "customer")
    n = _n(spark, sf_dir)
    counts = sampling.with_offsets(rows.groupBy(F.col("c_nationkey").alias("dataset")).agg(F.count("*").alias("n")), "dataset", "n")
    order = sampling.shuffled(rows.select(F.col("c_custkey").alias("pos")), "pos", n, 6, 1, "index")
    return sampling.placed(order, counts, n, 25).select("pos", "dataset", "index")


@query("with " + R.CUBES + ", p as (select volume_id, label, sum(case when v > 0 then 1 else 0 end) as fg from cubes group by all) select cast(volume_id // 8 as bigint) as batch_id, count(*) as n, cast(sum(fg) as bigint) as fg, string_agg(cast(label as varchar), ',' order by volume_id) as labels from p group by 1")
def collate_batches(spark, sf_dir):
    fg = _foreground(spark, sf_dir)
    b = sampling.batches(fg, "volume_id", 8, "label", "n_foreground")
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n_foreground"])
    return b.select("batch_id", F.size("items").cast("long").alias("n"), total.alias("fg"), F.array_join(F.transform("items", lambda x: x["label"].cast("string")), ",").alias("labels"))


#: Lines of split files made of customers' names: two kinds of rows, another split, and what is left out.
_LINES = ["'train,/raw/' || c_name || '.zarr,/gt/' || c_name || '.zarr'", "''", "'# note,' || c_name || ',y'", "'validate,/d,raw/' || c_name || ',/g,\"gt/[' || c_mktsegment || ',er]\"'", "'short,' || c_name", "'Training2,/d/,' || c_name || ',/g,/abs/' || c_mktsegment", "'test,r' || c_custkey || ',g,extra'", "'train,,/gt/' || c_name"]


@query("""select c_custkey, case k when 0 then 'train' when 3 then 'validate' when 5 then 'Training2' else 'test' end as split,
 case k when 0 then '/raw/' || c_name || '.zarr' when 3 then '/d/raw/' || c_name when 5 then '/d/' || c_name else 'r' || c_custkey end as raw_path,
 case k when 0 then '/gt/' || c_name || '.zarr' when 3 then '/g/gt/[' || c_mktsegment || ',er]' when 5 then '/abs/' || c_mktsegment else 'g' end as gt_path, k in (0, 5) as is_training
 from (select *, c_custkey % 8 as k from customer) where k in (0, 3, 5, 6)""")
def parse_split_csv(spark, sf_dir):
    """Rows of split files; those without a raw path are skipped."""
    cases = " ".join(f"when {i} then {line}" for i, line in enumerate(_LINES))
    lines = R.table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"case c_custkey % 8 {cases} end").alias("value"))
    rows = catalog.split_rows(lines, "c_custkey").where("raw_path <> ''")
    return rows.select("c_custkey", "split", "raw_path", "gt_path", catalog.is_training(F.col("split")).alias("is_training"))


_TARGETS = ["'/g/[' || p_type || ',' || p_brand || ']/s0'", "'/g/[' || p_brand || ']'", "'/g/' || p_brand", "'/g/[' || p_brand || '/b'", "'/g/[a]/[' || p_brand || ']'", "'/g/[ ' || p_brand || ', b ]'"]


@query("with p as (select *, case p_partkey % 6 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_TARGETS)) + """ end as path from part)
select p_partkey, path, case p_partkey % 6 when 0 then '/g/{label}/s0' when 1 then '/g/{label}' when 5 then '/g/{label}' else path end as template,
 case p_partkey % 6 when 0 then p_type || '|' || p_brand when 1 then p_brand when 2 then p_brand when 3 then 'b' when 4 then '[' || p_brand || ']' else ' ' || p_brand || '| b ' end as classes from p""")
def split_target_path(spark, sf_dir):
    """Target paths made of the parts' names, with one list of classes in brackets or without."""
    cases = " ".join(f"when {i} then {t}" for i, t in enumerate(_TARGETS))
    rows = R.table(spark, sf_dir, "part").select("p_partkey", F.expr(f"case p_partkey % 6 {cases} end").alias("path"))
    return rows.withColumn("s", catalog.split_target(F.col("path"))).select("p_partkey", "path", "s.template", F.array_join("s.classes", "|").alias("classes"))


#: Every substring of p_type that p_name holds; the longest, then the first, of each part.
LONGEST = """with s as (select p_partkey, i, n, substr(p_type, i, n) as t from part, lateral (select unnest(range(1, length(p_type) + 1)) as i) a, lateral (select unnest(range(1, length(p_type) - i + 2)) as n) b where contains(p_name, substr(p_type, i, n))),
o as (select *, row_number() over (partition by p_partkey order by n desc, i) as rn from s) select part.p_partkey, coalesce(t, '') as lcs from part left join (select * from o where rn = 1) o on o.p_partkey = part.p_partkey"""


@query(LONGEST)
def longest_common_substring(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select("p_partkey", text.longest_common_substring(F.col("p_type"), F.col("p_name")).alias("lcs"))


@query("""with l as (select p_partkey, p_brand, cast(p_size as double) as s, p_retailprice as o from part)
select p_partkey as volume_id, cast(k as int) as level, 's' || k as path, case k when 2 then 2 * s else s end as scale_z, case k when 2 then s * 0.5 + o else o end as origin_z, '/' || p_brand as name from l, (select unnest([0, 1, 2]) as k)""")
def multiscale_metadata_roundtrip(spark, sf_dir):
    """Attributes as JSON of a volume for each part, with two added levels, parsed into levels again."""
    name = F.concat(F.lit("/a/b.zarr/"), F.col("p_brand"))
    made = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("volume_id"), catalog.multiscale_attrs(name, [F.col("p_size")] * 3, [F.col("p_retailprice")] * 3, more_levels=2).alias("attrs"))
    found = catalog.levels(made.withColumn("name", F.get_json_object("attrs", "$.multiscales[0].name")), "attrs", "name")
    return found.select("volume_id", "level", "path", F.get("voxel_size", F.lit(0)).alias("scale_z"), F.get("origin", F.lit(0)).alias("origin_z"), "name")


#: The whole volumes as patches of 4 x 4 x 4 written over 6 x 6 x 6 outputs, with starts that overlap and leave them on both sides.
WRITES = "with " + R.CUBES + ", p as (select volume_id % 20 as out_id, volume_id as seq, cast(volume_id % 9 as int) - 3 as z0, cast((volume_id // 5) % 4 as int) as y0, cast((volume_id // 3) % 5 as int) - 1 as x0, z as dz, y as dy, x as dx, v from cubes), w as (select out_id, seq, z0 + dz as z, y0 + dy as y, x0 + dx as x, v from p where z0 + dz >= 0 and z0 + dz < 6 and y0 + dy < 6 and x0 + dx >= 0 and x0 + dx < 6) "


def _writes(spark, sf_dir):
    n = F.col("volume_id")
    starts = [((n % 9).cast("int") - 3).alias("z0"), (F.floor(n / 5) % 4).cast("int").alias("y0"), ((F.floor(n / 3) % 5).cast("int") - 1).alias("x0")]
    p = R.cubes(spark, sf_dir).select((n % 20).alias("out_id"), n.alias("seq"), *starts, *[F.col(a).alias(f"d{a}") for a in "zyx"], "v")
    return sink.placed(p, {a: 6 for a in "zyx"})


@query(WRITES + "select out_id, seq, z, y, x, round(v, 6) as v from w")
def writer_scatter(spark, sf_dir):
    return _writes(spark, sf_dir).select("out_id", "seq", "z", "y", "x", F.round("v", 6).alias("v"))


@query(WRITES + ", l as (select out_id, z, y, x, max_by(v, seq) as v from w group by all) select cast(out_id as varchar) as volume_id, cast(z // 4 as int) as cz, cast(y // 3 as int) as cy, cast(x // 2 as int) as cx, count(*) as n, cast(sum(z % 4 * 6 + y % 3 * 2 + x % 2) as bigint) as places, round(sum(cast(v as float)), 4) as total from l group by all")
def writer_chunks(spark, sf_dir):
    """The written voxels as the chunk rows that go to a stored volume."""
    last = sink.last_write(_writes(spark, sf_dir), ["out_id", "z", "y", "x"], "seq").withColumnRenamed("out_id", "volume_id")
    rows = sink.chunk_rows(last, (4, 3, 2))
    add = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
    return rows.select("volume_id", "cz", "cy", "cx", F.size("data").cast("long").alias("n"), add("at", "bigint").alias("places"), F.round(add("data", "double"), 4).alias("total"))


@query(WRITES + "select out_id, z, y, x, round(max_by(v, seq), 6) as v from w group by all")
def writer_last_write_wins(spark, sf_dir):
    return sink.last_write(_writes(spark, sf_dir), ["out_id", "z", "y", "x"], "seq").withColumn("v", F.round("v", 6))


@query("with " + R.CUBES + " select volume_id, case z when 0 then 'mito' when 2 then 'nuc' end as class, y, x, round(v, 6) as v from cubes where z in (0, 2)")
def writer_channel_split(spark, sf_dir):
    """Channels of a model by class name; a class that the writer does not hold is dropped."""
    c = R.cubes(spark, sf_dir).select("volume_id", F.col("z").alias("channel"), "y", "x", "v")
    return sink.channels(c, ["mito", "er", "nuc", "ld"], ["mito", "nuc", "golgi"]).select("volume_id", "class", "y", "x", F.round("v", 6).alias("v"))


@query("with d as (select distinct crop from (select cast(vec_id % 50 as int) as crop from embeddings)) select crop, cast(ceil((256.0 - crop) / 8.0) as bigint) as n from d")
def writer_output_shape(spark, sf_dir):
    return R.crops(spark, sf_dir).select("crop").distinct().select("crop", sink.output_voxels(F.col("crop").cast("double"), F.lit(256.0), F.lit(8.0)).alias("n"))


@query("with " + R.CUBES + " select volume_id, cast(min(z) as int) as z, cast(count(*) as bigint) as n, round(sum(v), 5) as total from cubes where z >= volume_id % 4 and z < volume_id % 4 + 2 and y < 2 and x < 2 group by 1")
def writer_read_back(spark, sf_dir):
    """A clamped window without padding."""
    first = F.col("volume_id") % 4
    c = sink.window(R.cubes(spark, sf_dir), {"z": (first, F.least(first + 2, F.lit(4))), "y": (0, 2), "x": (0, 2)})
    return c.groupBy("volume_id").agg(F.min("z").alias("z"), F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("total"))


_TYPES = ("uint8", "int8", "int16", "int32", "int64", "float32")


@query("select p_partkey, " + str(list(_TYPES)) + "[p_partkey % 6 + 1] as dtype, cast([255, 127, 32767, 2147483647, 9223372036854775807, 1][p_partkey % 6 + 1] as bigint) as most from part")
def type_max_value(spark, sf_dir):
    """The largest value of a stored type for each part."""
    rows = R.table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 6).cast("int")).alias("dtype"))
    return rows.select("p_partkey", "dtype", V.type_max(F.col("dtype")).alias("most"))


@query("with b as (select vec_id % 50 as dataset, vec_id as n from embeddings), k as (select dataset, count(*) as n from b group by 1) select cast(dataset as int) as dataset, n from k where n > 9 or dataset < 3")
def verified_datasets(spark, sf_dir):
    """Datasets with samples, or forced."""
    k = R.table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 50).cast("int").alias("dataset")).agg(F.count("*").alias("n"))
    return catalog.verified(k, F.col("n") - 9, F.col("dataset") < 3)


@query("with " + R.CUBES + ", p as (select volume_id % 20 as out_id, volume_id as seq, case z when 0 then 'mito' when 2 then 'nuc' else null end as class, cast(volume_id % 5 as int) - 2 + y as y, cast((volume_id // 5) % 5 as int) + x as x, v from cubes) select out_id, class, cast(0 as int) as z, y, x, round(max_by(v, seq), 6) as v from p where class is not null and y >= 0 and y < 6 and x < 6 group by all")
def writer_by_class(spark, sf_dir):
    """Slices as channels of four model classes, written about places that leave the output; two of its three classes are met."""
    n = F.col("volume_id")
    p = R.cubes(spark, sf_dir).select(n.alias("idx"), F.col("z").alias("channel"), F.lit(0).alias("dz"), F.col("y").alias("dy"), F.col("x").alias("dx"), "v")
    rows = sink.by_class(p, "out", ("out",), ["mito", "nuc", "golgi"], ["mito", "er", "nuc", "ld"])
    rows = rows.select((F.col("idx") % 20).alias("out_id"), F.col("idx").alias("seq"), "class", F.lit(0).alias("z0"), ((F.col("idx") % 5).cast("int") - 2).alias("y0"), (F.floor(F.col("idx") / 5) % 5).cast("int").alias("x0"), "dz", "dy", "dx", "v")
    return sink.last_write(sink.placed(rows, {"z": 1, "y": 6, "x": 6}), ["out_id", "class", "z", "y", "x"], "seq").withColumn("v", F.round("v", 6))


@query("with " + R.CUBES + " select volume_id, target, cast(case label when 3 then 0 when 0 then 1 else 2 end as int) as channel, cast(count(*) as bigint) as n, round(sum(v), 5) as total from cubes cross join (select unnest(['near', 'far']) as target) where label in (3, 0, 7) group by all")
def target_stack(spark, sf_dir):
    """Classes 3, 0 and 7 as channels of two targets, in that order."""
    rows = R.cubes(spark, sf_dir).select("volume_id", F.col("label").cast("string").alias("source"), F.col("z").alias("dz"), F.col("y").alias("dy"), F.col("x").alias("dx"), "v")
    s = sink.stacked(rows, "source", ["3", "0", "7"], ("near", "far"))
    return s.groupBy("volume_id", "target", "channel").agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("total"))
