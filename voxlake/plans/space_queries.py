"""Queries over boxes, grids, windows and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import catalog, sampling
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


def _axes(spark, sf_dir):
    """volume_id, axis, n, voxel, origin, out: stored voxels and an output shape along each axis of each raster."""
    r = R.raster(spark, sf_dir).groupBy("volume_id").agg(*[(F.max(a) + 1).alias(a) for a in "zyx"])
    three = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("n"), F.lit(v).alias("voxel"), F.lit(o).alias("origin"), F.lit(s).alias("out")) for a, v, o, s in (("z", 8.0, 100.0, 9), ("y", 4.0, -20.0, 4), ("x", 2.0, 0.0, 16))])
    return r.select("volume_id", F.explode(three).alias("a")).select("volume_id", "a.*")


AXES = (
    "with "
    + R.RASTER
    + """, ext as (select volume_id, max(z) + 1 as z, max(y) + 1 as y, max(x) + 1 as x from raster group by 1),
axes as (select volume_id, 'z' as axis, cast(z as bigint) as n, 8.0::double as voxel, 100.0::double as origin, 9 as out from ext union all
 select volume_id, 'y', y, 4.0, -20.0, 4 from ext union all select volume_id, 'x', x, 2.0, 0.0, 16 from ext),
bb as (select *, origin as lo, origin + n * voxel as hi from axes),
sb as (select *, lo + out * voxel / 2 as a, hi - out * voxel / 2 as b, (lo + hi) / 2 as mid from bb),
sbox as (select *, case when a < b then a else mid - voxel / 2 end as s0, case when a < b then b else mid + voxel / 2 end as s1 from sb),
g as (select *, greatest(1, cast(round_even((s1 - s0) / voxel, 0) as bigint)) as m from sbox) """
)


@query(AXES + "select volume_id, axis, lo, hi from bb")
def volume_bounding_box(spark, sf_dir):
    a = _axes(spark, sf_dir).withColumn("b", G.bounding(F.col("origin"), F.col("n"), F.col("voxel")))
    return a.select("volume_id", "axis", "b.lo", "b.hi")


@query(AXES + "select volume_id, axis, s0 as padded_lo, s1 as padded_hi, case when a < b then a end as lo, case when a < b then b end as hi from sbox")
def volume_sampling_box(spark, sf_dir):
    a = _axes(spark, sf_dir).withColumn("b", G.bounding(F.col("origin"), F.col("n"), F.col("voxel")))
    box = lambda pad: G.sampling(F.col("b.lo"), F.col("b.hi"), F.col("out") * F.col("voxel"), F.col("voxel"), F.lit(pad))
    return a.withColumns({"p": box(True), "u": box(False)}).select("volume_id", "axis", F.col("p.lo").alias("padded_lo"), F.col("p.hi").alias("padded_hi"), F.col("u.lo").alias("lo"), F.col("u.hi").alias("hi"))


def _grid(spark, sf_dir):
    a = _axes(spark, sf_dir).withColumn("b", G.bounding(F.col("origin"), F.col("n"), F.col("voxel")))
    a = a.withColumn("s", G.sampling(F.col("b.lo"), F.col("b.hi"), F.col("out") * F.col("voxel"), F.col("voxel"), F.lit(True)))
    return a.select("*", F.col("s.lo").alias("s0"), F.col("s.hi").alias("s1")).withColumn("m", G.box_voxels(F.col("s0"), F.col("s1"), F.col("voxel")))


def _wide(spark, sf_dir):
    a = _grid(spark, sf_dir).groupBy("volume_id")
    pick = lambda c, x: F.max(F.when(F.col("axis") == x, F.col(c))).alias(f"{c}_{x}")
    return a.agg(*[pick(c, x) for c in ("s0", "s1", "voxel", "m", "out") for x in "zyx"])


WIDE = AXES + ", wide as (select volume_id, " + ", ".join(f"max(case when axis = '{x}' then {c} end) as {c}_{x}" for c in ("s0", "s1", "voxel", "m", "out") for x in "zyx") + " from g group by 1) "


@query(WIDE + "select volume_id, m_z * m_y * m_x as n_samples from wide")
def grid_len(spark, sf_dir):
    return _wide(spark, sf_dir).select("volume_id", (F.col("m_z") * F.col("m_y") * F.col("m_x")).alias("n_samples"))


@query(
    WIDE
    + """, q as (select *, idx, ((idx % (m_z * m_y * m_x)) + m_z * m_y * m_x) % (m_z * m_y * m_x) as i from wide, (select unnest([-1, 0, 7, 123, 99999]) as idx))
select volume_id, cast(idx as bigint) as idx, s0_z + (i // (m_y * m_x) + 0.5) * voxel_z as cz, s0_y + ((i // m_x) % m_y + 0.5) * voxel_y as cy, s0_x + (i % m_x + 0.5) * voxel_x as cx from q"""
)
def grid_index_to_center(spark, sf_dir):
    w = _wide(spark, sf_dir).withColumn("idx", F.explode(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 7, 123, 99999)])))
    v = G.unravel(F.col("idx"), [F.col(f"m_{a}") for a in "zyx"])
    return w.select("volume_id", "idx", *[G.centre_of(F.col(f"s0_{a}"), k, F.col(f"voxel_{a}")).alias(f"c{a}") for a, k in zip("zyx", v, strict=True)])


TILES = (
    WIDE
    + ", t as (select *, "
    + ", ".join(f"greatest(1, cast(round_even((s1_{a} - s0_{a}) / (out_{a} * voxel_{a}), 0) as bigint)) as t_{a}" for a in "zyx")
    + """ from wide), k as (select t.*, a.k as kz, b.k as ky, c.k as kx from t, (select unnest(range(200)) as k) a, (select unnest(range(200)) as k) b, (select unnest(range(200)) as k) c where a.k < t_z and b.k < t_y and c.k < t_x),
tiles as (select volume_id, cast(((kz * m_z) // t_z * m_y + (ky * m_y) // t_y) * m_x + (kx * m_x) // t_x as bigint) as idx from k) """
)


def _tiles(spark, sf_dir):
    """volume_id, idx: flat indices of the tiles of each sampling grid; three short sequences, exploded, and no join."""
    w = _wide(spark, sf_dir)
    for a in "zyx":
        w = w.withColumn(f"t_{a}", G.tile_count(F.col(f"s0_{a}"), F.col(f"s1_{a}"), F.col(f"out_{a}") * F.col(f"voxel_{a}")))
        w = w.withColumn(f"k_{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"t_{a}") - 1))).withColumn(f"v_{a}", G.tile_voxel(F.col(f"k_{a}"), F.col(f"m_{a}"), F.col(f"t_{a}")))
    return w.select("volume_id", ((F.col("v_z") * F.col("m_y") + F.col("v_y")) * F.col("m_x") + F.col("v_x")).alias("idx"))


@query(TILES + "select * from tiles")
def tile_indices(spark, sf_dir):
    return _tiles(spark, sf_dir)


@query(WIDE + ", n as (select volume_id, m_z * m_y * m_x as n from wide) select volume_id, n, cast(coalesce(sum(n) over (order by volume_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first from n")
def concat_offsets(spark, sf_dir):
    return sampling.with_offsets(grid_len(spark, sf_dir).withColumnRenamed("n_samples", "n"), "volume_id", "n")


@query(
    TILES
    + """, n as (select volume_id, m_z * m_y * m_x as n from wide), o as (select volume_id, coalesce(sum(n) over (order by volume_id rows between unbounded preceding and 1 preceding), 0) as first from n)
select volume_id, idx, cast(idx + first as bigint) as global_idx from tiles join o using (volume_id)"""
)
def validation_indices(spark, sf_dir):
    return _tiles(spark, sf_dir).join(concat_offsets(spark, sf_dir), "volume_id").select("volume_id", "idx", (F.col("idx") + F.col("first")).alias("global_idx"))


WINDOWS = AXES + ", c as (select *, lo + (hi - lo) * f as centre, f from bb, (select unnest([-0.5, 0.0, 0.13, 0.5, 0.98, 2.0])::double as f)), w as (select *, greatest(1, cast(round_even(out * 3.0 / voxel, 0) as bigint)) as r from c), s as (select *, cast(floor((centre - origin) / voxel - r / 2.0) as bigint) as start from w), p as (select *, greatest(0, least(r, -start)) as pad_lo, greatest(0, start) as first from s), q as (select *, greatest(0, least(n, first + r - pad_lo) - first) as valid from p) "


def _windows(spark, sf_dir):
    a = _axes(spark, sf_dir).withColumn("b", G.bounding(F.col("origin"), F.col("n"), F.col("voxel")))
    a = a.withColumn("f", F.explode(F.array(*map(F.lit, (-0.5, 0.0, 0.13, 0.5, 0.98, 2.0))))).withColumn("centre", F.col("b.lo") + (F.col("b.hi") - F.col("b.lo")) * F.col("f"))
    return a.withColumn("r", G.read_voxels(F.col("out"), F.lit(3.0), F.col("voxel")))


@query(WINDOWS + "select volume_id, axis, f, r as read, start, cast(pad_lo as bigint) as pad_lo, cast(valid as bigint) as valid, cast(r - pad_lo - valid as bigint) as pad_hi, valid = 0 as out_of_bounds from q")
def read_window(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("w", G.read_window(F.col("centre"), F.col("origin"), F.col("voxel"), F.col("r"), F.col("n")))
    return w.select("volume_id", "axis", "f", F.col("r").alias("read"), "w.start", F.col("w.pad_lo").cast("long").alias("pad_lo"), F.col("w.valid").cast("long").alias("valid"), F.col("w.pad_hi").cast("long").alias("pad_hi"), (F.col("w.valid") == 0).alias("out_of_bounds"))


@query(WINDOWS + "select volume_id, axis, f, cast(round_even((centre - out * voxel / 2.0 - lo) / voxel, 0) as bigint) as start from c")
def write_window(spark, sf_dir):
    return _windows(spark, sf_dir).select("volume_id", "axis", "f", G.write_start(F.col("centre"), F.col("b.lo"), F.col("voxel"), F.col("out") * F.col("voxel")).alias("start"))


@query(AXES + "select volume_id, axis, case when a < b then a else mid end as lo, case when a < b then b else mid end as hi, greatest(1, cast(round_even((case when a < b then b - a else 0 end) / voxel, 0) as bigint)) as n from sb")
def writer_sampling_box(spark, sf_dir):
    a = _axes(spark, sf_dir).withColumn("b", G.bounding(F.col("origin"), F.col("n"), F.col("voxel"))).withColumn("w", G.writer_sampling(F.col("b.lo"), F.col("b.hi"), F.col("out") * F.col("voxel")))
    return a.select("volume_id", "axis", "w.lo", "w.hi", G.box_voxels(F.col("w.lo"), F.col("w.hi"), F.col("voxel")).alias("n"))


INTERSECT = "with " + R.BOXES + ", n as (select customer, count(distinct source) as n from boxes group by 1), i as (select customer, axis, max(lo) as lo, min(hi) as hi, count(distinct source) as k from boxes group by all), s as (select customer, axis, lo, hi from i join n using (customer) where k = n), common as (select * from s where customer not in (select customer from s where lo >= hi)) "


@query(INTERSECT + "select * from common")
def box_intersection(spark, sf_dir):
    return G.intersect_boxes(R.order_boxes(spark, sf_dir), "customer", "source").select("customer", "axis", "lo", "hi")


@query("with " + R.BOXES + " select customer, axis, min(lo) as lo, max(hi) as hi from boxes group by all")
def box_union(spark, sf_dir):
    return G.unite_boxes(R.order_boxes(spark, sf_dir), "customer")


@query(INTERSECT + "select customer, axis, greatest(1, cast(round_even((hi - lo) / case axis when 'x' then 4.0 else 0.01 end, 0) as bigint)) as n from common")
def box_voxel_shape(spark, sf_dir):
    b = box_intersection(spark, sf_dir)
    return b.select("customer", "axis", G.box_voxels(F.col("lo"), F.col("hi"), F.when(F.col("axis") == "x", 4.0).otherwise(0.01)).alias("n"))


LEVELS = "with lv as (select p_partkey as volume_id, cast(k as int) as level, (4 + p_partkey % 5) * power(2, k) as sz, (4 + p_partkey % 3) * power(2, k) as sy, (4 + p_partkey % 7) * power(2, k) as sx, cast(p_size as double) as t from part, (select unnest(range(5)) as k)), "


def _levels(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4))))
    size = F.array(*[(4 + F.col("p_partkey") % m) * F.pow(F.lit(2.0), "level") for m in (5, 3, 7)])
    return p.select(F.col("p_partkey").alias("volume_id"), "level", size.alias("voxel_size"), F.array(*[F.col("p_size").cast("double")] * 3).alias("target"))


@query(LEVELS + "s as (select *, abs(sz - t) / greatest(t, 1e-9) + abs(sy - t) / greatest(t, 1e-9) + abs(sx - t) / greatest(t, 1e-9) as score from lv) select volume_id, level from (select *, row_number() over (partition by volume_id order by score, level) as rn from s) where rn = 1")
def scale_level_best(spark, sf_dir):
    return catalog.nearest_level(_levels(spark, sf_dir), F.col("target"), ["volume_id"])


@query(LEVELS + "k as (select volume_id, min(level) filter (where sz > t or sy > t or sx > t) as k, max(level) as m from lv group by 1) select volume_id, coalesce(greatest(k - 1, 0), m) as level from k")
def find_level(spark, sf_dir):
    got = catalog.coarsest_not_exceeding(_levels(spark, sf_dir), F.col("target"), ["volume_id"])
    return got.select("volume_id", "level")


@query(
    """with a as (select p_partkey as volume_id, radians(p_size) as t, cast(p_size as double) as n from part)
select volume_id, round(cos(t), 9) as r11, round(-sin(t), 9) as r12, cast(ceil(n) as bigint) as read_z, cast(ceil(n * (abs(cos(t)) + abs(sin(t)))) as bigint) as read_y from a"""
)
def rotated_read_shape(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("volume_id"), F.radians("p_size").alias("t"), F.col("p_size").cast("double").alias("n"))
    m = [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.cos("t"), -F.sin("t")], [F.lit(0.0), F.sin("t"), F.cos("t")]]
    z, y, _ = G.rotated_voxels([F.col("n")] * 3, m)
    return p.select("volume_id", F.round(m[1][1], 9).alias("r11"), F.round(m[1][2], 9).alias("r12"), z.alias("read_z"), y.alias("read_y"))
