"""Volumes derived from the given tables, in Spark and as SQL: what the queries of the array engine run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 x 4 volume for each vector: volume_id, label, z, y, x, v."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64).select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 64)).alias("i", "v"))
    return e.select(F.col("vec_id").alias("volume_id"), "label", F.floor(F.col("i") / 16).cast("int").alias("z"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("y"), (F.col("i") % 4).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def cube_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same volumes as patches: sample, source, shape, data. A vector is its volume in C order, so nothing moves."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64)
    return e.select(F.col("vec_id").alias("sample"), F.lit("").alias("source"), F.array(*map(F.lit, (4, 4, 4))).alias("shape"), F.slice("embedding", 1, 64).alias("data"))


def whole_chunks(spark: SparkSession, sf_dir: str, *shape: int) -> DataFrame:
    """The vectors as volumes of some shape and of one chunk each, in the form of operators.scan.chunked."""
    of = cube_patches(spark, sf_dir)
    return of.select(F.col("sample").alias("volume_id"), *[F.lit(0).alias(c) for c in ("cz", "cy", "cx")], F.array(*map(F.lit, shape)).alias("shape"), F.lit(None).cast("array<int>").alias("at"), "data")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 7 x 11 x 50 raster of line items for each return flag: volume_id, z, y, x, v (a count; absent cells are 0)."""
    li = table(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber") - 1).cast("int"), F.bround(F.col("l_discount") * 100).cast("int"), (F.col("l_quantity") - 1).cast("int")
    return li.groupBy(F.col("l_returnflag").alias("volume_id"), at[0].alias("z"), at[1].alias("y"), at[2].alias("x")).agg(F.count("*").alias("v"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of 50 crops hold which class: crop, class."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).cast("int").alias("crop"), F.col("label").alias("class")).distinct()


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of quantities and discounts for each order of a customer: customer, source, axis, lo, hi."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    b = li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_discount").alias("d0"), F.max("l_discount").alias("d1"))
    b = b.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    two = F.array(F.struct(F.lit("y").alias("axis"), F.col("d0").alias("lo"), F.col("d1").alias("hi")), F.struct(F.lit("x").alias("axis"), F.col("q0").alias("lo"), F.col("q1").alias("hi")))
    return b.select(F.col("o_custkey").alias("customer"), F.col("l_orderkey").alias("source"), F.explode(two).alias("b")).select("customer", "source", "b.*")


CUBES = """cubes as (select vec_id as volume_id, label, cast(i // 16 as int) as z, cast((i // 4) % 4 as int) as y, cast(i % 4 as int) as x, cast(v as double) as v
 from (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) where i < 64)"""
RASTER = """raster as (select l_returnflag as volume_id, cast(l_linenumber - 1 as int) as z, cast(round_even(l_discount * 100, 0) as int) as y, cast(l_quantity - 1 as int) as x, count(*) as v
 from lineitem group by all)"""
CROPS = "crops as (select distinct cast(vec_id % 50 as int) as crop, label as class from embeddings)"
BOXES = """per_order as (select o_custkey as customer, l_orderkey as source, min(l_quantity) as q0, max(l_quantity) as q1, min(l_discount) as d0, max(l_discount) as d1
 from lineitem join orders on l_orderkey = o_orderkey group by all),
boxes as (select customer, source, 'y' as axis, d0 as lo, d1 as hi from per_order union all select customer, source, 'x', q0, q1 from per_order)"""
GRID = "grid as (select cast(a.i as int) as dz, cast(b.i as int) as dy, cast(c.i as int) as dx from range({0}) a(i), range({1}) b(i), range({2}) c(i))"


def grid(*shape: int) -> str:
    return GRID.format(*shape)


def permuted_sql(index: str, n: str, name: str) -> str:
    """functions.rng.permuted as SQL: index and n are bigint expressions, name a text expression."""
    key = f"cast('0x' || substr(md5({name} || ':' || i || ':key'), 1, 12) as bigint) % {n}"
    partner = f"((({key} - x) % {n} + {n}) % {n})"
    return f"list_reduce(list_prepend({index}, range(0, cast(6 * length(bin({n} - 1)) + 6 as bigint))), lambda x, i: case when md5({name} || ':' || i || ':' || greatest(x, {partner})) >= '8' then {partner} else x end)"
