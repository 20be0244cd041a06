"""A Merkle manifest of a dataset: a tree of SHA-256 digests for each source, and one over the sources' roots.

Leaves are digests of rows, so texts are hashed where they are read and only digests move. A tree is cut into aligned blocks of
fan ** height leaves. Executors hand whole blocks, as Arrow buckets, to DuckDB, whose ordered string_agg and sha256 give a level
for each query; Spark combines the blocks' roots, which are the leaves of the next, smaller tree, until one is left. Proofs go the
other way: a block's own path from the tree above is joined to the block as one more row, so that no leaf carries it through a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

FAN, HEIGHT = 16, 3
#: Rows that a task gives to DuckDB at once, at least: whole blocks, so fan ** height more at most.
BUCKET_ROWS = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(column: Column) -> Column:
    """A value as its length in bytes, a colon and itself; `-` for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key, leaf, altered: the leaf of each row, and that of the row with its text in lower case where 5 divides the id's CRC."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    altered = F.when(chosen, leaf(F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").select(F.col("doc_id").cast("long").alias("doc_id"), field(F.col("source")).alias("key"), leaf(F.col("text")).alias("leaf"), altered.alias("altered"))
    return rows.withColumn("altered", F.coalesce("altered", "leaf"))


def source_of(key: Column) -> Column:
    """The source of a key; null sorts first and the rest by bytes, as keys themselves do not."""
    return F.when(key == "-", F.lit(None).cast("string")).otherwise(F.substr(key, F.instr(key, F.lit(":")) + 1))


def ranked(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with r and n: the place of each row in its key's order, and how many rows the key has.

    A range partitioning by key and order spreads a key over as many tasks as its rows want. It is written out with each row's
    place in its part, so counts and places are those of the same parts even if an executor is lost in between.
    """
    ordered = [F.col(key), *order]
    parts = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("_at", F.monotonically_increasing_id())
    parts = base.stored(parts.withColumn("_part", F.spark_partition_id()), name)
    sums = parts.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)})
    return parts.join(sums.drop("_n"), ["_part", key]).withColumn("r", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def blocks(fan: int, height: int) -> dict[str, Column]:
    """From r and n: block and place of a node, how many levels its block has, and the nodes of the tree above."""
    size = fan**height
    steps = F.lit(height)
    for level in reversed(range(height)):
        steps = F.when(F.col("n") <= fan**level, level).otherwise(steps)
    return {"block": F.expr(f"r div {size}"), "i": F.expr(f"cast(r % {size} as int)"), "steps": steps.cast("int"), "above": F.expr(f"(n + {size - 1}) div {size}")}


def whole_blocks(batches: Iterator[pa.RecordBatch], least: int = BUCKET_ROWS) -> Iterator[pa.Table]:
    """Rows sorted by key and block as tables that hold blocks whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        last = pc.and_(pc.equal(table["key"], table["key"][-1]), pc.equal(table["block"], table["block"][-1]))
        cut = pc.index(last, True).as_py()
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def level_queries(fan: int, height: int) -> str:
    """CTEs n0 .. n<height> over the table `nodes`: each level's nodes; runs r0 ..: the digests of each run, in order, as one text."""
    out = "n0 as materialized (select key, block, i, steps, h from nodes where h is not null)"
    for k in range(height):
        out += f", r{k} as materialized (select key, block, i // {fan} as i, any_value(steps) as steps, string_agg(h, '' order by i) as run from n{k} where steps > {k} group by key, block, i // {fan})"
        out += f", n{k + 1} as materialized (select key, block, i, steps, h from n{k} where steps <= {k} union all select key, block, i, steps, sha256(run) from r{k})"
    return out


def path_query(fan: int, height: int) -> str:
    """Of each node its path: for each level the run's other digests, those on its left, a bar, those on its right; then the block's own."""
    steps, joins = [], []
    for k in range(height):
        at = f"64 * (n.i // {fan**k} % {fan})"
        steps.append(f"case when n.steps > {k} then [substr(r{k}.run, 1, {at}) || '|' || substr(r{k}.run, {at} + 65)] else [] end")
        joins.append(f"left join r{k} on r{k}.key = n.key and r{k}.block = n.block and r{k}.i = n.i // {fan ** (k + 1)}")
    outer = "select key, block, path, subroot, root from nodes where h is null"
    own = " || ".join([*steps, "o.path"]) if steps else "o.path"
    return f"with {level_queries(fan, height)}, p as (select n.*, {own} as whole, o.subroot as top, o.root as first from (select * from nodes where h is not null) n join ({outer}) o on o.key = n.key and o.block = n.block {' '.join(joins)})"


#: A digest goes up its path: each level hashes what lies on its left, the digest, what lies on its right.
FOLD = "list_reduce(list_prepend(altered, whole), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2)))"


def in_duckdb(query: str) -> Callable:
    """A query over the table `nodes`, a bucket of whole blocks after another, in one thread of the task's process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        try:
            for bucket in whole_blocks(batches):
                con.register("nodes", bucket)
                yield from con.sql(query).to_arrow_table().to_batches()
                con.unregister("nodes")
        finally:
            con.close()

    return base.lean(run)


def dealt(nodes: DataFrame) -> DataFrame:
    """Each block's rows in one task, in order; a row of the tree above, if it is there, comes first."""
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "i")


def climbed(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """nodes (key, r, n, h) to the roots of their blocks, in the same form: the tree above."""
    query = f"with {level_queries(fan, height)} select key, block as r, h from n{height}"
    cut = nodes.select("key", "r", "n", "h").withColumns(blocks(fan, height))
    roots = dealt(cut.select("key", "block", "i", "steps", "h")).mapInArrow(in_duckdb(query), "key string, r long, h string")
    return roots.join(cut.groupBy("key").agg(F.max("above").alias("n")), "key")


def trees(nodes: DataFrame, fan: int, height: int, name: str) -> list[DataFrame]:
    """nodes and the trees above them, up to one node for each key. A tree has a row for each fan ** height of the one below."""
    out = [nodes]
    while len(out) == 1 or out[-1].agg(F.max("n")).first()[0] not in (None, 1):
        out.append(base.stored(climbed(out[-1], fan, height), f"{name}-{len(out)}"))
    return out


def descended(nodes: DataFrame, above: DataFrame, fan: int, height: int, select: str, schema: str, more: list[str]) -> DataFrame:
    """`select` over the nodes with their whole paths; above (key, r, path, subroot, root) are the nodes of the tree above with theirs."""
    kinds = {"path": "array<string>", "subroot": "string", "root": "string"}
    own = nodes.withColumns(blocks(fan, height)).select("key", "block", "i", "steps", "h", *more, *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    outer = above.select("key", F.col("r").alias("block"), F.lit(-1).alias("i"), F.lit(0).alias("steps"), F.lit(None).cast("string").alias("h"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in more], *kinds)
    return dealt(own.unionByName(outer)).mapInArrow(in_duckdb(f"{path_query(fan, height)} {select}"), schema)


PATHS = "select key, r, whole as path, top as subroot, first as root from p"
PATHS_SCHEMA = "key string, r long, path array<string>, subroot string, root string"
PROOFS = f"select doc_id, h as leaf, top as subroot, first as root, sha256(replace(array_to_string(whole, ''), '|', '')) as proof_sha256, {FOLD} as folded_root from p"
PROOFS_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def manifest(docs: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs (doc_id, source, lang, n_chars, text).

    Rows of one source and id are in the order of their leaves, and rows with no id come first; equal rows are leaves of their own,
    side by side. Nulls in any column have a form of their own, apart from every value; a null source is a tree like any other
    and the first. A text of any length is hashed whole; an empty table gives none; extra columns are ignored. Every executor
    holds a few blocks of digests at a time, so the size of a source is no matter; rows that agree in source, id and leaf,
    which a table with ids does not have, meet in one task.
    """
    rows = base.stored(leaves(docs), "merkle-leaves")
    nodes = base.stored(ranked(rows, "key", [F.col("doc_id"), F.col("leaf")], "merkle-order").withColumnRenamed("leaf", "h"), "merkle-nodes")
    base.forget(rows)
    forest = trees(nodes, fan, height, "merkle-trees")
    subroots = forest[-1].select(F.lit("").alias("key"), F.col("key").alias("tree"), F.col("h"), source_of(F.col("key")).alias("source"))
    tops = base.stored(ranked(subroots, "key", [F.col("source").asc_nulls_first()], "merkle-sources"), "merkle-subroots")
    top = trees(tops, fan, height, "merkle-top")

    paths = top[-1].select("key", "r", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    for tree in reversed(top[:-1]):
        paths = base.stored(descended(tree, paths, fan, height, PATHS, PATHS_SCHEMA, ["r"]), "merkle-paths")
    of_tree = tops.select("r", F.col("tree").alias("key"), F.col("h").alias("subroot"))
    paths = paths.select("r", "path", "root").join(of_tree, "r").withColumn("r", F.lit(0).cast("long"))
    for tree in reversed(forest[1:-1]):
        paths = base.stored(descended(tree, paths, fan, height, PATHS, PATHS_SCHEMA, ["r"]), "merkle-paths")
    found = descended(nodes, paths, fan, height, PROOFS, PROOFS_SCHEMA, ["doc_id", "altered"])
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
