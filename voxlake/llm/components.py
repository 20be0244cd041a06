"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): the label is the least node of the component. Self-links count as no link.

    A node's least neighbour is an aggregate with map-side sums, so a hub is spread over tasks.
    """
    e, told = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None)
    while told[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, last = told, e
        e, told = _kept(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), told[0])
        base.forget(last)
        if told == before:
            break
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def _kept(e: DataFrame, about: int | None) -> tuple[DataFrame, tuple]:
    """The links stored, with their number and a sum of hashes, which the write itself observes. Few links go to few files."""
    seen = Observation()
    e = e.coalesce(max(1, about // 200_000)) if about is not None and about < 2_000_000 else e
    e = base.stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    return e, (seen.get["n"], seen.get["h"])
