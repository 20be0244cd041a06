"""Operator 1, sharding: longest-processing-time scheduling of groups that must stay together.

The schedule of LPT depends on the groups' sizes alone, as groups of one size are interchangeable. So only the
histogram of group sizes goes to the driver: distinct sizes number at most sqrt(2 * total bytes), as d distinct sizes
sum to d*d/2 at least. There a heap of shard loads takes sizes in descending order; many groups of one size are
dealt in bulk, by the level to which they fill the shards, with the heap's result. Groups then find their shard by
their rank among the groups of their size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def _bulk(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count items of one size each shard gets when each item goes to the least load, lowest shard first."""
    low, high = min(loads), max(loads) + size * (count // len(loads) + 2)
    taken = lambda level: [max(0, -(-(level - x) // size)) for x in loads]  # noqa: E731  items started below the level
    while low < high:
        mid = (low + high + 1) // 2
        if sum(taken(mid)) <= count:
            low = mid
        else:
            high = mid - 1
    got = taken(low)
    rest = count - sum(got)
    for i in sorted(range(len(loads)), key=lambda i: (loads[i] + got[i] * size, i))[:rest]:
        got[i] += 1
    return got


def lpt_plan(histogram: dict[int, int], n_shards: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """{size: [(shard, groups)]} and the shards' loads, by LPT over a histogram {group size: groups}."""
    heap = [(0, i) for i in range(n_shards)]
    plan: dict[int, list[tuple[int, int]]] = {}
    for size in sorted(histogram, reverse=True):
        count = histogram[size]
        got = [0] * n_shards
        if count <= 8 * n_shards or size <= 0:
            for _ in range(count):
                load, i = heapq.heappop(heap)
                got[i] += 1
                heapq.heappush(heap, (load + size, i))
        else:
            loads = [0] * n_shards
            for load, i in heap:
                loads[i] = load
            got = _bulk(loads, size, count)
            heap = [(loads[i] + got[i] * size, i) for i in range(n_shards)]
            heapq.heapify(heap)
        plan[size] = [(i, k) for i, k in enumerate(got) if k]
    return plan, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def lpt_shards(items: DataFrame, group: str, size: str, n_shards: int, n_rows: int) -> DataFrame:
    """items plus `shard`: rows with one `group` value share a shard, and shard sizes are those of LPT over groups.

    group is a non-null key, size a positive integer column. An empty table gives an empty result. Ties between groups of one size fall
    by the hash of the key, then the key, so reruns agree.
    """
    spark = items.sparkSession
    groups = items.groupBy(group).agg(F.sum(size).alias("_size")).withColumn("_h", base.uniform(F.hex(group)))
    histogram = {r["_size"]: r["n"] for r in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    plan, _ = lpt_plan(histogram, n_shards)
    rows = []
    for s, runs in plan.items():
        ends, at = [], 0
        for _, k in runs:
            at += k
            ends.append(at)
        rows.append((s, ends, [i for i, _ in runs]))
    dealt = spark.createDataFrame(rows, "_psize long, _ends array<long>, _shards array<int>")
    ranked = base.running_total(groups.withColumn("_one", F.lit(1)), ["_size"], "_h", [group], "_one", "_rank", n_rows)
    placed = ranked.join(dealt, F.col("_size") == F.col("_psize")).select(
        F.col(group).alias("_g"), F.get("_shards", F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))).alias("shard")
    )
    return items.join(placed, F.col(group) == F.col("_g")).drop("_g")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    Law `bytes`: shards hold near equal bytes, as far as groups of equal texts, which are never parted, allow. A null
    text counts as an empty one (size 16, crc32 0, same group). Slots follow the hash of doc_id, then doc_id. Repeated
    rows keep their number; extra columns are ignored. Texts of any length count whole; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = base.stored(
        docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_group")),
        "shard-input",
    )
    n = slim.count()
    out = lpt_shards(slim, "_group", "size", n_shards, n).withColumns({"_h": base.uniform("doc_id"), "_one": F.lit(1)})
    out = base.running_total(out, ["shard"], "_h", ["doc_id", "_group"], "_one", "slot", n)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
