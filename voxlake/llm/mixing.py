"""Operator 8, mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the sources' cumulative targets: slot i goes to the source whose interval holds
frac((i + 1) * phi). Slots are ranked per source; the j-th slot of a source takes the j-th of its equal-token blocks.
A source's documents stand in the order of a seeded hash, as one stream of tokens that starts again at its end, and
its blocks cut what the target takes of that stream into as many equal parts as the source has slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

PHI = (math.sqrt(5) - 1) / 2


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Shares of total by weight, none above cap times its size; the excess is shared again by weight until none is."""
    target = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def targets_of(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[tuple]:
    """[(source, size, target)] with sources by code point, null last. The driver holds one row for each source."""
    rows = docs.groupBy("source").agg(F.sum("size").cast("long").alias("n")).collect()
    rows = sorted(((r["source"], r["n"] or 0) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    goal = capped_targets(sizes, [cycle[i % len(cycle)] for i in range(len(rows))], share * sum(sizes), cap)
    return [(s, n, t) for (s, n), t in zip(rows, goal, strict=True)]


def block_tokens(total: float, n_sources: int, most: int = 4096) -> int:
    """Tokens of a block: 4096, or less where the mix is so small that a source would have few slots."""
    return int(max(1, min(most, total // (500 * max(1, n_sources)))))


def schedule(spark, goals: list[tuple], block: int) -> DataFrame:
    """slot, source index and rank of the slot within its source: the order in which blocks are to be read."""
    total = sum(t for _, _, t in goals)
    n_slots = max(1, round(total / block)) if total > 0 else 0
    ends = np.cumsum([t for _, _, t in goals]) / total if total > 0 else np.zeros(0)
    last = max((i for i, g in enumerate(goals) if g[2] > 0), default=0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("id").to_numpy()
            # the product is reduced in integers, as a double has too few digits for far slots
            points = ((i.astype(np.uint64) + np.uint64(1)) * np.uint64(round(PHI * 2**64) | 1)).astype(np.float64) / 2.0**64
            src = np.minimum(np.searchsorted(ends, points, side="right"), last).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"slot": batch.column("id"), "src": pa.array(src)})

    parts = max(1, min(4000, n_slots // 50_000 + 1))
    slots = spark.range(0, n_slots, 1, parts).mapInArrow(pick, "slot long, src int")
    chunk = slots.withColumn("chunk", F.expr("slot div 4096"))
    counts = chunk.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = chunk.withColumn("in_chunk", F.row_number().over(inside) - 1).join(counts, ["src", "chunk"])
    return ranked.select("slot", "src", (F.col("base") + F.col("in_chunk")).alias("rank"))


def mix(docs: DataFrame, keys: list[str], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(segments, per-document rows) of the mix over docs (keys, source, size).

    Per document: keys, size, source_size, target, taken, and where the schedule puts it: first_slot, last_slot (null if nothing is
    taken), n_segments. Segments: keys, pass, size, slot, start, stop: words
    [start, stop) of the document stand in that slot. Null sizes count as 0; a document of size 0 is taken 0 times and has no segment.
    Documents of one source with equal keys are told apart by nothing and take part each on its own. Empty table: no rows.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    n_rows = docs.count()
    goals = targets_of(docs)
    total = sum(t for _, _, t in goals)
    block = block_tokens(total, len(goals))
    plan = base.stored(schedule(spark, goals, block), "mix-schedule")
    n_slots = {r["src"]: r["n"] for r in plan.groupBy("src").agg(F.count("*").alias("n")).collect()}
    # a source whose share is below one slot still gets one, after all others
    missing = [(sum(n_slots.values()) + j, i, 0) for j, i in enumerate(i for i, g in enumerate(goals) if g[2] > 0 and not n_slots.get(i))]
    if missing:
        plan = plan.unionByName(base.rows_of(spark, missing, "slot long, src int, rank long"))
        n_slots |= {i: 1 for _, i, _ in missing}
    table = base.rows_of(
        spark,
        [(s, i, n, t, round(t), n_slots.get(i, 0)) for i, (s, n, t) in enumerate(goals)],
        "_source string, src int, source_size long, target double, take long, n_slots long",
    )
    docs = docs.join(F.broadcast(table) if len(goals) <= 100_000 else table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("_h", base.uniform(F.lit(seed), *keys))
    docs = base.running_total(docs, ["src"], "_h", [*keys, "size"], "size", "at", n_rows)
    docs = docs.withColumn("_uid", F.struct(*[F.col(k) for k in keys], F.col("src"), F.col("at"), F.col("size")))
    # Where the target goes over the end of the stream, the second pass meets the same documents again.
    passes = docs.where("size > 0 and at < take").withColumn("pass", F.explode(F.expr("sequence(0L, (take - 1 - at) div source_size)")))
    spans = passes.withColumns({"lo": F.expr("at + pass * source_size"), "hi": F.expr("least(at + pass * source_size + size, take)")}).where("hi > lo")
    # block j of a source is [j * take div n, (j + 1) * take div n)
    first, final = F.expr("(cast(lo as decimal(38, 0)) * n_slots + n_slots) div take"), F.expr("(cast(hi - 1 as decimal(38, 0)) * n_slots + n_slots) div take")
    parts = spans.withColumn("rank", F.explode(F.sequence(F.greatest(F.lit(0), first.cast("long") - 1), F.least(F.col("n_slots") - 1, final.cast("long") + 1))))
    edge = lambda j: F.expr(f"cast((cast({j} as decimal(38, 0)) * take) div n_slots as long)")
    parts = parts.withColumns({"from": F.greatest(F.col("lo"), edge("rank")), "to": F.least(F.col("hi"), edge("(rank + 1)"))}).where("to > from")
    segments = parts.join(plan.hint("merge"), ["src", "rank"]).select(*keys, "_uid", "pass", "size", "slot", (F.col("from") - F.expr("at + pass * source_size")).alias("start"), (F.col("to") - F.expr("at + pass * source_size")).alias("stop"))
    taken = segments.groupBy("_uid").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("n_segments"))
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_segments")]
    per_doc = docs.join(taken, "_uid", "left").select(*keys, "size", "source_size", "target", whole[0], "first_slot", "last_slot", whole[1])
    return segments.drop("_uid"), per_doc


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, last_slot, n_segments of each row of docs (doc_id, text, source).

    A null text has size 0, and is taken 0 times; a null source is a source of its own, the last. An empty table gives no rows.
    """
    slim = docs.select("doc_id", "source", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(base.WORD_SQL), F.lit(0))), F.lit(0)).cast("long").alias("size"))
    slim = base.stored(slim.withColumn("size", F.greatest("size", F.lit(0))), "mix-input")
    return mix(slim, ["doc_id"])[1]
