"""How far the sources of a language differ in their words: per pair, the joint histogram of (count, count) over all kept terms.

Terms are counted in each task before anything moves: a task sends a row for each term of a group that it met, however often.
For a pair of sources, f depends on a term only through its two counts, so the terms are tallied by (count, count) and f is
evaluated once for each combination. Only terms that both hold are met by a join; the cells with a zero follow from
each source's own histogram by inclusion and exclusion, and the cell (0, 0) from the number of kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

#: A flush of a task's table at so many entries, or so many bytes of text since the last.
ENTRIES, TEXT_BYTES = 200_000, 64 << 20
#: ASCII letters in lower case and all bytes of other characters; the rest divides terms.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, tf, df of what a task has met; a row without term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    n_bytes = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (tf, df) in groups.items():
            terms = list(tf)
            for at in range(0, len(terms) + 1, 20_000):
                part = terms[at : at + 20_000]
                words = pa.array([*part, *[None] * (at == 0)], pa.binary()).cast(pa.string())
                counts = [pa.array([*(c[t] for t in part), *[0] * (at == 0)], pa.int64()) for c in (tf, df)]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(words), pa.string()) for x in (lang, source)] + [words, *counts], ["lang", "source", "term", "tf", "df"])
        groups.clear()

    for batch in batches:
        for text, lang, source in zip(batch.column("text").cast(pa.binary()), batch.column("lang"), batch.column("source"), strict=True):
            words = (text.as_py() or b"").translate(TERM_BYTES).split()
            tf, df = groups.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
            tf.update(words)
            df.update(set(words))
            n_bytes += len(text.as_py() or b"")
            if n_bytes > TEXT_BYTES or sum(len(g[0]) for g in groups.values()) > ENTRIES:
                yield from flushed()
                n_bytes = 0
    yield from flushed()


def group_counts(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, source, term, c, lang_c, first over docs (text, lang, source): the counts of terms in at least least_docs documents of
    their language, and a row without term for each group. One shuffle, by language and term; `first` marks one row of each term."""
    base.bounded_batches(docs.sparkSession)
    met = docs.select("text", "lang", "source").mapInArrow(base.lean(_count), "lang string, source string, term string, tf long, df long")
    summed = met.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("tf").alias("c"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    summed = summed.withColumns({"docs": F.sum("df").over(of_term), "lang_c": F.sum("c").over(of_term), "first": (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")})
    return summed.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "source", "term", "c", "lang_c", "first")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals, which are exact."""
    return F.expr(f"1 + (cast({count} + 5 as decimal(20, 0)) * 1000000000BD) div cast(greatest({total} + 5 * {terms}, 1) as decimal(21, 0))")


def audit(docs: DataFrame, least_docs: int = 30, most_ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank over docs (text, lang, source): part `pair` for each other source of the language, part
    `term` for the terms that the source uses more than its language does.

    Null text, lang and source are ''. A row is a document, so repeated rows count each; empty texts leave a group without terms,
    whose shares are those of counts of 0; a language without kept terms has pairs of value 0 and no terms. Equal values rank by
    the item's bytes. Texts and terms of any length are taken whole; an empty table gives none; extra columns are ignored. The
    joint tally has at most a row for each pair of sources that share a term, combined before its shuffle; the result itself has a
    row for each ordered pair of sources of a language, so sources, not documents, bound both.
    """
    counts = base.stored(group_counts(docs, least_docs), "divergence")
    kept = counts.where("term is not null")
    of_lang = kept.groupBy("lang").agg(F.sum("c").alias("lang_n"), F.sum("first").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("held"))
    groups = counts.where("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = base.stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "held", "lang_n", "v")]), "divergence-groups")

    a, b = (groups.select("lang", F.col("source").alias(x), F.col("n").alias(f"n_{x}"), F.col("held").alias(f"held_{x}"), *more) for x, more in (("a", ["v"]), ("b", [])))
    pairs = a.join(b, "lang").where("a < b")
    held = {x: kept.groupBy("lang", F.col("source").alias(x), F.col("c").alias(f"c_{x}")).agg(F.count("*").alias("m")) for x in "ab"}
    sides = [kept.select("lang", "term", F.col("source").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab"]
    joint = sides[0].join(sides[1], ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "c_a", "c_b").agg(F.count("*").alias("m"))
    cell = lambda x, y, m: F.struct(x.cast("long").alias("c_a"), y.cast("long").alias("c_b"), m.cast("long").alias("m"))
    none, m = F.lit(0), F.col("m")
    of_pair = ["lang", "a", "b"]
    cells = joint.select(*of_pair, F.explode(F.array(cell(F.col("c_a"), F.col("c_b"), m), cell(F.col("c_a"), none, -m), cell(none, F.col("c_b"), -m), cell(none, none, m))).alias("x")).select(*of_pair, "x.*")
    cells = cells.unionByName(pairs.join(held["a"], ["lang", "a"]).select(*of_pair, "c_a", none.cast("long").alias("c_b"), "m"))
    cells = cells.unionByName(pairs.join(held["b"], ["lang", "b"]).select(*of_pair, none.cast("long").alias("c_a"), "c_b", "m"))
    cells = cells.unionByName(pairs.select(*of_pair, none.cast("long").alias("c_a"), none.cast("long").alias("c_b"), (F.col("v") - F.col("held_a") - F.col("held_b")).alias("m")))
    tally = cells.groupBy(*of_pair, "c_a", "c_b").agg(F.sum("m").alias("m"))
    f = F.abs(share("c_a", "n_a", "v") - share("c_b", "n_b", "v"))
    values = tally.join(pairs, of_pair).groupBy(*of_pair).agg(F.sum(f * F.col("m")).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair_rows = values.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    used = kept.join(groups, ["lang", "source"]).withColumn("value", share("c", "n", "v") - share("lang_c", "lang_n", "v")).where("value > 0")
    term_rows = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = term_rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most_ranks)
    return pair_rows.withColumn("rank", F.row_number().over(by)).unionByName(ranked)
