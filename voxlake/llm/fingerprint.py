"""Operator 2, document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a weighted set: its terms are words, the weights their counts. For each term and each sample k, hashes of both give
r, c ~ Gamma(2, 1) and b ~ U(0, 1). A weight w falls on the grid t = floor(ln w / r + b), with y = exp(r (t - b)), and the
sample keeps the term of least c / (y exp(r)) with its t. Two texts keep the same (term, t) with a probability equal to
their generalised Jaccard similarity, the sum of lesser weights over the sum of greater ones.

The rows of terms never leave the task that reads a text: counts and least values are aggregates whose map side meets
all terms of a text, so the shuffles carry a signature for each text, not its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

SAMPLES = 64
#: Samples that one aggregate row takes; few enough for the compiled method to stay small.
LANES = 8
#: Entries of the quantile tables of r and of ln c, powers of two.
R_STEPS, C_STEPS = 1024, 4096
SPLIT = r"[\x20\x09-\x0D]+"


def gamma_quantile(u: float) -> float:
    """x with P(Gamma(2, 1) <= x) = 1 - (1 + x) exp(-x) = u."""
    import math

    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        if 1 - (1 + mid) * math.exp(-mid) < u:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def tables() -> tuple[list[float], list[float]]:
    """Gamma(2, 1) and the logarithm of Gamma(2, 1) at the middles of equal steps of probability."""
    import math

    return [gamma_quantile((i + 0.5) / R_STEPS) for i in range(R_STEPS)], [math.log(gamma_quantile((i + 0.5) / C_STEPS)) for i in range(C_STEPS)]


def _constant(values: list[float]) -> Column:
    """An array literal: the optimiser folds the cast of the split text."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def sample(k: Column, term: Column, log_weight: Column, r_table: Column, c_table: Column) -> Column:
    """One long whose least value over terms is sample k: ln a in the high 32 bits, a hash of (term, t) in the low 32."""
    h = F.xxhash64(term, k)
    r = F.get(r_table, h.bitwiseAND(F.lit(R_STEPS - 1)).cast("int"))
    log_c = F.get(c_table, F.shiftrightunsigned(h, 10).bitwiseAND(F.lit(C_STEPS - 1)).cast("int"))
    b = F.shiftrightunsigned(h, 22).bitwiseAND(F.lit((1 << 20) - 1)) * (1.0 / (1 << 20))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    kept = F.shiftrightunsigned(h, 32).bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(((log_a + 64) * float(1 << 24)).cast("long"), 32).bitwiseOR(kept)


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and sig (array of `samples` longs) for each text with a word in texts (keys, text); keys are unique.

    If texts is already distributed by some of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, F.explode(F.split("text", SPLIT)).alias("word")).where("word <> ''")
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    weighted = terms.select(*keys, "term", F.log(F.col("n").cast("double")).alias("w"))
    r, c = map(_constant, tables())
    lanes = weighted.withColumn("lane", F.explode(F.array(*[F.lit(i) for i in range(0, samples, LANES)])))
    one = [F.min(sample(F.col("lane") + k, F.col("term"), F.col("w"), r, c)).alias(f"s{k}") for k in range(LANES)]
    least = lanes.groupBy(*keys, "lane").agg(*one)
    part = F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(LANES)])
    whole = least.groupBy(*keys).agg(*[F.max(F.when(F.col("lane") == i, part)).alias(f"l{i}") for i in range(0, samples, LANES)])
    return whole.select(*keys, F.concat(*[F.col(f"l{i}") for i in range(0, samples, LANES)]).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two signatures have in common; texts without words are like each other alone."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def written(sig: Column) -> Column:
    """A signature as text, eight hexadecimal digits for each sample; `-` for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit("-"))


def ranges(docs: DataFrame, per_range: int, most: int = 100_000, quantiles: int = 1024) -> tuple[Column, int]:
    """A column that numbers ranges of doc_id, in order, of about per_range rows, and about how many there are; null ids come first.

    Up to `quantiles` bounds are quantiles of doc_id, so that ids may lie anywhere in a long; between them ranges are of equal width.
    Spark finds quantiles as doubles: ids beyond 2 ** 53 are told apart as far as a double does, which ranges do not depend on otherwise.
    """
    parts = docs.agg(F.count("*")).first()[0]
    parts = max(1, min(most, -(-parts // per_range)))
    cuts = min(quantiles, parts)
    found = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts)], 10 * quantiles)).first()[0]
    bounds = sorted(set(found or [0]))
    array = F.array(*[F.lit(x).cast("long") for x in bounds])
    at = F.greatest(F.size(F.filter(array, lambda x: x <= F.col("doc_id"))), F.lit(1))
    inner = -(-parts // cuts)
    if inner == 1:
        number = at.cast("long")
    else:  # beyond quantiles * per_range rows; as doubles, which keep the order
        high = docs.agg(F.max("doc_id")).first()[0]
        widths = [max(1.0, (float(b) - float(a)) / inner) for a, b in zip(bounds, [*bounds[1:], high if high is not None else 0], strict=True)]
        step = (F.col("doc_id").cast("double") - F.element_at(array, at).cast("double")) / F.element_at(F.array(*map(F.lit, widths)), at)
        number = at.cast("long") * inner + F.least(F.greatest(F.floor(step), F.lit(0)), F.lit(inner - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(number), parts


def with_next(docs: DataFrame, per_bucket: int = 1000) -> DataFrame:
    """bucket, at, ghost, doc_id, text, next_text: each row with its successor's text by (doc_id, text), the first after the last.

    Rows are dealt by ranges of doc_id, and each bucket also gets a ghost of the first row of the next bucket, so that no
    window spans the table. Null ids come first. The result is distributed by bucket, ordered in it by `at`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    number, parts = ranges(rows.select("doc_id"), per_bucket)
    rows = rows.withColumn("bucket", number)
    # as many rows as ranges: one window, and a broadcast, of bounded size
    firsts = base.stored(rows.groupBy("bucket").agg(F.min("doc_id").alias("first")), "print-firsts")
    order = Window.orderBy("bucket")
    final = firsts.agg(F.max("bucket")).first()[0]
    into = firsts.select("first", F.coalesce(F.lag("bucket").over(order), F.lit(final)).alias("into"))
    ghosts = rows.join(F.broadcast(into), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("into").alias("bucket"), F.lit(True).alias("ghost"))
    inside = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text")
    # as many partitions as buckets: the terms of some thousand texts are counted in memory
    both = rows.withColumn("ghost", F.lit(False)).select("doc_id", "text", "bucket", "ghost").unionByName(ghosts).repartition(parts, "bucket")
    return both.select("bucket", "ghost", "doc_id", "text", F.row_number().over(inside).alias("at"), F.lead("text").over(inside).alias("next_text"))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text).

    edited: the last floor(n_chars / 4) code points give way to the first as many, or all, of the next row's text. A null
    text counts as empty. Rows that share a doc_id follow each other by text; each keeps its own result.
    Rows of one id, or without one, are one bucket and so one task, which a table whose ids are keys does not have. Texts of any
    length are taken whole; one task holds one text's terms. An empty table gives none; extra columns are ignored.
    """
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "ghost", "doc_id", "at", "text", edited.alias("edited"))
    two = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.when(~F.col("ghost"), F.col("edited")).alias("text")))
    texts = rows.select("bucket", "at", F.explode(two).alias("x")).select("bucket", "at", "x.version", "x.text").where("text is not null")
    sig = signatures(texts, ["bucket", "at", "version"], samples)
    sig = sig.groupBy("bucket", "at").agg(F.max(F.when(F.col("version") == 0, F.col("sig"))).alias("own"), F.max(F.when(F.col("version") == 1, F.col("sig"))).alias("other"))
    facts = rows.select("bucket", "ghost", "at", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = facts.join(sig, ["bucket", "at"], "left")
    follow = Window.partitionBy("bucket").orderBy("at")
    both = both.withColumn("after", F.lead("own").over(follow)).where("not ghost")
    return both.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
