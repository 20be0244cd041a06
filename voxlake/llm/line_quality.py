"""Operator 6, quality rules: cross-document line frequency.

Lines are normalised (lower case, digits to 0, white space runs to one space), hashed, and counted by distinct
documents of each host; equal texts are one document, as copies are the job of deduplication, not of this rule. A line
in more documents of its host than the limit is boilerplate and goes; a document that keeps too little is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

SYMBOLS = "#*$%&|<>"
DIGIT = re.compile(r"[0-9]")


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = base.WORD.findall(text)
    n = len(words)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif base.WORD.search(line):
            seen.add(line)
    repeat = 0
    if n >= 3:
        index: dict[str, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
        if len(counts) < n - 2:
            again = counts[inverse] > 1
            inside = np.zeros(n, bool)
            for shift in range(3):
                inside[shift : shift + n - 2] |= again
            repeat = int(inside.sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def normalised_lines(text: str) -> tuple[list[int], list[int]]:
    """64-bit hashes of the distinct normalised lines that hold a word, and the words that each takes in the text."""
    import xxhash

    found: dict[int, int] = {}
    for line in text.split("\n"):
        words = base.WORD.findall(line)
        if words:
            h = xxhash.xxh3_64_intdigest(DIGIT.sub("0", " ".join(words).lower())) - (1 << 63)
            found[h] = found.get(h, 0) + len(words)
    return list(found), list(found.values())


def line_rules(docs: DataFrame, host: str = "source", min_documents: int = 50, host_share: float = 0.01, keep_share: float = 0.5) -> DataFrame:
    """One row for each row of docs (doc_id, text, host column) with the base figures, base_failed, kept, n_line_words_removed.

    A line is removed above max(min_documents, host_share * the host's distinct documents). kept: not base_failed, and
    at least keep_share of the words remain. A null text counts as one without words; a null host is a host of its
    own; repeated rows are one document to the counts and keep their rows. Texts of any length are taken whole; an empty table
    gives none; extra columns are ignored.
    """
    import xxhash

    spark = docs.sparkSession
    base.bounded_batches(spark)
    fields = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, line_words array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                lines, n = normalised_lines(text)
                rows.append((*text_stats(text), xxhash.xxh3_64_intdigest(text) - (1 << 63), lines, n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "lines", "line_words"]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "host": batch.column("host")} | {k: pa.array(v, t) for k, v, t in zip(names, cols, kinds, strict=True)})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), "text").mapInArrow(base.lean(run), fields)
    table = base.stored(read.withColumn("row", F.monotonically_increasing_id()), "line-rules")
    hosts = table.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("n")).select(F.col("host").alias("h"), F.greatest(F.lit(min_documents), F.col("n") * host_share).alias("most"))
    counts = table.select("host", "text_hash", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    # Only lines over the smallest limit can be over any limit; they are 1 in min_documents of all at most.
    over = counts.where(F.col("n") > min_documents).join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.col("most"))
    over = base.stored(over.select("host", "line"), "line-rules-over")
    small = over.count() <= 200_000
    each = table.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    slim = over.select(F.col("host").alias("h"), F.col("line").alias("l"))
    hit = each.join(F.broadcast(slim) if small else slim, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    gone = hit.groupBy("row").agg(F.sum("words").cast("long").alias("gone"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = table.drop("lines", "line_words").join(gone, "row", "left").withColumns({"gone": F.coalesce("gone", F.lit(0).cast("long")), "base_failed": failed})
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("gone") >= keep_share * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("gone").alias("n_line_words_removed"))
