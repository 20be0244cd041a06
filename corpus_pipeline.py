"""A corpus pipeline over documents: toxic texts go, near copies go, repeated passages go, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
docs of the next. All but the last return doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import base, mixing, ngram_join, queries, sp_bpe, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, does not reject; labels are no input of a score."""
    model = toxicity.fit_toxicity(docs, base.read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, ("doc_id", "lang", "source", "n_chars", "text")).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard links of 0.8 or more: the one of least doc_id (nulls last; then text hash).

    Texts without words are linked with nothing and stay. Rows that repeat a doc_id and its text are one document.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 that occur twice; documents of which no word is left go."""
    cut = suffix_dedup.dedup_documents(docs, ("doc_id", "lang", "source", "n_chars"), text=True)
    untouched = F.col("n_removed") == 0
    kept = cut.where(untouched | F.col("kept_text").rlike(base.WORD_SQL))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(untouched, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long").alias("n_chars"))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pass over a document with the words that it takes, and what stands between them."""
    for batch in batches:
        source, texts = [], []
        for i, (text, passes) in enumerate(zip(batch.column("_text"), batch.column("passes"), strict=True)):
            text, words = text.as_py() or "", None
            for p in passes.as_py():
                if p["start"] == 0 and p["stop"] == p["size"]:
                    part = text
                else:
                    words = words or [m.span() for m in base.WORD.finditer(text)]
                    part = text[words[p["start"]][0] : words[p["stop"] - 1][1]]
                source.append(i)
                texts.append(part)
        at = pa.array(source, pa.int64())
        rest = {k: batch.column(k).take(at) for k in ("doc_id", "lang", "source")}
        yield pa.RecordBatch.from_pydict({"doc_id": rest["doc_id"], "text": pa.array(texts, pa.string()), "lang": rest["lang"], "source": rest["source"], "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each pass of the mix over a document as a row with the words taken; documents that the mix leaves out go."""
    base.bounded_batches(spark)
    sized = docs.select("doc_id", F.xxhash64("text").alias("th"), "source", F.greatest(F.lit(0), F.coalesce(F.size(F.regexp_extract_all("text", F.lit(base.WORD_SQL), F.lit(0))), F.lit(0))).cast("long").alias("size"))
    segments, _ = mixing.mix(base.stored(sized, "pipeline-sizes"), ["doc_id", "th"])
    passes = segments.groupBy("doc_id", "th", "pass", "size").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    lists = passes.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("pass", "start", "stop", "size"))).alias("passes"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "lang", "source", F.col("text").alias("_text"))
    both = texts.join(lists.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "lang", "source", "_text", "passes")
    return both.mapInArrow(base.lean(_passages), "doc_id long, text string, lang string, source string, n_chars long")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids, with begin and end, of each row."""
    base.bounded_batches(spark)
    return sp_bpe.encode_documents(docs, queries.tokenizer_path(), ids=True)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("suffix_dedup", drop_repeats), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Stages 1, 2 and 5 have no SQL form of a size that runs; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = base.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        base.forget(docs)  # of the tables that stored() wrote: the input stays
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
