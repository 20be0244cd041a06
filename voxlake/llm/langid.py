"""Operator 7, language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character n-grams (1 to 3) of unit length. Each language has several centroids,
found by spherical k-means over a bounded sample of labelled rows. A text gets the language of the centroid with the
largest cosine; one that is farther from it than nearly all of the centroid's own training texts is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

DIMS = 4096
LETTER = re.compile(r"[^\W\d_]")
PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a lower-cased text; what is no letter is a space, and runs of it are one."""
    text = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    a = c * PRIMES[0]
    grams = [a]
    if len(c) > 1:
        grams.append(a[:-1] ^ (c[1:] * PRIMES[1] + np.uint32(0x9E3779B9)))
    if len(c) > 2:
        grams.append(grams[1][:-1] * np.uint32(31) ^ (c[2:] * PRIMES[2]))
    h = np.concatenate(grams)
    h ^= h >> np.uint32(15)
    h *= PRIMES[1]
    return np.bincount(h >> np.uint32(20), minlength=DIMS).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Centroids:
    """What predicts: idf, unit centroids, the language and the least usual cosine of each."""

    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, least: np.ndarray):
        self.langs, self.idf, self.centres, self.least = langs, idf, centres, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        cosine = self.centres @ unit(np.log1p(ngram_counts(text)) * self.idf)
        j = int(cosine.argmax())
        return self.langs[j], float(min(1.0, max(0.0, cosine[j]))), bool(cosine[j] < self.least[j])


def centroids_of(x: np.ndarray, per_language: int = 4, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, list[float]]:
    """Spherical k-means over unit vectors of one language: unit centroids, and the least usual cosine of each."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:per_language]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = unit(np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
    best, near = (x @ c.T).max(1), (x @ c.T).argmax(1)
    return c, [float(0.8 * np.quantile(best[near == j], 0.01)) if (near == j).any() else 0.0 for j in range(len(c))]


def training_ids(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """doc_id and label of at most per_label rows of each label: all, if there are no more, or those whose hash of doc_id is below
    a threshold that leaves per_label or fewer (but for a chance of one in a billion).

    No label meets in one task: each is counted, and rows are kept one by one. The result, per_label rows a label, may be broadcast.
    """
    few = max(1.0, per_label - 6 * per_label**0.5)
    share = labels.groupBy(label).agg(F.count("*").alias("_n")).select(F.col(label).alias("_label"), F.when(F.col("_n") <= per_label, 1.0).otherwise(few / F.col("_n")).alias("_share"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    return F.broadcast(labels.join(share, F.col(label) == F.col("_label")).where(place < F.col("_share")).select("doc_id", label))


def fit_languages(train: DataFrame, per_label: int = 1000, per_language: int = 4) -> Centroids:
    """Fit on train (doc_id, text, lang), at most per_label rows of each language (the documented bound; null langs go).

    Each language's sample is clustered in a task of its own; the driver gets its centroids. Of a doc_id with several texts the one
    of least hash is learnt from.
    """
    base.bounded_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for text in batch.column("text"):
                counts = ngram_counts(text.as_py() or "")
                some = np.flatnonzero(counts).astype(np.int32)
                index.append(some)
                value.append(counts[some])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "i": base.lists(index, np.int32), "v": base.lists(value, np.float32)})

    ids = training_ids(train.where("lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang").distinct(), "lang", per_label)
    rows = train.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text").alias("th")).join(ids, ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct("th", "text")).alias("text"))
    rows = base.stored(rows.mapInArrow(base.lean(run), "doc_id long, lang string, i array<int>, v array<float>"), "lang-sample")
    total = rows.count()
    held = rows.select(F.explode("i").alias("i")).groupBy("i").count().toArrow()  # DIMS rows at most
    df = np.zeros(DIMS)
    df[held["i"].to_numpy()] = held["count"].to_numpy()
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        counts = np.zeros((table.num_rows, DIMS), np.float32)
        for n, (i, v) in enumerate(zip(table["i"], table["v"], strict=True)):
            counts[n, i.values.to_numpy()] = v.values.to_numpy()
        c, least = centroids_of(unit(np.log1p(counts) * idf), per_language)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c), pa.string()), "j": pa.array(range(len(c)), pa.int32()), "centre": base.lists(list(c.astype(np.float32)), np.float32), "least": pa.array(least, pa.float64())})

    got = rows.groupBy("lang").applyInArrow(cluster, "lang string, j int, centre array<float>, least double").toArrow().sort_by([("lang", "ascending"), ("j", "ascending")])
    base.forget(rows)
    centres = np.array([x.values.to_numpy() for x in got["centre"]], np.float32).reshape(-1, DIMS)
    return Centroids(got["lang"].to_pylist(), idf, centres, got["least"].to_numpy())


def predict_languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs (doc_id, text).

    lang_pred is `und` for a null text and for one without a letter (and for all, had the fit no row). rejected: farther from its
    centroid than usual; lang_pred still names it. Of equal cosines the first centroid in order of languages counts.
    Texts of any length are taken whole; repeated rows each get their row; an empty table gives none; extra columns are ignored.
    """
    base.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([r[0] for r in rows], pa.string()),
                "score": pa.array([r[1] for r in rows], pa.float64()), "rejected": pa.array([r[2] for r in rows], pa.bool_()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id").alias("held_out")).mapInArrow(base.lean(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str):
    """Whether crc32 of the id as text leaves 1 by 3: such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
