"""Operator 10, toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs and pairs that skip a word. Each coordinate has
its own learning rate, and L1 leaves few weights other than zero: those go out with the tasks that score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .langid import held_out, training_ids

BITS = 20
TOKEN = re.compile(r"\w+")
THRESHOLD = 0.7


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text: words, pairs, and pairs with one word left out; the bias stands apart."""
    words = TOKEN.findall((text or "").lower())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = [h]
    for skip, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > skip:
            grams.append((h[:-skip] * np.uint64(salt)) ^ (h[skip:] + np.uint64(salt >> 7)))
    x = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((x >> np.uint64(64 - BITS)).astype(np.int32))


class Ftrl:
    """Weights of a fitted model: numbers and values of those that are not zero, and the bias."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float):
        self.index, self.value, self.bias, self._dense = index, value, bias, None

    def __getstate__(self):
        return {"index": self.index, "value": self.value, "bias": self.bias, "_dense": None}

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 40.0, l2: float = 1.0, passes: int = 6, seed: int = 5, toxic_weight: float = 8.0) -> Ftrl:
        """A toxic row, the rare label, counts toxic_weight times; l1 is on the scale of the weighted gradients."""
        z, n, w = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        rng, bias = np.random.default_rng(seed), np.array([1 << BITS])
        for _ in range(passes if len(rows) else 0):
            for r in rng.permutation(len(rows)):
                i = np.concatenate([rows[r], bias])
                zi, ni = z[i], n[i]
                wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
                g = (toxic_weight if labels[r] else 1.0) * (1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - labels[r])
                z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
                n[i] = ni + g * g
        w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
        index = np.flatnonzero(w[:-1]).astype(np.int32)
        return Ftrl(index, w[index], float(w[-1]))

    def score(self, text: str | None) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.index] = self.value
        return float(1 / (1 + np.exp(-np.clip(self._dense[features(text)].sum() + self.bias, -35, 35))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 6000, per_label_features: int = 6_000_000, **options) -> Ftrl:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic): of each label per_label ids about, and rows of per_label_features features at most.

    Both are documented bounds of the sample: the driver receives four bytes for each feature. Rows are taken in order of a hash of
    their id. Null labels and held-out ids are not learnt from. Of several labels for an id the largest counts.
    """
    base.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "th": batch.column("th"), "i": base.lists([features(t.as_py()) for t in batch.column("text")], np.int32)})

    marks = labels.where("toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).join(training_ids(marks, "toxic", per_label), "doc_id").dropDuplicates(["doc_id", "th"])
    rows = base.stored(rows.select("doc_id", "text", "toxic", "th").mapInArrow(base.lean(run), "doc_id long, toxic int, th long, i array<int>"), "toxic-sample")
    # per_label rows a label: a window over their sizes alone
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "th")
    chosen = rows.select("doc_id", "toxic", "th", F.size("i").alias("n")).withColumn("sum", F.sum("n").over(so_far)).where(F.col("sum") <= per_label_features)
    got = rows.join(F.broadcast(chosen.select("doc_id", "th")), ["doc_id", "th"]).select("doc_id", "th", "toxic", "i").toArrow().sort_by([("doc_id", "ascending"), ("th", "ascending")])
    base.forget(rows)
    return Ftrl.fit([i.values.to_numpy() for i in got["i"]], got["toxic"].to_numpy(), **options)


def score_toxicity(docs: DataFrame, model: Ftrl, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row of docs with its text's score and predicted (1 from THRESHOLD on). A null text scores as an empty one.

    Texts of any length are scored whole; repeated rows each get their row; an empty table gives none.
    """
    base.bounded_batches(docs.sparkSession)
    scored = docs.select(*keep, F.col("text").alias("_text"))
    fields = scored.drop("_text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(t.as_py()) for t in batch.column("_text")]
            cols = {k: batch.column(k) for k in keep}
            yield pa.RecordBatch.from_pydict(cols | {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= THRESHOLD) for x in s], pa.int32())})

    return scored.mapInArrow(base.lean(run), fields)
