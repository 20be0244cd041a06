"""What bounds the memory of executors: Arrow batches of 1 MB, and dealing that does not depend on the size of a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from voxlake.llm import base, ngram_join, suffix_dedup


def test_batches_hold_a_megabyte(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    base.bounded_batches(spark)
    texts = spark.range(400).select(F.repeat(F.lit("x"), 20_000).alias("text")).coalesce(1)
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 8e6 and max(found) < 1.2e6


def dealt(run, batch):
    return [x.to_pydict() for x in run(iter(batch if isinstance(batch, list) else [batch]))]


def cut(batch, n):
    return [batch.slice(i, n) for i in range(0, batch.num_rows, n)]


def test_grams_of_small_batches_are_dealt_together():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(500, 40, replace=False)).astype(np.int64) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"c": pa.array(range(300), pa.int64()), "first": base.lists(rows)})
    run = ngram_join._packed("first", 7, 3)
    assert dealt(run, batch) == dealt(run, cut(batch, 10))


def test_anchors_of_small_batches_are_dealt_together():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 600, dtype=np.uint8)).decode()
    texts = [shared + bytes(rng.integers(97, 123, 900, dtype=np.uint8)).decode() for _ in range(60)] + [None, "", "short"]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_pydict({"id": ids, "th": ids, "text": pa.array(texts, pa.string())})
    run = suffix_dedup._packed(7)
    whole = dealt(run, batch)
    assert whole and whole == dealt(run, cut(batch, 4))


def test_gathered_loses_no_row_and_stays_near_the_bound():
    parts = [np.arange(n) for n in (3, 0, 5, 1, 12, 2)]
    found = list(base.gathered(iter(parts), 8))
    assert [len(x) for x in found] == [8, 13, 2] and np.concatenate(found).tolist() == np.concatenate(parts).tolist()
    assert list(base.gathered(iter([np.arange(0)]), 8)) == []
