"""What the operators share: words, shared-folder tables, Arrow batches and distributed running totals."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable

#: A word is a run without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Arrow batches are bounded by bytes, not only by rows, as texts differ by four orders of magnitude. A buffer is doubled as it
#: grows: those of 1 MB stay within the chunks that the JVM's allocator keeps, larger ones are left behind in malloc's arenas.
BATCH_BYTES = 1 << 20
#: Rows of a vector of the Parquet reader: its arrays hold all their bytes, and rows here are texts, or binaries of some 20 kB.
READER_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Set a byte bound on Arrow batches and a row bound on the Parquet reader's (idempotent; Arrow's row bound stays as the session has it)."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session that is one process gets
    a folder of its own (tests); a cluster is refused, as its executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="voxlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark then removes a query's shuffle files when it has ended; what is written is read from the folder, not from them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxlake-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that the driver holds, by way of Arrow: rows given as lists start Python workers of another kind beside those of the plans."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    arrays = [pa.array(c, kinds[f.split(" ")[1]]) for c, f in zip(columns, schema.split(", "), strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names))


def lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    """Arrays of one kind as the lists of an Arrow column."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, kind)))


def gathered(parts: Iterator[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """Arrays put together until they have `most` rows: what is dealt to buckets then depends less on the size of a batch."""
    held, n = [], 0
    for rows in parts:
        held.append(rows)
        n += len(rows)
        if n >= most:
            together, held, n = np.concatenate(held), [], 0
            yield together
    if n:
        yield np.concatenate(held)


def lean(run: Callable) -> Callable:
    """run over Arrow batches, then what the worker has freed goes back to the system: workers live on from stage to stage."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return over


def forget(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "voxlake-" in path.getName():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def uniform(*columns) -> Column:
    """A uniform signed 64-bit hash: the first half of the MD5 of the columns as texts, with a colon between; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).cast("binary")), 1, 16), 16, -10).cast("long")


def bucket_bits(n_rows: int, per_bucket: int = 2000) -> int:
    """Bits of a uniform hash that leave about per_bucket rows in each bucket, whatever the table's size."""
    return max(0, min(40, math.ceil(math.log2(max(1, n_rows) / per_bucket))))


def running_total(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, out: str, n_rows: int) -> DataFrame:
    """Exclusive running sum of `value` within `keys`, in the order of the uniform 64-bit hash `order`, then `ties`.

    Two levels: the high bits of the hash cut each key into ordered buckets of bounded size, the buckets' sums are
    cumulated, and only rows of one bucket meet in one window. So a key that holds most of the rows is spread over
    as many tasks as it has buckets.
    """
    bits = bucket_bits(n_rows)
    cut = F.shiftright(F.col(order), 64 - bits) if bits else F.lit(0).cast("long")
    df = df.withColumn("_b", cut.cast("long"))
    sums = df.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    on = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(sums, on).withColumn(out, F.col("_base") + F.col("_in")).drop("_b", "_kb", "_base", "_in", *[f"_k{i}" for i in range(len(keys))])
