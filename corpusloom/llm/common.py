"""Shared plumbing of the training-data operators: tables, the shared scratch folder, memory-bounded slices."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns: space and \x09-\x0D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows that a reader or an Arrow transfer holds at once. Texts take kilobytes on average and megabytes at most, so the
#: defaults (4096 and 10000 rows) would allocate tens of megabytes per column and task.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_DEFAULTS = {"4096", "10000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts; the session's batches become small unless someone chose their size."""
    for key, rows in BATCHES.items():
        if spark.conf.get(key, None) in _DEFAULTS:
            spark.conf.set(key, rows)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without one gets its own, as in tests;
    on a cluster a folder of one machine would lose rows, so one must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    made = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Narrow rows that one task handles at least; fewer are not worth a task each for every shuffle partition.
ROWS_A_TASK = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more tasks than these fill: a no-op where they fill all partitions."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder for an operator's intermediate tables, which goes when the operator has written its result."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, scratch_path(spark, what)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a filter for each hash in it, and its most bits (128 MB); a fuller filter lets more strangers pass.
FILTER_BITS, MOST_BITS = 16, 1 << 30


def bit_filter(rows: DataFrame, column: str, per_row: int = FILTER_BITS):
    """A broadcast bit filter of the 64-bit hashes in ``column`` of a table that is cheap to count.

    Bits meet by OR in an aggregation, so what reaches the driver is the filter, of bounded size, and no list of hashes.
    """
    bits = min(MOST_BITS, max(1 << 10, 1 << (per_row * rows.count()).bit_length()))
    h = F.col(column)
    slot, value = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(bits // 64 - 1).cast("long")), F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    made = rows.select(slot.alias("slot"), value.alias("value")).groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[made.column("slot").to_numpy()] = made.column("value").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(out)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which ``hashes`` (uint64) pass the bits of a filter: all that are in it, and few others."""
    at = (hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[at] >> (hashes & np.uint64(63))) & np.uint64(1) == 1


def words_of(text: Column) -> Column:
    """Maximal runs without space or \\x09-\\x0D; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator's results would clash with, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(sizes, limit: int):
    """Consecutive index ranges whose sizes add up to at most ``limit`` (a single larger item stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
