"""Tables that cut lineage, in the folder all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that are broadcast; more of them meet the other side in a shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark) -> str:
    """The session's ``spark.checkpoint.dir``. A local session without one (tests) gets its own; on a cluster a folder of
    one machine would lose rows, so one must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table of narrow rows that is cheap to count, to be broadcast if it has at most ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def remove(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for an operator's intermediate tables, which goes when its result is written."""

    def __init__(self, spark, what: str):
        self.spark, self.path = spark, scratch_path(spark, what)

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.path}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, what: str) -> DataFrame:
        """``df`` written elsewhere, and this folder gone."""
        out = written(df, what)
        remove(self.spark, self.path)
        return out
