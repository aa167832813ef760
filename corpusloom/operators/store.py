"""The library's stored tables: inserts, upserts, updates and deletions, and versioned steps of their schemas.

A table lies in BUCKETS partitions by a hash of its key. A change reads and rewrites only the buckets of the keys that it
names, by dynamic partition overwrite; an insert only appends. Every step of a schema may be taken again: a column that is
there is not added twice, so a table of any version comes to the last one with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from ..sources.scratch import scratch_path, written
from .library import upserted

BUCKETS = 32


def with_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """``table`` with the column, which rows that are there get as ``default``; unchanged if it has it."""
    return table if name.lower() in {c.lower() for c in table.columns} else table.withColumn(name, F.lit(default).cast(kind))


#: Steps of the run table; a table of version k has taken the first k.
RUN_STEPS: tuple[Callable[[DataFrame], DataFrame], ...] = (
    lambda t: with_column(t, "evergreen", "boolean", False),
    lambda t: with_column(t, "created_by", "string"),
    lambda t: with_column(t, "categories", "string", ""),
    lambda t: with_column(t, "use_prior", "boolean", True),
    lambda t: with_column(t, "kind", "string", "research"),
    lambda t: with_column(t, "brief_id", "long"),
    lambda t: with_column(t, "has_matrix", "int"),
    # What "no matrix" means has changed: rows that were settled so are unknown again.
    lambda t: t.withColumn("has_matrix", F.when(F.col("has_matrix") != 0, F.col("has_matrix"))),
)


def migrated(table: DataFrame, version: int, steps=RUN_STEPS) -> DataFrame:
    """A table of ``version`` as of the last one."""
    for step in steps[version:]:
        table = step(table)
    return table


class Table:
    """A stored table of rows with a unique ``key``; its versions are folders, of which the last whole one counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, steps=()):
        self.spark, self.path, self.key, self.steps = spark, path.rstrip("/"), key, tuple(steps)

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:04d}"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def version(self) -> int | None:
        """The last version that was written whole."""
        for v in range(len(self.steps), -1, -1):
            fs, target = self._fs(f"{self._folder(v)}/_SUCCESS")
            if fs.exists(target):
                return v
        return None

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self._folder(self.version())).drop("_bucket")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(BUCKETS)).cast("int"))

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        """A whole version is written with mode "error" or "whole", which end with _SUCCESS; "overwrite" replaces buckets."""
        out = self._bucketed(rows).hint("rebalance", "_bucket").write.partitionBy("_bucket")
        out = out.option("partitionOverwriteMode", "static" if mode == "whole" else "dynamic")
        out.mode("overwrite" if mode == "whole" else mode).parquet(self._folder(version))

    def create(self, rows: DataFrame, version: int | None = None) -> None:
        """The first rows, of a table that has taken ``version`` steps (all, if none is given)."""
        self._write(rows, len(self.steps) if version is None else version, "error")

    def migrate(self) -> int:
        """Takes the steps that are missing, in one pass; returns their number. The old version stays until it is dropped."""
        now = self.version()
        if now == len(self.steps):
            return 0
        # An attempt that was cut short left no _SUCCESS and is written over.
        self._write(migrated(self.read(), now, self.steps), len(self.steps), "whole")
        return len(self.steps) - now

    def insert(self, rows: DataFrame) -> None:
        self._write(rows.select(*self.read().columns), self.version(), "append")

    def _buckets(self, keys: DataFrame) -> DataFrame:
        """The rows in the buckets of ``keys``: at most BUCKETS numbers come to the driver."""
        some = [r[0] for r in self._bucketed(keys.select(self.key)).select("_bucket").distinct().collect()]
        return self.spark.read.option("mergeSchema", "true").parquet(self._folder(self.version())).where(F.col("_bucket").isin(some)).drop("_bucket")

    def upsert(self, rows: DataFrame, order: str) -> None:
        """Rows in place of those of their key; of several rows of one key the latest by ``order``."""
        old = self._buckets(rows)
        self._write(written(upserted(old, rows.select(*old.columns), [self.key], order), "upserted"), self.version(), "overwrite")

    def update(self, keys: DataFrame, values: dict[str, Column]) -> None:
        """``values`` in the rows of ``keys``; keys that are not there change nothing."""
        old, hit = self._buckets(keys), keys.select(F.col(self.key).alias("_hit")).distinct()
        marked = old.join(hit, old[self.key] == hit["_hit"], "left")
        made = marked.select(*[F.when(F.col("_hit").isNotNull(), values[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns])
        self._write(written(made, "updated"), self.version(), "overwrite")

    def delete(self, keys: DataFrame) -> None:
        """The rows of ``keys`` go; a bucket that is left empty is dropped."""
        old = self._buckets(keys)
        left = written(old.join(keys.select(self.key).distinct(), self.key, "left_anti"), "left")
        before, after = ({r[0] for r in self._bucketed(x).select("_bucket").distinct().collect()} for x in (old, left))
        self._write(left, self.version(), "overwrite")
        for b in before - after:
            fs, target = self._fs(f"{self._folder(self.version())}/_bucket={quote(str(b))}")
            fs.delete(target, True)


def _runs(spark, d):
    return views.runs(spark, d).select("id", "status", "query", F.col("created_at").cast("string").alias("created_at"), "depth")


def _upkeep(spark, d):
    """A table made at the first version, brought to the last, and changed in every way."""
    runs = _runs(spark, d)
    t = Table(spark, scratch_path(spark, "runs-table"), "id", RUN_STEPS)
    t.create(runs.where("id % 3 > 0"), 0)
    t.migrate()
    t.insert(migrated(runs.where("id % 3 = 0"), 0))
    changed = t.read().where("id % 7 = 1").withColumn("status", F.lit("changed"))
    t.upsert(changed.unionByName(changed.withColumn("created_at", F.lit("0000")).withColumn("status", F.lit("older"))), "created_at")
    t.update(runs.where("id % 5 = 2").select("id"), {"has_matrix": F.lit(1), "query": F.upper("query")})
    t.delete(runs.where("id % 11 = 4").select("id"))
    return t.read()


QUERIES = {
    "table_upkeep": (
        _upkeep,
        f"""with {views.RUNS_SQL} select id, case when id % 7 = 1 then 'changed' else status end as status, case when id % 5 = 2 then upper(query) else query end as query, cast(created_at as varchar) as created_at, depth,
        false as evergreen, cast(null as varchar) as created_by, '' as categories, true as use_prior, 'research' as kind, cast(null as bigint) as brief_id, case when id % 5 = 2 then 1 end as has_matrix from runs where id % 11 <> 4""",
    ),
}
