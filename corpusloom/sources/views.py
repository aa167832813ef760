"""Views of a research library over the star-schema tables.

The library's own tables (candidate outcomes, runs, findings, links, candidates, chunks) are derived by projections
only, so scans keep their column pruning and pushed-down filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_outcomes: one read page each, of a run, a domain and a search engine."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("r"), F.to_date("ts").cast("string")).alias("run_id"),
        F.concat(F.lit("d"), F.col("user_id"), F.lit("."), F.col("event_id") % 5).alias("domain"),
        F.concat(F.lit("e"), F.col("user_id") % 7).alias("engine"),
        F.when(F.col("event_type") == "purchase", "kept").when(F.col("event_type") == "error", "fail").otherwise("rejected").alias("outcome"),
        F.floor(F.least(F.col("value"), F.lit(100.0)) / 10).cast("int").alias("relevance"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("id"),
    )


OUTCOMES_SQL = """
outcomes as (
  select 'r' || cast(cast(ts as date) as varchar) as run_id, 'd' || user_id || '.' || (event_id % 5) as domain,
    'e' || (user_id % 7) as engine,
    case event_type when 'purchase' then 'kept' when 'error' then 'fail' else 'rejected' end as outcome,
    cast(floor(least(value, 100.0) / 10) as int) as relevance, ts as created_at, event_id as id
  from events
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs: one question each; a customer's earlier order is the parent run."""
    o = table(spark, sf_dir, "orders")
    parent = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
        F.col("o_orderdate").cast("date").alias("created_at"),
        F.col("o_custkey").alias("owner"),
        parent.alias("parent_id"),
        F.col("o_totalprice").cast("double").alias("cost"),
        F.col("o_orderpriority").alias("query"),
        (F.col("o_orderkey") % 10 + 1).cast("int").alias("depth"),
    )


RUNS_SQL = """
runs as (
  select o_orderkey as id, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end as status,
    cast(o_orderdate as date) as created_at, o_custkey as owner,
    lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent_id,
    cast(o_totalprice as double) as cost, o_orderpriority as query, cast(o_orderkey % 10 + 1 as int) as depth
  from orders
)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings: the kept sources of a run, numbered."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("int").alias("idx"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("domain"),
        F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example.org/p/"), F.col("l_partkey")).alias("url"),
        (F.col("l_quantity").cast("int") % 11).alias("relevance"),
    )


FINDINGS_SQL = """
findings as (
  select l_orderkey as run_id, cast(l_linenumber as int) as idx, 's' || l_suppkey as domain,
    'https://s' || l_suppkey || '.example.org/p/' || l_partkey as url, cast(trunc(l_quantity) as int) % 11 as relevance
  from lineitem
)"""
