"""Run budgets by depth, closed forms of the depth table, and the estimate of a run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_RATE, READ_FLOOR = 0.4, 8
#: Rounds per unit of effort, share of a round that is read, and seconds per source where nothing is known.
ROUND_SCALE, READ_SHARE, DEFAULT_SECONDS = 1.6, 0.8, 12.0


def round_limit(breadth: int, remaining: int, read: int, kept: int, prior: float | None = None) -> int:
    """Candidates of the next round: enough to fill what remains at the rate seen so far, within bounds."""
    full, floor = breadth * 8 + 4, 2 * breadth + 2
    if remaining <= 0:
        return min(full, floor)
    rate = kept / read if read >= READ_FLOOR and kept > 0 else (prior if prior is not None else KEEP_RATE)
    return max(min(full, math.ceil(remaining / min(max(rate, 0.15), 0.9)) + 2), floor)


def with_round_limit(rows: DataFrame) -> DataFrame:
    """``round_limit`` as a column of (breadth, remaining, read, kept)."""
    full, floor = F.col("breadth") * 8 + 4, 2 * F.col("breadth") + 2
    rate = F.when((F.col("read") >= READ_FLOOR) & (F.col("kept") > 0), F.col("kept") / F.col("read")).otherwise(F.lit(KEEP_RATE))
    need = F.ceil(F.col("remaining") / F.least(F.greatest(rate, F.lit(0.15)), F.lit(0.9))) + 2
    return rows.withColumn("round_limit", F.when(F.col("remaining") <= 0, F.least(full, floor)).otherwise(F.greatest(F.least(full, need), floor)).cast("long"))


def with_depth_table(rows: DataFrame, depth: str = "depth") -> DataFrame:
    """The budget of a run by its depth (1 to 10): rounds, breadth, source cap, candidates a round, ceiling of calls, patience.

    Everything follows from half the depth as effort.
    """
    effort = F.col(depth) / 2
    rounds = F.greatest(F.lit(1), F.ceil(effort * ROUND_SCALE)).cast("int")
    breadth = F.least(2 + F.ceil(effort), F.lit(10)).cast("int")
    cap = F.greatest(F.lit(8), F.bround(effort * (12 + effort))).cast("int")
    candidates = breadth * 8 + 4
    return rows.select(
        "*",
        rounds.alias("rounds"),
        breadth.alias("breadth"),
        cap.alias("source_cap"),
        candidates.alias("candidates"),
        F.greatest(25 + 3 * cap, 12 + rounds * (candidates + 3)).alias("calls"),
        F.when(F.col(depth) <= 6, 1).otherwise(2).alias("patience"),
    )


def simulated(depth: int, read_yield: float, prior: float | None = None) -> tuple[int, float]:
    """(rounds, sources kept) of a run that is walked round by round until its source cap stops it."""
    effort = depth / 2
    rounds, breadth, cap = max(1, math.ceil(effort * ROUND_SCALE)), min(2 + math.ceil(effort), 10), max(8, round(effort * (12 + effort)))
    read, kept, k = 0.0, 0.0, 0
    while k < rounds and (not k or kept < cap):
        took = round_limit(breadth, cap - math.floor(kept), int(read), int(kept), prior) * READ_SHARE
        read, kept, k = read + took, kept + took * read_yield, k + 1
    return k, kept


def with_estimate(history: DataFrame, depth: str = "depth") -> DataFrame:
    """The estimate of a run from (depth, low, high, samples, seconds per source, cost per source): the middle of the band
    times the rates, calls within their ceiling; rates of fewer than two samples are the default."""
    rows = with_depth_table(history, depth)
    middle = (F.col("low") + F.col("high")) / 2
    calibrated = F.coalesce(F.col("seconds").isNotNull() & (F.col("samples") >= 2), F.lit(False))
    return rows.select(
        depth,
        (F.col("rounds") * F.col("breadth")).alias("queries"),
        F.least("calls", 3 + F.col("rounds") * 2 + F.col("high")).cast("int").alias("calls"),
        F.round(middle * F.when(calibrated, F.col("seconds")).otherwise(DEFAULT_SECONDS), 4).alias("seconds"),
        F.when(calibrated, F.round(middle * F.col("cost"), 3)).alias("cost"),
        calibrated.alias("calibrated"),
    )


def _depths(spark, d):
    from ..sources import views

    return with_depth_table(views.runs(spark, d).select("id", "depth"))


def _estimates(spark, d):
    from ..sources import views

    r = views.runs(spark, d).groupBy("depth").agg(F.min(F.col("id") % 9 + 2).cast("int").alias("low"), F.max(F.col("id") % 9 + 2).cast("int").alias("high"), (F.count(F.lit(1)) % 4).alias("samples"), F.lit(41.5).alias("seconds"), F.lit(0.0123).alias("cost"))
    return with_estimate(r)


def _limits(spark, d):
    from ..sources import views

    e = views.table(spark, d, "events")
    return with_round_limit(e.select("event_id", (F.col("user_id") % 7 + 1).alias("breadth"), (F.col("event_id") % 60 - 5).alias("remaining"), (F.col("user_id") % 40).alias("read"), (F.col("user_id") % 13).alias("kept")))


_BUDGET = """e as (select *, depth / 2 as effort from E), b as (select *, cast(greatest(1, ceil(effort * 1.6)) as int) as rounds, cast(least(2 + ceil(effort), 10) as int) as breadth,
  cast(greatest(8, round_even(effort * (12 + effort), 0)) as int) as source_cap from e), t as (select *, breadth * 8 + 4 as candidates, greatest(25 + 3 * source_cap, 12 + rounds * (breadth * 8 + 7)) as calls, case when depth <= 6 then 1 else 2 end as patience from b)"""
QUERIES = {
    "depth_table": (_depths, "with r as (select o_orderkey as id, cast(o_orderkey % 10 + 1 as int) as depth from orders), " + _BUDGET.replace("from E", "from r") + " select id, depth, rounds, breadth, source_cap, candidates, calls, patience from t"),
    "depth_estimates": (
        _estimates,
        "with r as (select cast(o_orderkey % 10 + 1 as int) as depth, cast(min(o_orderkey % 9 + 2) as int) as low, cast(max(o_orderkey % 9 + 2) as int) as high, count(*) % 4 as samples from orders group by 1), "
        + _BUDGET.replace("from E", "from r")
        + """ select depth, rounds * breadth as queries, cast(least(calls, 3 + rounds * 2 + high) as int) as calls, round((low + high) / 2 * case when samples >= 2 then 41.5 else 12.0 end, 4) as seconds,
        case when samples >= 2 then round((low + high) / 2 * 0.0123, 3) end as cost, samples >= 2 as calibrated from t""",
    ),
    "round_limits": (
        _limits,
        """with e as (select event_id, user_id % 7 + 1 as breadth, event_id % 60 - 5 as remaining, user_id % 40 as read, user_id % 13 as kept from events),
        r as (select *, case when read >= 8 and kept > 0 then kept / read else 0.4 end as rate from e)
        select event_id, breadth, remaining, read, kept, cast(case when remaining <= 0 then least(breadth * 8 + 4, 2 * breadth + 2)
          else greatest(least(breadth * 8 + 4, ceil(remaining / least(greatest(rate, 0.15), 0.9)) + 2), 2 * breadth + 2) end as bigint) as round_limit from r""",
    ),
}
