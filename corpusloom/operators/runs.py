"""Runs, their findings and links: scans, look-ups, due sets, medians and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views
from ..sources.views import FINDINGS_SQL, RUNS_SQL


def list_runs(runs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def get_run(runs: DataFrame, run_id) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def runs_with_status(runs: DataFrame, *statuses: str) -> DataFrame:
    return runs.where(F.col("status").isin(list(statuses)))


def findings_for_run(findings: DataFrame, run_id) -> DataFrame:
    return findings.where(F.col("run_id") == run_id).orderBy("idx")


def runs_with_query(runs: DataFrame, query: str, exclude=None, limit: int = 8) -> DataFrame:
    same = runs.where((F.col("query") == query) & (F.col("status") == "completed"))
    if exclude is not None:
        same = same.where(F.col("id") != exclude)
    return same.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_finding_urls(findings: DataFrame, runs: DataFrame, status: str = "completed", limit: int = 800) -> DataFrame:
    """Distinct URLs of the newest findings of runs of one kind; the cap comes before the distinct."""
    kept = findings.join(runs.where(F.col("status") == status).select(F.col("id").alias("run_id")), "run_id")
    return kept.orderBy(F.desc("run_id"), F.desc("idx"), "url").limit(limit).select("url").distinct()


def links_for_run(links: DataFrame, runs: DataFrame, run_id) -> DataFrame:
    own = links.where((F.col("src") == run_id) | (F.col("dst") == run_id))
    side = lambda s: runs.select(F.col("id").alias(s), F.col("title").alias(f"{s}_title"))
    return own.join(side("src"), "src").join(side("dst"), "dst")


def related_labels(links: DataFrame, run_id) -> DataFrame:
    """Other ends of a run's links, once each: a follow-up says more than "related"."""
    other = F.when(F.col("src") == run_id, F.col("dst")).otherwise(F.col("src"))
    role = F.when(F.col("kind") != "followup", "related").when(F.col("src") == run_id, "followed up").otherwise("follows up")
    made = links.where((F.col("src") == run_id) | (F.col("dst") == run_id)).select(other.alias("other"), role.alias("label"), "score").where(F.col("other") != run_id)
    rank = F.row_number().over(W.partitionBy("other").orderBy((F.col("label") == "related").cast("int"), F.desc("score"), "label"))
    return made.withColumn("_k", rank).where("_k = 1").drop("_k")


def evergreen_due(runs: DataFrame, now: str, days: int) -> DataFrame:
    """Completed runs without a child that is in flight or newer than the cutoff: an anti join."""
    fresh = F.col("status").isin("queued", "running") | (F.col("created_at") > F.date_sub(F.lit(now).cast("date"), days))
    children = runs.where(F.col("parent_id").isNotNull() & fresh).select(F.col("parent_id").alias("id"))
    return runs.where((F.col("status") == "completed") & (F.col("created_at") <= F.date_sub(F.lit(now).cast("date"), days))).join(children, "id", "left_anti")


def briefs_due(briefs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Daily briefs that never ran, or ran at least ``hours`` ago."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_run")
    return briefs.where((F.col("schedule") == "daily") & (F.col("last_run").isNull() | (age >= hours * 3600)))


def queue_positions(runs: DataFrame) -> DataFrame:
    """0-based place among queued runs: a range sort and a running count, not one task's window over all."""
    queued = runs.where("status = 'queued'")
    per_day = queued.groupBy("created_at").agg(F.count(F.lit(1)).alias("n"))
    before = per_day.withColumn("before", F.sum("n").over(W.orderBy("created_at").rowsBetween(W.unboundedPreceding, -1)))
    place = F.row_number().over(W.partitionBy("created_at").orderBy("id")) - 1
    return queued.join(F.broadcast(before.select("created_at", "before")), "created_at").select("id", (F.coalesce("before", F.lit(0)) + place).cast("long").alias("position"))


def nearest_rank(values: Column, p: float) -> Column:
    """Element of a sorted array at the index p * (n - 1), rounded half to even."""
    return F.element_at(values, (F.bround(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def truncated_rank(values: Column, p: float) -> Column:
    """Element of a sorted array at the index p * (n - 1), truncated."""
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def history(runs: DataFrame, per: str = "depth") -> DataFrame:
    """Per depth: runs, the median of their cost, and quartiles by nearest rank."""
    made = runs.where("status = 'completed'").groupBy(per).agg(F.count(F.lit(1)).alias("n"), F.percentile("cost", 0.5).alias("median"), F.sort_array(F.collect_list("cost")).alias("v"))
    return made.select(per, "n", F.round("median", 4).alias("median_cost"), nearest_rank(F.col("v"), 0.25).alias("low"), nearest_rank(F.col("v"), 0.75).alias("high"), truncated_rank(F.col("v"), 0.9).alias("p90"))


def latest_state(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Last writer wins: the newest row of each key, by a combinable maximum rather than a window."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return best.select(key, *[F.col(f"s.{c}") for c in rest])


def _links(spark, d):
    e = views.table(spark, d, "embeddings").select("vec_id", "label")
    a = e.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % 200).alias("dst"), F.when(F.col("label") % 3 == 0, "followup").otherwise("related").alias("kind"), (F.col("vec_id") % 100 / 100).alias("score"))
    return a.where("src < 200 and src <> dst")


def _all_links(spark, d):
    """Links of every vector: dst is dealt over the whole id range."""
    e = views.table(spark, d, "embeddings").select("vec_id", "label")
    e = e.join(F.broadcast(e.agg((F.max("vec_id") + 1).alias("n"))))
    a = e.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("dst"), F.when(F.col("label") % 3 == 0, "followup").otherwise("related").alias("kind"), (F.col("vec_id") % 100 / 100).alias("score"))
    return a.where("src <> dst")


_LINKS_SQL = "links as (select vec_id as src, (vec_id * 7 + 3) % 200 as dst, case when label % 3 = 0 then 'followup' else 'related' end as kind, (vec_id % 100) / 100 as score from embeddings where vec_id < 200 and vec_id <> (vec_id * 7 + 3) % 200)"

_ALL_LINKS_SQL = "links as (select vec_id as src, (vec_id * 7 + 3) % n as dst, case when label % 3 = 0 then 'followup' else 'related' end as kind, (vec_id % 100) / 100 as score from embeddings, (select max(vec_id) + 1 as n from embeddings) where vec_id <> (vec_id * 7 + 3) % n)"


def _titled(spark, d):
    return views.runs(spark, d).select("id", F.concat(F.lit("run "), F.col("id")).alias("title"))


def _r(fn):
    return lambda spark, d: fn(views.runs(spark, d))


_DAY = "cast(created_at as string) as created_at"
_COLS = "id, status, cast(created_at as varchar) as created_at, owner"
QUERIES = {
    "list_runs_page": (_r(lambda r: list_runs(r, 50, 100).selectExpr("id", "status", _DAY, "owner")), f"with {RUNS_SQL} select {_COLS} from runs order by created_at desc, id desc limit 50 offset 100"),
    "get_run": (_r(lambda r: get_run(r, 42).selectExpr("id", "status", _DAY, "owner", "parent_id")), f"with {RUNS_SQL} select {_COLS}, parent_id from runs where id = 42"),
    "runs_with_status": (_r(lambda r: runs_with_status(r, "queued", "running").selectExpr("id", "status", _DAY, "owner")), f"with {RUNS_SQL} select {_COLS} from runs where status in ('queued', 'running')"),
    "findings_for_run": (lambda s, d: findings_for_run(views.findings(s, d), 42), f"with {FINDINGS_SQL} select * from findings where run_id = 42"),
    "runs_with_query": (_r(lambda r: runs_with_query(r, "1-URGENT", exclude=3).selectExpr("id", "depth", _DAY)), f"with {RUNS_SQL} select id, depth, cast(created_at as varchar) as created_at from runs where query = '1-URGENT' and status = 'completed' and id <> 3 order by created_at desc, id desc limit 8"),
    "recent_finding_urls": (
        lambda s, d: recent_finding_urls(views.findings(s, d), views.runs(s, d)),
        f"with {RUNS_SQL}, {FINDINGS_SQL} select distinct url from (select url from findings join runs on runs.id = run_id where status = 'completed' order by run_id desc, idx desc, url limit 800)",
    ),
    "links_for_run": (
        lambda s, d: links_for_run(_links(s, d), _titled(s, d), 10),
        f"with {_LINKS_SQL}, t as (select o_orderkey as id, 'run ' || o_orderkey as title from orders) select src, dst, kind, score, a.title as src_title, b.title as dst_title from links join t a on a.id = src join t b on b.id = dst where src = 10 or dst = 10",
    ),
    "related_link_labels": (
        lambda s, d: related_labels(_links(s, d), 10),
        f"""with {_LINKS_SQL}, x as (select case when src = 10 then dst else src end as other, case when kind <> 'followup' then 'related' when src = 10 then 'followed up' else 'follows up' end as label, score
        from links where src = 10 or dst = 10) select other, label, score from x where other <> 10 qualify row_number() over (partition by other order by label = 'related', score desc, label) = 1""",
    ),
    "links_for_run_all": (
        lambda s, d: links_for_run(_all_links(s, d), _titled(s, d), 205),
        f"with {_ALL_LINKS_SQL}, t as (select o_orderkey as id, 'run ' || o_orderkey as title from orders) select src, dst, kind, score, a.title as src_title, b.title as dst_title from links join t a on a.id = src join t b on b.id = dst where src = 205 or dst = 205",
    ),
    "related_link_labels_all": (
        lambda s, d: related_labels(_all_links(s, d), 205),
        f"""with {_ALL_LINKS_SQL}, x as (select case when src = 205 then dst else src end as other, case when kind <> 'followup' then 'related' when src = 205 then 'followed up' else 'follows up' end as label, score
        from links where src = 205 or dst = 205) select other, label, score from x where other <> 205 qualify row_number() over (partition by other order by label = 'related', score desc, label) = 1""",
    ),
    "evergreen_due": (
        _r(lambda r: evergreen_due(r, "1998-06-01", 180).selectExpr("id", _DAY)),
        f"with {RUNS_SQL} select id, cast(created_at as varchar) as created_at from runs r where status = 'completed' and created_at <= date '1998-06-01' - 180 and not exists (select 1 from runs c where c.parent_id = r.id and (c.status in ('queued', 'running') or c.created_at > date '1998-06-01' - 180))",
    ),
    "briefs_due": (
        lambda s, d: briefs_due(
            views.table(s, d, "events").select(
                F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "daily").otherwise("weekly").alias("schedule"), F.when(F.col("event_type") != "error", F.col("ts")).alias("last_run")
            ),
            "2024-01-15 12:00:00",
        ).select("id"),
        "select event_id as id from events where user_id % 2 = 0 and (event_type = 'error' or epoch(timestamp '2024-01-15 12:00:00')::bigint - floor(epoch(ts))::bigint >= 86400)",
    ),
    "queue_positions": (_r(queue_positions), f"with {RUNS_SQL} select id, cast(row_number() over (order by created_at, id) - 1 as bigint) as position from runs where status = 'queued'"),
    "history_medians": (
        _r(history),
        f"""with {RUNS_SQL}, h as (select depth, count(*) as n, median(cost) as m, list_sort(list(cost)) as v from runs where status = 'completed' group by depth)
        select depth, n, round(m, 4) as median_cost, v[cast(round_even(0.25 * (n - 1), 0) as int) + 1] as low, v[cast(round_even(0.75 * (n - 1), 0) as int) + 1] as high, v[cast(floor(0.9 * (n - 1)) as int) + 1] as p90 from h""",
    ),
    "latest_engine_state": (
        lambda s, d: latest_state(views.outcomes(s, d).select("engine", "outcome", "domain", "id"), "engine", F.col("id")),
        f"with {views.OUTCOMES_SQL} select engine, outcome, domain, id from outcomes qualify row_number() over (partition by engine order by id desc) = 1",
    ),
}
