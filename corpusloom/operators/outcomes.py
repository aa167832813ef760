"""What became of the candidates that were read: yields by domain, engine and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views
from ..sources.views import OUTCOMES_SQL


def _kept() -> Column:
    return F.sum((F.col("outcome") == "kept").cast("long"))


def dead_domains(outcomes: DataFrame, min_reads: int = 8, min_runs: int = 3) -> DataFrame:
    """Domains that were read often, in several runs, and never kept."""
    made = outcomes.groupBy("domain").agg(F.count(F.lit(1)).alias("reads"), F.count_distinct("run_id").alias("runs"), _kept().alias("kept"))
    return made.where((F.col("kept") == 0) & (F.col("reads") >= min_reads) & (F.col("runs") >= min_runs)).select("domain", "reads", "runs")


def productive_domains(outcomes: DataFrame, min_reads: int = 6, limit: int = 25) -> DataFrame:
    made = outcomes.groupBy("domain").agg(F.count(F.lit(1)).alias("reads"), _kept().alias("kept"))
    made = made.where((F.col("reads") >= min_reads) & (F.col("kept") > 0))
    return made.orderBy(F.desc(F.col("kept") / F.col("reads")), F.desc("reads"), "domain").limit(limit)


def engine_yields(outcomes: DataFrame, since, min_reads: int = 15) -> DataFrame:
    made = outcomes.where((F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("engine") != ""))
    made = made.groupBy("engine").agg(F.count(F.lit(1)).alias("reads"), _kept().alias("kept"))
    return made.where(F.col("reads") >= min_reads).withColumn("yield", F.round(F.col("kept") / F.col("reads"), 6))


def read_yield(outcomes: DataFrame, since, min_reads: int = 30) -> DataFrame:
    """One row: kept over read, null where too few were read."""
    made = outcomes.where((F.col("created_at") >= F.lit(since).cast("timestamp")) & F.col("outcome").isin("kept", "rejected", "fail"))
    made = made.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(_kept(), F.lit(0)).alias("kept"))
    return made.withColumn("yield", F.when(F.col("reads") >= min_reads, F.round(F.col("kept") / F.col("reads"), 6)))


def yield_for_domains(outcomes: DataFrame, domains: list[str]) -> DataFrame:
    made = outcomes.where(F.col("domain").isin([d.lower() for d in domains]))
    return made.groupBy("domain").agg(F.count(F.lit(1)).alias("reads"), _kept().alias("kept"), F.count_distinct("run_id").alias("runs"))


def dead_domains_in_run(outcomes: DataFrame, run_id: str, **bounds) -> DataFrame:
    own = outcomes.where(F.col("run_id") == run_id).select("domain").distinct()
    return dead_domains(outcomes, **bounds).join(own, "domain", "left_semi")


def kept_domains_for_runs(findings: DataFrame, run_ids: list) -> DataFrame:
    return findings.where(F.col("run_id").isin(run_ids)).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def refusal_table(refusals: DataFrame, yields: DataFrame, limit: int = 24) -> DataFrame:
    """Refusals per engine, merged with the yields of engines that were never refused."""
    runs = refusals.agg(F.greatest(F.count_distinct("run_id"), F.lit(1)).alias("n_runs"))
    per = refusals.groupBy("engine").agg(F.count(F.lit(1)).alias("refused"), F.count_distinct("run_id").alias("refused_runs"))
    per = per.join(F.broadcast(runs)).select("engine", "refused", F.round(F.col("refused_runs") / F.col("n_runs"), 6).alias("share"))
    out = per.join(yields.select("engine", "reads", "yield"), "engine", "full")
    out = out.select("engine", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("refused", "share", "reads", "yield")])
    return out.orderBy(F.desc("yield"), F.desc("refused"), "engine").limit(limit)


def backfill(events: DataFrame) -> DataFrame:
    """Outcomes from an event log: findings are kept, skips are rejected by score or failed; drops and duplicates go."""
    reason = F.lower("reason")
    outcome = F.when(F.col("type") == "finding", "kept").when(reason.rlike(r"relevance \d+/10"), "rejected").otherwise("fail")
    used = (F.col("type") == "finding") | ((F.col("type") == "source_skipped") & ~reason.startswith("dropped") & ~reason.startswith("duplicate"))
    return events.where(used).withColumn("outcome", outcome)


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per run: reads, kept, scores of rejected pages in two buckets, average score of the kept, distinct kept domains."""
    kept, rejected = F.col("outcome") == "kept", F.col("outcome") == "rejected"
    n = lambda c: F.count_if(c)
    return outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("reads"),
        n(kept).alias("kept"),
        n(kept & (F.col("relevance") >= 7)).alias("kept_7_plus"),
        n(rejected & F.col("relevance").between(0, 1)).alias("scored_0_1"),
        n(rejected & F.col("relevance").between(2, 3)).alias("scored_2_3"),
        n(F.col("outcome") == "fail").alias("failed"),
        F.round(F.avg(F.when(kept, F.col("relevance"))), 4).alias("avg_relevance"),
        F.count_distinct(F.when(kept, F.col("domain"))).alias("kept_domains"),
    )


#: Whether more is better, for each figure that two runs are compared by.
BETTER = {"kept": True, "kept_7_plus": True, "avg_relevance": True, "kept_domains": True, "scored_0_1": False, "scored_2_3": False, "failed": False}


def side_by_side(summary: DataFrame, a: str, b: str) -> DataFrame:
    """One row per figure of two runs, and which run it favours."""
    long = summary.where(F.col("run_id").isin(a, b)).select("run_id", *[F.col(c).cast("double").alias(c) for c in BETTER])
    long = long.unpivot("run_id", list(BETTER), "key", "value")
    wide = long.groupBy("key").agg(F.max(F.when(F.col("run_id") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("run_id") == b, F.col("value"))).alias("b"))
    up = F.col("key").isin([k for k, v in BETTER.items() if v])
    return wide.withColumn("better", F.when(F.col("a") != F.col("b"), F.when((F.col("b") > F.col("a")) == up, "b").otherwise("a")))


def candidate_order(candidates: DataFrame, outcomes: DataFrame, min_reads: int = 15) -> DataFrame:
    """Stable reading order: domains without dead records first, engines by tier and yield, then relevance, then arrival."""
    dead = dead_domains(outcomes).select(F.col("domain"), F.lit(1).alias("dead"))
    stats = outcomes.groupBy("engine").agg(F.count(F.lit(1)).alias("_reads"), (_kept() / F.count(F.lit(1))).alias("_yield"))
    joined = candidates.join(dead, "domain", "left").join(F.broadcast(stats), "engine", "left")
    proven = F.coalesce(F.col("_reads") >= min_reads, F.lit(False))
    return joined.select(
        *candidates.columns,
        F.coalesce("dead", F.lit(0)).alias("is_dead"),
        F.when(proven, 0).otherwise(1).alias("unproven"),
        F.round(F.when(proven, F.col("_yield")).otherwise(F.lit(0.0)), 3).alias("engine_yield"),
    )


def _q(fn):
    return lambda spark, d: fn(views.outcomes(spark, d))


def _refusals(spark, d):
    o = views.outcomes(spark, d)
    refused = o.where("outcome = 'fail'").select("run_id", "engine")
    return refusal_table(refused, engine_yields(o, "2024-01-10"))


def _backfill(spark, d):
    e = views.table(spark, d, "events")
    log = e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "finding").when(F.col("event_type") == "signup", "log").otherwise("source_skipped").alias("type"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("relevance "), F.floor(F.least("value", F.lit(100.0)) / 10).cast("int"), F.lit("/10")))
        .when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, "dropped at triage").otherwise("duplicate of another"))
        .otherwise("HTTP 403")
        .alias("reason"),
    )
    return backfill(log).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def _ordered(spark, d):
    o = views.outcomes(spark, d)
    cand = o.where(F.to_date("created_at") == F.lit("2024-01-05").cast("date")).select("id", "domain", "engine", "relevance")
    made = candidate_order(cand, o)
    rank = F.row_number().over(W.partitionBy("engine").orderBy("is_dead", "unproven", F.desc("engine_yield"), F.desc("relevance"), "id"))
    return made.withColumn("place", rank)


_AGG = "sum(case when outcome = 'kept' then 1 else 0 end)::bigint"
QUERIES = {
    "dead_domains": (
        _q(dead_domains),
        f"with {OUTCOMES_SQL} select domain, count(*) as reads, count(distinct run_id) as runs from outcomes group by domain having {_AGG} = 0 and count(*) >= 8 and count(distinct run_id) >= 3",
    ),
    "productive_domains": (
        _q(productive_domains),
        f"with {OUTCOMES_SQL} select domain, count(*) as reads, {_AGG} as kept from outcomes group by domain having count(*) >= 6 and {_AGG} > 0 order by {_AGG} / count(*) desc, count(*) desc, domain limit 25",
    ),
    "engine_yields": (
        _q(lambda o: engine_yields(o, "2024-01-10")),
        f"with {OUTCOMES_SQL} select engine, count(*) as reads, {_AGG} as kept, round({_AGG} / count(*), 6) as yield from outcomes where created_at >= timestamp '2024-01-10' and engine <> '' group by engine having count(*) >= 15",
    ),
    "read_yield": (
        _q(lambda o: read_yield(o, "2024-01-10")),
        f"with {OUTCOMES_SQL} select count(*) as reads, coalesce({_AGG}, 0) as kept, case when count(*) >= 30 then round({_AGG} / count(*), 6) end as yield from outcomes where created_at >= timestamp '2024-01-10' and outcome in ('kept', 'rejected', 'fail')",
    ),
    "yield_for_domains": (
        _q(lambda o: yield_for_domains(o, ["d1.0", "D2.1", "d3.2", "nowhere"])),
        f"with {OUTCOMES_SQL} select domain, count(*) as reads, {_AGG} as kept, count(distinct run_id) as runs from outcomes where domain in ('d1.0', 'd2.1', 'd3.2', 'nowhere') group by domain",
    ),
    "dead_domains_in_run": (
        _q(lambda o: dead_domains_in_run(o, "r2024-01-07")),
        f"with {OUTCOMES_SQL} select domain, count(*) as reads, count(distinct run_id) as runs from outcomes where domain in (select domain from outcomes where run_id = 'r2024-01-07') group by domain having {_AGG} = 0 and count(*) >= 8 and count(distinct run_id) >= 3",
    ),
    "kept_domains_for_runs": (
        lambda spark, d: kept_domains_for_runs(views.findings(spark, d), list(range(0, 400, 7))),
        f"with {views.FINDINGS_SQL} select domain, count(*) as n from findings where run_id in (select unnest(range(0, 400, 7))) group by domain",
    ),
    "refusal_table": (
        _refusals,
        f"""with {OUTCOMES_SQL}, y as (
          select engine, count(*) as reads, round({_AGG} / count(*), 6) as yield from outcomes where created_at >= timestamp '2024-01-10' and engine <> '' group by engine having count(*) >= 15
        ), f as (select * from outcomes where outcome = 'fail'), r as (
          select engine, count(*) as refused, round(count(distinct run_id) / greatest(1, (select count(distinct run_id) from f)), 6) as share from f group by engine
        ) select coalesce(r.engine, y.engine) as engine, coalesce(refused, 0) as refused, coalesce(share, 0) as share, coalesce(reads, 0) as reads, coalesce(yield, 0) as yield
        from r full join y on r.engine = y.engine order by yield desc, refused desc, engine limit 24""",
    ),
    "backfill_outcomes": (
        _backfill,
        """with l as (select event_id as seq, event_type as t, case event_type when 'purchase' then 'finding' when 'signup' then 'log' else 'source_skipped' end as type from events)
        select case when type = 'finding' then 'kept' when t = 'click' then 'rejected' else 'fail' end as outcome, count(*) as n, sum(seq)::bigint as seqs
        from l where type = 'finding' or (type = 'source_skipped' and t <> 'view') group by 1""",
    ),
    "run_summary": (
        _q(run_summary),
        SUMMARY_SQL := f"""with {OUTCOMES_SQL} select run_id, count(*) as reads, count(*) filter (outcome = 'kept') as kept, count(*) filter (outcome = 'kept' and relevance >= 7) as kept_7_plus,
          count(*) filter (outcome = 'rejected' and relevance between 0 and 1) as scored_0_1, count(*) filter (outcome = 'rejected' and relevance between 2 and 3) as scored_2_3,
          count(*) filter (outcome = 'fail') as failed, round(avg(relevance) filter (outcome = 'kept'), 4) as avg_relevance, count(distinct domain) filter (outcome = 'kept') as kept_domains
        from outcomes group by run_id""",
    ),
    "ab_side_by_side": (
        _q(lambda o: side_by_side(run_summary(o), "r2024-01-03", "r2024-01-04")),
        f"""with s as ({SUMMARY_SQL}), l as (
          select run_id, k as key, v as value from s, lateral (values ('kept', kept::double), ('kept_7_plus', kept_7_plus::double), ('avg_relevance', avg_relevance), ('kept_domains', kept_domains::double),
            ('scored_0_1', scored_0_1::double), ('scored_2_3', scored_2_3::double), ('failed', failed::double)) as x(k, v) where run_id in ('r2024-01-03', 'r2024-01-04')
        ), w as (select key, max(value) filter (run_id = 'r2024-01-03') as a, max(value) filter (run_id = 'r2024-01-04') as b from l group by key)
        select key, a, b, case when a <> b then case when (b > a) = (key in ('kept', 'kept_7_plus', 'avg_relevance', 'kept_domains')) then 'b' else 'a' end end as better from w""",
    ),
    "candidate_order": (
        _ordered,
        f"""with {OUTCOMES_SQL}, dead as (
          select domain from outcomes group by domain having {_AGG} = 0 and count(*) >= 8 and count(distinct run_id) >= 3
        ), st as (select engine, count(*) as reads, {_AGG} / count(*) as y from outcomes group by engine), c as (
          select o.id, o.domain, o.engine, o.relevance, case when dead.domain is not null then 1 else 0 end as is_dead, case when reads >= 15 then 0 else 1 end as unproven,
            round(case when reads >= 15 then y else 0.0 end, 3) as engine_yield
          from outcomes o left join dead on o.domain = dead.domain left join st on o.engine = st.engine where cast(created_at as date) = date '2024-01-05'
        ) select *, cast(row_number() over (partition by engine order by is_dead, unproven, engine_yield desc, relevance desc, id) as int) as place from c""",
    ),
}
