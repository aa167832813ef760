"""Ranked selection under caps: interleaving, diversity, allocation, quotas, islands and streaks.

One cap is a window; where two caps interact, a row that the second refuses must not use up the first, so those run in
arrival order within one round (a round is a bounded group).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import urls
from ..sources import views


def interleave(rows: DataFrame, lists: str, order: str, limit: int | None = None) -> DataFrame:
    """Round-robin over the lists: every list's first, then every list's second."""
    made = rows.withColumn("turn", F.row_number().over(W.partitionBy(lists).orderBy(order)))
    return made if limit is None else made.orderBy("turn", lists).limit(limit)


def diversify(hits: DataFrame, group: str, order: list[Column], per_group: int, limit: int, backfill: bool = False) -> DataFrame:
    """At most ``per_group`` of each group in rank order, up to ``limit``; spare places go to those held back."""
    made = hits.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    if not backfill:
        made = made.where(F.col("_k") <= per_group)
    return made.orderBy((F.col("_k") > per_group).cast("int"), *order).limit(limit).drop("_k")


def diversify_each(hits: DataFrame, questions: list[str], group: str, order: list[Column], per_group: int, limit: int, backfill: bool = False) -> DataFrame:
    """``diversify`` for every question on its own; a question's hits are a pool of bounded size."""
    made = hits.withColumn("_k", F.row_number().over(W.partitionBy(*questions, group).orderBy(*order)))
    if not backfill:
        made = made.where(F.col("_k") <= per_group)
    place = F.row_number().over(W.partitionBy(*questions).orderBy((F.col("_k") > per_group).cast("int"), *order))
    return made.withColumn("_place", place).where(F.col("_place") <= limit).drop("_k", "_place")


def allocate(proposed: DataFrame, kept: DataFrame, breadth: int) -> DataFrame:
    """Queries of a round (query, facet, pos): round-robin over facets, thinnest first, a third of the round each at most."""
    facets = kept.select("facet", "kept", "facet_order")
    many = facets.count() > 1
    cap = max(1, -(-breadth // 3)) if many else breadth
    made = proposed.join(F.broadcast(facets), "facet").withColumn("turn", F.row_number().over(W.partitionBy("facet").orderBy("pos")))
    return made.where(F.col("turn") <= cap).orderBy("turn", "kept", "facet_order").limit(breadth)


def starved(kept: DataFrame, chosen: DataFrame) -> DataFrame:
    return kept.where("kept = 0").join(chosen.select("facet").distinct(), "facet", "left_anti")


def rank_diverse(rows: DataFrame, *, round_: str = "round", per_source: int = 2, per_engine: int | None = None, limit: int = 12, trial=(), trial_slots: int = 0) -> DataFrame:
    """Fetch candidates of each round in arrival order (pos), under a cap per source and one per engine, without repeats.

    rows: round, pos, url, engine. Engines on trial get their slots first. Adds canonical, source and place.
    """
    ready = rows.select(round_, "pos", "url", F.lower(F.trim(F.coalesce("engine", F.lit("")))).alias("engine"), urls.canonicalize(F.col("url")).alias("canonical"), urls.source_key(F.col("url")).alias("source"))
    kind = ready.schema[round_].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        taken, by_source, by_engine, out = set(), {}, {}, []

        def admit(k: int) -> None:
            r = pdf.iloc[k]
            if r.canonical in taken or by_source.get(r.source, 0) >= per_source:
                return
            if per_engine is not None and r.engine and by_engine.get(r.engine, 0) >= per_engine:
                return
            taken.add(r.canonical)
            by_source[r.source] = by_source.get(r.source, 0) + 1
            by_engine[r.engine] = by_engine.get(r.engine, 0) + 1
            out.append(k)

        slots = min(trial_slots, per_engine) if per_engine else trial_slots
        passes = [[k for k in range(len(pdf)) if pdf.engine[k] in trial]] if trial and slots else []
        for k in passes[0] if passes else ():
            if len(out) < limit and by_engine.get(pdf.engine[k], 0) < slots:
                admit(k)
        for k in range(len(pdf)):
            if len(out) >= limit:
                break
            admit(k)
        return pdf.iloc[out].assign(place=range(len(out)))

    return ready.groupBy(round_).applyInPandas(pick, f"`{round_}` {kind}, pos bigint, url string, engine string, canonical string, source string, place bigint")


def rank_one_cap(rows: DataFrame, *, round_: str = "round", per_source: int = 2, limit: int = 12) -> DataFrame:
    """As ``rank_diverse`` with the cap per source alone: first arrivals by canonical URL, then two windows."""
    ready = rows.select(round_, "pos", urls.canonicalize(F.col("url")).alias("canonical"), urls.source_key(F.col("url")).alias("source"))
    first = ready.groupBy(round_, "canonical", "source").agg(F.min("pos").alias("pos"))
    made = first.withColumn("_k", F.row_number().over(W.partitionBy(round_, "source").orderBy("pos"))).where(F.col("_k") <= per_source)
    place = F.row_number().over(W.partitionBy(round_).orderBy("pos")) - 1
    return made.withColumn("place", place.cast("bigint")).where(F.col("place") < limit).drop("_k")


def library_evidence(hits: DataFrame, *, floor: float = 0.45, per_title: int = 2, per_run: int = 3, limit: int = 6) -> DataFrame:
    """Evidence of each claim from earlier runs: a floor, then caps per title and per run; a title belongs to one run."""
    made = hits.where(F.col("score") >= floor)
    order = [F.desc("score"), F.asc("id")]
    made = made.withColumn("_t", F.row_number().over(W.partitionBy("claim", "run_id", "title").orderBy(*order))).where(F.col("_t") <= per_title)
    made = made.withColumn("_r", F.row_number().over(W.partitionBy("claim", "run_id").orderBy(*order))).where(F.col("_r") <= per_run)
    made = made.withColumn("n", F.row_number().over(W.partitionBy("claim").orderBy(*order)))
    return made.where(F.col("n") <= limit).drop("_t", "_r")


def triage_floor(rows: DataFrame, group: str, condemned: str, order: list[Column]) -> DataFrame:
    """Of each group's condemned rows the best are reprieved, until max(3, a tenth rounded up) of the group stay."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col(condemned)).alias("_kept"))
    need = F.greatest(F.greatest(F.lit(3), F.ceil(F.col("_n") / 10)) - F.col("_kept"), F.lit(0))
    rank = F.row_number().over(W.partitionBy(group, condemned).orderBy(*order))
    made = rows.withColumn("_k", rank).join(sizes, group)
    return made.withColumn("stays", ~F.col(condemned) | (F.col("_k") <= need)).drop("_n", "_kept", "_k")


def premise_cap(rows: DataFrame, group: str, domain: str, pos: str, limit: int = 4) -> DataFrame:
    """At most ``limit`` results of each premise, rule makers' domains first."""
    maker = F.col(domain).rlike(r"\.(gov|edu|org)$")
    made = rows.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy((~maker).cast("int"), pos)))
    return made.where(F.col("_k") <= limit).drop("_k")


def streaks(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """Runs of consecutive rows for which ``hit`` holds: key, first, last, length."""
    made = rows.select(key, order, hit.alias("_h")).withColumn("_island", F.sum((~F.col("_h")).cast("int")).over(W.partitionBy(key).orderBy(order)))
    return made.where("_h").groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")


def islands(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of each key merged: a running maximum of ends tells where a new island starts."""
    w = W.partitionBy(key).orderBy(start, end)
    made = spans.withColumn("_upto", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    made = made.withColumn("_i", F.sum((F.col("_upto").isNull() | (F.col(start) > F.col("_upto"))).cast("int")).over(w))
    return made.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans")).drop("_i")


def pack_skipping(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows that fit a budget in order, skipping those that do not: each decision depends on the ones before."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for s in pdf.sort_values(order)[size]:
            kept.append(s <= left)
            left -= s if kept[-1] else 0
        return pdf.sort_values(order).assign(packed=kept)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(key).applyInPandas(pack, f"{kinds}, packed boolean")


def pack_prefix(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows before the first that overflows the budget: a running sum."""
    return rows.withColumn("_sum", F.sum(size).over(W.partitionBy(key).orderBy(order))).where(F.col("_sum") <= budget).drop("_sum")


def spread_windows(rows: DataFrame, key: str, at: str, score: str, apart: int, most: int) -> DataFrame:
    """The best windows of each key that start at least ``apart`` from each other: greedy suppression."""

    def pick(it: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        pdf = it.sort_values([score, at], ascending=[False, True])
        kept: list[int] = []
        for s in pdf[at]:
            if len(kept) < most and all(abs(s - k) >= apart for k in kept):
                kept.append(s)
        return pdf[pdf[at].isin(kept)]

    return rows.groupBy(key).applyInPandas(pick, rows.schema)


def _pages(spark, d):
    return views.table(spark, d, "pages").select((F.col("page_id") % 7).alias("round"), F.col("page_id").alias("pos"), "url", F.concat(F.lit("e"), F.col("page_id") % 5).alias("engine"))


def _emb(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("run_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("score"))


def _hits(spark, d):
    return _emb(spark, d).select("id", "run_id", (F.col("id") % 3).alias("claim"), F.concat(F.col("run_id"), F.lit("/"), F.col("id") % 4).alias("title"), (F.abs("score") * 3).alias("score"))


def _facets(spark, d):
    docs = views.table(spark, d, "documents")
    proposed = docs.select(F.col("doc_id").alias("pos"), F.concat(F.lit("q"), F.col("doc_id")).alias("query"), F.col("lang").alias("facet"))
    kept = views.table(spark, d, "labels").join(docs, "doc_id").groupBy(F.col("lang").alias("facet")).agg(F.count_if(F.col("toxic") == 1).alias("kept"))
    kept = kept.withColumn("facet_order", F.ascii("facet"))
    return allocate(proposed, kept, 10).select("query", "facet", "kept", "turn")


def _streaks(spark, d):
    return streaks(views.table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error")


_E = "e as (select vec_id as id, label as run_id, round(cast(embedding[1] as double), 4) as score from embeddings)"
_PAGES = """p as (select page_id % 7 as round, page_id as pos, url, 'e' || (page_id % 5) as engine from pages), k as (
  select round, pos, engine, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '^www[.]', ''), '^m[.]', '') as source from p)"""
QUERIES = {
    "interleave_candidates": (
        lambda s, d: interleave(views.table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 60),
        "select * from (select doc_id, source, cast(row_number() over (partition by source order by doc_id) as int) as turn from documents) order by turn, source limit 60",
    ),
    "diversify": (
        lambda s, d: diversify(_emb(s, d), "run_id", [F.desc("score"), F.asc("id")], 3, 25),
        f"with {_E}, k as (select *, row_number() over (partition by run_id order by score desc, id) as k from e) select id, run_id, score from k where k <= 3 order by score desc, id limit 25",
    ),
    "diversify_backfill": (
        lambda s, d: diversify(_emb(s, d), "run_id", [F.desc("score"), F.asc("id")], 1, 40, backfill=True),
        f"with {_E}, k as (select *, row_number() over (partition by run_id order by score desc, id) as k from e) select id, run_id, score from k order by k > 1, score desc, id limit 40",
    ),
    "allocate_round_robin": (
        _facets,
        """with kept as (select lang as facet, count(*) filter (toxic = 1) as kept, ascii(lang) as facet_order from labels join documents using (doc_id) group by lang),
        p as (select 'q' || doc_id as query, lang as facet, cast(row_number() over (partition by lang order by doc_id) as int) as turn from documents)
        select query, facet, kept, turn from p join kept using (facet) where turn <= 4 order by turn, kept, facet_order limit 10""",
    ),
    "rank_diverse": (lambda s, d: rank_diverse(_pages(s, d), per_engine=4, trial=("e3",), trial_slots=2), None),
    "rank_diverse_single_cap": (
        lambda s, d: rank_one_cap(_pages(s, d)).select("round", "pos", "source", "place"),
        f"""with {_PAGES}, c as (select round, pos, source, row_number() over (partition by round, source order by pos) as n from k)
        select round, pos, source, place from (select round, pos, source, row_number() over (partition by round order by pos) - 1 as place from c where n <= 2) where place < 12""",
    ),
    "library_evidence": (
        lambda s, d: library_evidence(_hits(s, d)).select("id", "claim", "title", "n"),
        f"""with {_E}, h as (select id, run_id, id % 3 as claim, run_id || '/' || (id % 4) as title, abs(score) * 3 as score from e),
        a as (select *, row_number() over (partition by claim, run_id, title order by score desc, id) as t from h where score >= 0.45),
        b as (select *, row_number() over (partition by claim, run_id order by score desc, id) as r from a where t <= 2),
        c as (select id, claim, title, cast(row_number() over (partition by claim order by score desc, id) as int) as n from b where r <= 3) select * from c where n <= 6""",
    ),
    "triage_floor": (
        lambda s, d: triage_floor(views.table(s, d, "documents").select("doc_id", "source", (F.col("n_chars") < 6000).alias("condemned")), "source", "condemned", [F.asc("doc_id")]),
        """with d as (select doc_id, source, n_chars < 6000 as condemned from documents), n as (select source, greatest(greatest(3, ceil(count(*) / 10)) - count(*) filter (not condemned), 0) as need from d group by source)
        select doc_id, source, condemned, not condemned or row_number() over (partition by source, condemned order by doc_id) <= need as stays from d join n using (source)""",
    ),
    "premise_results_cap": (
        lambda s, d: premise_cap(views.table(s, d, "pages").select("page_id", (F.col("page_id") % 20).alias("premise"), urls.domain_of(F.col("url")).alias("domain")), "premise", "domain", "page_id"),
        """with k as (select page_id, page_id % 20 as premise, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '^www[.]', ''), '^m[.]', '') as domain from pages)
        select * from k qualify row_number() over (partition by premise order by not regexp_matches(domain, '[.](gov|edu|org)$'), page_id) <= 4""",
    ),
    "saturation_streaks": (
        _streaks,
        """with m as (select user_id, event_id, event_type = 'error' as h, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as i from events)
        select user_id, min(event_id) as first, max(event_id) as last, count(*) as length from m where h group by user_id, i""",
    ),
    "excerpt_islands": (
        lambda s, d: islands(
            views.table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("n_chars") / 400), F.lit(20)))).alias("k")).select("doc_id", ((F.col("k") * F.col("k") * 37 + F.col("doc_id") * 13) % 5000).alias("start")).withColumn("end", F.col("start") + 150),
            "doc_id",
        ),
        """with s as (select doc_id, (k * k * 37 + doc_id * 13) % 5000 as start from (select doc_id, unnest(range(0, least(n_chars // 400, 20) + 1)) as k from documents)), e as (select doc_id, start, start + 150 as e from s),
        m as (select *, max(e) over (partition by doc_id order by start, e rows between unbounded preceding and 1 preceding) as upto from e),
        i as (select *, sum(case when upto is null or start > upto then 1 else 0 end) over (partition by doc_id order by start, e rows unbounded preceding) as i from m)
        select doc_id, min(start) as start, max(e) as "end", count(*) as spans from i group by doc_id, i""",
    ),
    "budget_packing": (
        lambda s, d: pack_skipping(views.table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 30_000),
        """with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as k from documents),
        p(source, k, doc_id, n_chars, packed, room) as (
          select source, k, doc_id, n_chars, n_chars <= 30000, 30000 - case when n_chars <= 30000 then n_chars else 0 end from d where k = 1
          union all select d.source, d.k, d.doc_id, d.n_chars, d.n_chars <= room, room - case when d.n_chars <= room then d.n_chars else 0 end from p join d on d.source = p.source and d.k = p.k + 1)
        select source, doc_id, n_chars, packed from p""",
    ),
    "budget_prefix": (
        lambda s, d: pack_prefix(views.table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 30_000),
        "select source, doc_id, n_chars from documents qualify sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) <= 30000",
    ),
    "spread_windows": (lambda s, d: spread_windows(_emb(s, d).select("run_id", "id", "score"), "run_id", "id", "score", 40, 8), None),
}
