"""The library's tables: predicates, upserts, deletions, joins with runs, hints, verdicts and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views

# Fixed values.
SERVABLE = r"^(overview\.md|further-research\.md|sources\.md|meta\.json|events\.jsonl|findings/[0-9]{3}_[a-z0-9-]*\.md|rounds/round-[0-9]{2}\.md)$"
PREFIXES = {"nomic": ("search_query: ", "search_document: "), "e5": ("query: ", "passage: ")}


def evergreen(runs: DataFrame) -> DataFrame:
    return runs.where("evergreen and status = 'completed'").orderBy(F.desc("created_at"), F.desc("id"))


def unknown(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` has not been settled yet."""
    return rows.where(F.col(column).isNull())


def has_rows(parents: DataFrame, children: DataFrame, key: str, child: str) -> DataFrame:
    """``parents`` with whether any child refers to them."""
    found = children.select(F.col(child).alias(key)).distinct().withColumn("has_rows", F.lit(True))
    return parents.join(found, key, "left").withColumn("has_rows", F.coalesce("has_rows", F.lit(False)))


def matches_kind(kind: Column, has_matrix: Column, wanted: str) -> Column:
    """``research+matrix`` asks for research that has a matrix; no kind asks for all."""
    if not wanted:
        return F.lit(True)
    return (kind == "research") & has_matrix if wanted == "research+matrix" else kind == wanted


def is_servable(path: Column) -> Column:
    return path.rlike(SERVABLE)


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """In order of the name whatever its case, ties by the name itself."""
    return rows.orderBy(F.lower(name), name)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``table`` with ``changes``: of the rows of one key the latest by ``order`` stays, and a change wins over what was there.
    Rows that are equal in ``order`` too are ordered by their other columns, from left to right."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("_new", order, *[c for c in rest if c != order])).alias("x"))
    return latest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*table.columns)


def without_run(table: DataFrame, gone: DataFrame, key: str = "run_id") -> DataFrame:
    """What is left of a table when runs are deleted: the rewrite of a copy-on-write store."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def recovered(runs: DataFrame) -> DataFrame:
    """After a restart: what was running is interrupted, and queued runs have their place in the queue."""
    status = F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))
    place = F.when(F.col("status") == "queued", F.row_number().over(W.partitionBy("status", "owner").orderBy("created_at", "id")))
    return runs.withColumn("place", place).withColumn("status", status)


def titled(hits: DataFrame, runs: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Hits with their run's title; those of no known run keep their own, or go."""
    made = hits.join(runs.select(F.col("id").alias("run_id"), F.col("query").alias("run_title")), "run_id", "inner" if drop_missing else "left")
    return made.withColumn("title", F.coalesce("run_title", "title")).drop("run_title")


def similar_hints(hits: DataFrame, runs: DataFrame, most: int = 2, floor: float = 0.62) -> DataFrame:
    """Per question the best runs by their best hit, of which the completed and close ones are shown; filtered after the cut."""
    best = hits.groupBy("q", "run_id").agg(F.max("score").alias("score"))
    top = best.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "run_id"))).where(F.col("k") <= most)
    return top.join(runs.where("status = 'completed'").select(F.col("id").alias("run_id")), "run_id", "left_semi").where(F.col("score") >= floor).select("q", "run_id", "score")


def verdict_counts(verdicts: DataFrame, group: str, kinds=("supported", "contested", "unsupported", "unverifiable")) -> DataFrame:
    return verdicts.groupBy(group).agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])


def bounded_verdicts(verdicts: DataFrame) -> DataFrame:
    """An "unsupported" without a quote is only unverifiable, and with the sources of one host contested; ``settled`` are
    firm verdicts (7 or more) that are neither of the two open ones."""
    hosts = F.size(F.array_distinct("hosts"))
    made = F.when(F.col("verdict") != "unsupported", F.col("verdict")).when(F.coalesce("quote", F.lit("")) == "", "unverifiable").when(hosts < 2, "contested").otherwise("unsupported")
    return verdicts.withColumn("verdict", made).withColumn("settled", ~F.col("verdict").isin("unverifiable", "unsupported") & (F.col("confidence") >= 7))


def facts_by_confidence(facts: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Each finding's facts, most confident first, ties in their order; at most ``most`` as one list."""
    k = F.row_number().over(W.partitionBy(key).orderBy(F.desc("confidence"), "pos"))
    top = facts.withColumn("_k", k).where(F.col("_k") <= most)
    return top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "fact"))), lambda x: x["fact"]).alias("facts"))


def citation_changes(before: Column, after: Column) -> Column:
    """(lost, gained) ids of a rewritten text; it is accepted if none is lost."""
    return F.struct(F.array_except(before, after).alias("lost"), F.array_except(after, before).alias("gained"), (F.size(F.array_except(before, after)) == 0).alias("accepted"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order of arrival."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def uncovered_facets(facets: DataFrame, kept: DataFrame) -> DataFrame:
    """(run, facet, kept, uncovered): every facet with its kept sources, those without any named."""
    n = kept.groupBy("run", "facet").agg(F.count(F.lit(1)).alias("kept"))
    return facets.join(n, ["run", "facet"], "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))).withColumn("uncovered", F.col("kept") == 0)


def prefixed(text: Column, model: Column, query: bool) -> Column:
    """A text as the embedder of a model's family wants it; most want it as it is."""
    out = F.lit("")
    for family, (q, doc) in PREFIXES.items():
        out = F.when(F.lower(model).contains(family), q if query else doc).otherwise(out)
    return F.concat(out, text)


def merged_meta(docs: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """JSON documents of one key merged in order, later values winning; what does not parse counts as empty."""
    parsed = docs.select(key, order, F.coalesce(F.from_json(body, "map<string,string>"), F.create_map().cast("map<string,string>")).alias("m"))
    rows = parsed.select(key, order, F.explode_outer("m").alias("name", "value"))
    last = rows.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))))).alias("meta"))


def history(runs: DataFrame, newest: int = 40, days: int = 14, least: int = 2) -> DataFrame:
    """Medians per owner of seconds and cost per kept source and of the keep rate, over the newest runs; of these, over the
    ones of the last days if there are enough."""
    k = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("id")))
    rows = runs.withColumn("_k", k).where(F.col("_k") <= newest)
    rows = rows.withColumn("_recent", F.col("created_at") >= F.date_sub(F.max("created_at").over(W.partitionBy("owner")), days))
    enough = F.count_if("_recent").over(W.partitionBy("owner")) >= least
    rows = rows.withColumn("_use", F.col("_recent") | ~enough).where("_use and kept > 0")
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), 6)
    return rows.groupBy("owner").agg(
        F.count(F.lit(1)).alias("samples"), median(F.col("seconds") / F.col("kept")).alias("seconds"), median(F.col("cost") / F.col("kept")).alias("cost"), median(F.col("kept") / (F.col("kept") + F.col("skipped"))).alias("keep_rate")
    )


def _runs(spark, d):
    return views.runs(spark, d)


def _hits(spark, d):
    e = views.table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 20).alias("q"), (F.col("vec_id") % 60 * 7 + 1).cast("long").alias("run_id"), F.round(0.5 + F.abs(F.get("embedding", F.lit(0)).cast("double")), 4).alias("score"), F.concat(F.lit("t"), "vec_id").alias("title"), "vec_id")


_H = "h as (select vec_id % 20 as q, cast(vec_id % 60 * 7 + 1 as bigint) as run_id, round(0.5 + abs(cast(embedding[1] as double)), 4) as score, 't' || vec_id as title, vec_id from embeddings)"


def _verdicts(spark, d):
    li = views.table(spark, d, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("supported", "contested", "unsupported", "unverifiable")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    hosts = F.array(F.col("l_suppkey") % 3, F.col("l_partkey") % 3)
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("claim"), kind.alias("verdict"), F.when(F.col("l_suppkey") % 4 > 0, F.lit("q")).alias("quote"), hosts.alias("hosts"), (F.col("l_partkey") % 11).alias("confidence"))


_V = "v as (select l_orderkey as doc, l_linenumber as claim, ['supported', 'contested', 'unsupported', 'unverifiable'][l_partkey % 4 + 1] as verdict, l_suppkey % 4 > 0 as quoted, l_suppkey % 3 = l_partkey % 3 as one, l_partkey % 11 as confidence from lineitem)"
_PATH = "case event_id % 5 when 0 then 'findings/01' || (event_id % 10) || '_a-b.md' when 1 then 'rounds/round-' || (event_id % 100) || '.md' when 2 then '../meta.json' when 3 then 'meta.json' else 'overview.md.bak' end"
_R = views.RUNS_SQL
_LEDGER = f"with {_R}, h as (select owner, id, created_at, depth * 60.0 as seconds, cost, cast(id % 7 as int) as kept, cast(id % 5 as int) as skipped from runs)"


def _history(spark, d):
    r = _runs(spark, d)
    return history(r.select("owner", "id", "created_at", (F.col("depth") * 60.0).alias("seconds"), "cost", (F.col("id") % 7).cast("int").alias("kept"), (F.col("id") % 5).cast("int").alias("skipped")), days=400)


def _upserted(spark, d):
    f = views.findings(spark, d).select("run_id", "idx", "relevance", F.col("url"))
    old, new = f.where("idx < 4"), f.where("idx > 2").withColumn("relevance", F.col("relevance") + 100)
    return upserted(old.groupBy("run_id", "idx").agg(F.max(F.struct("url", "relevance")).alias("x")).select("run_id", "idx", "x.relevance", "x.url"), new, ["run_id", "idx"], "url")


def _facets(spark, d):
    r = _runs(spark, d)
    facets = r.where("id % 50 = 1").select(F.col("id").alias("run"), F.explode(F.array(*[F.lit(f"f{k}") for k in range(4)])).alias("facet"))
    kept = views.findings(spark, d).select(F.col("run_id").alias("run"), F.concat(F.lit("f"), F.col("relevance") % 5).alias("facet"))
    return uncovered_facets(facets, kept)


QUERIES = {
    "first_by_name": (
        lambda s, d: by_name(views.table(s, d, "documents").select(F.substring("text", 1, 24).alias("name"), "doc_id").where("name is not null"), "name").select("name").limit(100),
        "select substr(text, 1, 24) as name from documents where text is not null order by lower(substr(text, 1, 24)), substr(text, 1, 24) limit 100",
    ),
    "evergreen_runs": (
        lambda s, d: evergreen(_runs(s, d).withColumn("evergreen", F.col("id") % 3 == 0)).select("id", "owner"),
        f"with {_R} select id, owner from runs where id % 3 = 0 and status = 'completed'",
    ),
    "runs_without_parent": (lambda s, d: unknown(_runs(s, d), "parent_id").select("id"), f"with {_R} select id from runs where parent_id is null"),
    "runs_with_findings": (
        lambda s, d: has_rows(_runs(s, d).select("id"), views.findings(s, d).where("relevance > 8"), "id", "run_id"),
        f"with {_R}, {views.FINDINGS_SQL} select id, id in (select run_id from findings where relevance > 8) as has_rows from runs",
    ),
    "kind_filter": (
        lambda s, d: _runs(s, d).withColumn("kind", F.when(F.col("depth") > 4, "research").otherwise("chat")).where(matches_kind(F.col("kind"), F.col("id") % 2 == 0, "research+matrix") | matches_kind(F.col("kind"), F.lit(False), "chat")).select("id", "kind"),
        f"with {_R} select id, case when depth > 4 then 'research' else 'chat' end as kind from runs where depth <= 4 or id % 2 = 0",
    ),
    "servable_files": (
        lambda s, d: views.table(s, d, "events").select("event_id", is_servable(F.expr(_PATH)).alias("servable")),
        f"select event_id, regexp_matches({_PATH}, '{SERVABLE}') as servable from events",
    ),
    "upserted_findings": (
        _upserted,
        f"""with {views.FINDINGS_SQL}, o as (select run_id, idx, relevance, url, 0 as n from findings where idx < 4 qualify row_number() over (partition by run_id, idx order by url desc, relevance desc) = 1),
        u as (select * from o union all select run_id, idx, relevance + 100, url, 1 from findings where idx > 2)
        select run_id, idx, relevance, url from u qualify row_number() over (partition by run_id, idx order by n desc, url desc, relevance desc) = 1""",
    ),
    "deleted_runs": (
        lambda s, d: without_run(views.findings(s, d), _runs(s, d).where("status = 'queued' or id % 9 = 0").select(F.col("id").alias("run_id"))).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")),
        f"with {_R}, {views.FINDINGS_SQL} select run_id, count(*) as n from findings where run_id not in (select id from runs where status = 'queued' or id % 9 = 0) group by run_id",
    ),
    "recovered_runs": (
        lambda s, d: recovered(_runs(s, d)).select("id", "status", F.coalesce("place", F.lit(0)).alias("place")),
        f"with {_R} select id, case when status = 'running' then 'interrupted' else status end as status, case when status = 'queued' then cast(row_number() over (partition by status, owner order by created_at, id) as int) else 0 end as place from runs",
    ),
    "titled_hits": (
        lambda s, d: titled(_hits(s, d).select("vec_id", "run_id", "title"), _runs(s, d)),
        f"with {_R}, {_H} select vec_id, run_id, coalesce(query, title) as title from h left join runs on id = run_id",
    ),
    "known_hits": (
        lambda s, d: titled(_hits(s, d).select("vec_id", "run_id", "title"), _runs(s, d), True),
        f"with {_R}, {_H} select vec_id, run_id, query as title from h join runs on id = run_id",
    ),
    "similar_hint": (
        lambda s, d: similar_hints(_hits(s, d), _runs(s, d)),
        f"with {_R}, {_H}, b as (select q, run_id, max(score) as score from h group by all), t as (select * from b qualify row_number() over (partition by q order by score desc, run_id) <= 2) select q, run_id, score from t where score >= 0.62 and run_id in (select id from runs where status = 'completed')",
    ),
    "verdict_counts": (
        lambda s, d: verdict_counts(_verdicts(s, d), "doc"),
        f"with {_V} select doc, count(*) filter (verdict = 'supported') as supported, count(*) filter (verdict = 'contested') as contested, count(*) filter (verdict = 'unsupported') as unsupported, count(*) filter (verdict = 'unverifiable') as unverifiable from v group by doc",
    ),
    "bounded_verdicts": (
        lambda s, d: bounded_verdicts(_verdicts(s, d)).select("doc", "claim", "verdict", "settled"),
        f"with {_V}, b as (select doc, claim, confidence, case when verdict <> 'unsupported' then verdict when not quoted then 'unverifiable' when one then 'contested' else verdict end as verdict from v) select doc, claim, verdict, verdict not in ('unverifiable', 'unsupported') and confidence >= 7 as settled from b",
    ),
    "facts_by_confidence": (
        lambda s, d: facts_by_confidence(views.findings(s, d).select("run_id", F.col("relevance").alias("confidence"), "idx", F.col("url").alias("pos"), F.col("domain").alias("fact")), "run_id", 3).select("run_id", F.array_join("facts", ",").alias("facts")),
        f"with {views.FINDINGS_SQL}, k as (select *, row_number() over (partition by run_id order by relevance desc, url) as k from findings) select run_id, string_agg(domain, ',' order by k) as facts from k where k <= 3 group by run_id",
    ),
    "citation_changes": (
        lambda s, d: views.table(s, d, "events").select("event_id", citation_changes(F.expr("array(event_id % 3, event_id % 4, 9L)"), F.expr("array(9L, event_id % 4, event_id % 5)")).alias("c")).select("event_id", F.array_join(F.array_sort("c.lost"), ",").alias("lost"), F.array_join(F.array_sort("c.gained"), ",").alias("gained"), "c.accepted"),
        """with c as (select event_id, list_distinct([event_id % 3, event_id % 4, 9]) as b, list_distinct([9, event_id % 4, event_id % 5]) as a from events),
        x as (select event_id, list_filter(b, lambda i: not list_contains(a, i)) as l, list_filter(a, lambda i: not list_contains(b, i)) as g from c) select event_id, array_to_string(list_sort(l), ',') as lost, array_to_string(list_sort(g), ',') as gained, len(l) = 0 as accepted from x""",
    ),
    "first_of_each_url": (
        lambda s, d: first_wins(views.findings(s, d).groupBy("url", "run_id").agg(F.min("idx").alias("idx")), "url", "run_id"),
        f"with {views.FINDINGS_SQL} select url, run_id, min(idx) as idx from findings group by url, run_id qualify row_number() over (partition by url order by run_id) = 1",
    ),
    "uncovered_facets": (
        _facets,
        f"with {_R}, {views.FINDINGS_SQL}, f as (select id as run, 'f' || unnest(range(0, 4)) as facet from runs where id % 50 = 1), k as (select run_id as run, 'f' || (relevance % 5) as facet, count(*) as kept from findings group by all) select run, facet, coalesce(kept, 0) as kept, kept is null as uncovered from f left join k using (run, facet)",
    ),
    "embedding_prefixes": (
        lambda s, d: views.table(s, d, "documents").select("doc_id", *[F.length(prefixed(F.col("text"), F.expr("case doc_id % 3 when 0 then 'Nomic-embed' when 1 then 'multilingual-E5' else 'bge' end"), q)).alias(c) for q, c in ((True, "as_query"), (False, "as_document"))]),
        "select doc_id, cast(length(text) + [14, 7, 0][doc_id % 3 + 1] as int) as as_query, cast(length(text) + [17, 9, 0][doc_id % 3 + 1] as int) as as_document from documents",
    ),
    "merged_meta": (
        lambda s, d: merged_meta(views.table(s, d, "events").select("user_id", "event_id", F.expr("case when event_id % 9 = 0 then 'torn {' else concat('{\"a', event_id % 3, '\":\"', event_id, '\"}') end").alias("body")), "user_id", "body", "event_id"),
        """with r as (select user_id, 'a' || (event_id % 3) as name, max(event_id) as v from events where event_id % 9 <> 0 group by all)
        select u.user_id, '{' || coalesce(string_agg('"' || name || '":"' || v || '"', ',' order by name), '') || '}' as meta from (select distinct user_id from events) u left join r using (user_id) group by u.user_id""",
    ),
    "run_history": (
        _history,
        f"""{_LEDGER}, k as (select * from h qualify row_number() over (partition by owner order by created_at desc, id desc) <= 40), r as (select *, created_at >= max(created_at) over (partition by owner) - interval 400 day as recent from k),
        e as (select *, count(*) filter (recent) over (partition by owner) >= 2 as enough from r)
        select owner, count(*) as samples, round(quantile_cont(seconds / kept, 0.5), 6) as seconds, round(quantile_cont(cost / kept, 0.5), 6) as cost, round(quantile_cont(kept / (kept + skipped), 0.5), 6) as keep_rate from e where (recent or not enough) and kept > 0 group by owner""",
    ),
}
