"""Page-level operators: feeds, bot walls, tables, references, vocabulary filters, matrices and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions import urls
from ..sources import views
from ..sources.scratch import Scratch, bounded

# Fixed values.
BOT_MARKERS = ("pow_challenge_data", "cf-browser-verification", "challenge-platform", "just a moment...", "checking your browser", "enable javascript and cookies to continue")
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"


def looks_bot_walled(text: Column, first: int = 8000) -> Column:
    head = F.lower(F.substring(text, 1, first))
    out = F.lit(False)
    for m in BOT_MARKERS:
        out = out | head.contains(m)
    return out


def has_table(md: Column) -> Column:
    """A separator row below a row with two pipes or more."""
    return tx.let(
        F.split(md, "\n"),
        lambda lines: F.exists(
            F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(lines, i - 1)).otherwise(F.lit("")).alias("above"))),
            lambda p: p["x"].rlike(TABLE_RULE) & (F.length(p["above"]) - F.length(F.replace(p["above"], F.lit("|"), F.lit(""))) >= 2),
        ),
    )


def is_markdown_document(md: Column) -> Column:
    return F.exists(F.slice(F.split(F.trim(md), "\n"), 1, 3), lambda x: x.rlike(r"^#{1,6}\s")) & ~tx.is_degenerate(md)


def feed_entries(feeds: DataFrame, body: str = "body", limit: int = 25) -> DataFrame:
    """Entries of RSS and Atom bodies: feed, pos, title (300), link, published; at most ``limit`` of each feed."""
    entry = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    made = feeds.select("feed", F.posexplode(F.slice(entry, 1, limit)).alias("pos", "e"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{name}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1), r"<[^>]*>", ""))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("e", r"<link\b[^>]*href=\"([^\"]*)\"", 1), F.lit("")))
    from ..functions.coerce import published

    when = F.coalesce(F.nullif(tag("pubDate"), F.lit("")), F.nullif(tag("published"), F.lit("")), tag("updated"))
    return made.select("feed", "pos", F.substring(tag("title"), 1, 300).alias("title"), link.alias("link"), published(when).alias("published")).where("link is not null")


def merged_feeds(entries: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """One row per link, the first by date (undated last), without what is older than the cutoff."""
    kept = entries if cutoff is None else entries.where(F.col("published").isNull() | (F.col("published") >= cutoff))
    rest = [c for c in entries.columns if c != "link"]
    best = kept.groupBy("link").agg(F.min_by(F.struct(*rest), F.struct(F.col("published").isNull(), -F.unix_date("published"), "feed", "pos")).alias("s"))
    return best.select("link", *[F.col(f"s.{c}") for c in rest])


def filter_by_vocabulary(pool: DataFrame, vocabulary: list[str], limit: int, exempt: list[str] | None = None) -> DataFrame:
    """Candidates that share a stemmed word with the vocabulary or are on an exempt domain; if fewer than ``limit`` do,
    all of them, those first (``tier`` 0). Whether there are enough is a scalar of the same plan; no action runs here."""
    shares = F.arrays_overlap(tx.vocabulary(F.col("text")), F.array(*[F.lit(v) for v in vocabulary]))
    if exempt and "domain" in pool.columns:
        shares = shares | urls.under(F.col("domain"), exempt)
    made = pool.withColumn("shares", F.coalesce(shares, F.lit(False)))
    enough = made.where("shares").agg((F.count(F.lit(1)) >= limit).alias("enough")).scalar()
    return made.where(F.col("shares") | ~enough).withColumn("tier", F.when(F.col("shares"), 0).otherwise(1))


def select_references(links: DataFrame, query: str, per_source: int = 3) -> DataFrame:
    """Outbound links worth following: other domains, no social or unreadable hosts, best lexical score first."""
    host = urls.domain_of(F.col("link"))
    made = links.withColumn("host", host).where((F.col("host") != F.col("domain")) & ~urls.is_unreadable(F.col("link")) & ~urls.is_blocked(F.col("link")))
    made = made.withColumn("score", F.round(tx.overlap(F.lit(query), F.concat_ws(" ", "anchor", F.regexp_replace("link", "[^a-zA-Z0-9]", " "))), 6)).where("score > 0")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return made.withColumn("place", rank).where(F.col("place") <= per_source)


def fresh_queries(proposed: DataFrame, prior: list[str], breadth: int, near: float = 0.7) -> DataFrame:
    """Proposed queries (group, pos, query) unlike earlier ones and those accepted before them; the first ``breadth``.

    Acceptance depends on what was accepted, so each round takes every group's first query, after those that were taken,
    that is like none of them: a minimum, of which tasks send one row a group, however large groups are.
    """
    scratch = Scratch(proposed.sparkSession, "fresh-queries")
    words = tx.facet_words(F.col("query"))
    rows = scratch.written(proposed.groupBy("group", "pos", "query").agg(F.count(F.lit(1)).cast("int").alias("n")).select("group", F.struct("pos", "query").alias("at"), words.alias("w"), "n"), "proposed")
    start = F.transform(F.array(*[F.lit(p) for p in prior]).cast("array<string>"), tx.facet_words).cast("array<array<string>>")
    none = F.lit(None).cast(rows.schema["at"].dataType)
    taken = rows.select("group").distinct().select("group", start.alias("seen"), F.array().cast("array<string>").alias("out"), none.alias("last"), F.lit(True).alias("open"))
    taken = scratch.written(taken, "taken")
    like = F.exists("seen", lambda p: (F.size(p) > 0) & (F.size("w") > 0) & (F.size(F.array_intersect("w", p)) / F.size(F.array_union("w", p)) >= near))
    for _ in range(breadth):
        now = bounded(taken.where("open").withColumnRenamed("group", "_g"))
        after = rows.join(now, F.col("group").eqNullSafe(F.col("_g"))).where((F.col("last").isNull() | (F.col("at") > F.col("last"))) & ~like)
        first = after.groupBy("_g").agg(F.min(F.struct("at", "w", "n")).alias("x"), F.lit(True).alias("found"))
        copies = F.when((F.size("x.w") == 0) | F.lit(near > 1), F.col("x.n")).otherwise(1)  # copies are alike, unless they have no words
        made = taken.join(bounded(scratch.written(first, "first")), F.col("group").eqNullSafe(F.col("_g")), "left").select(
            "group",
            F.when(F.col("found"), F.concat("seen", F.array("x.w"))).otherwise(F.col("seen")).alias("seen"),
            F.when(F.col("found"), F.concat("out", F.array_repeat("x.at.query", copies))).otherwise(F.col("out")).alias("out"),
            F.coalesce("x.at", "last").alias("last"),
            F.coalesce("found", F.lit(False)).alias("open"),
        )
        taken = scratch.written(made.withColumn("open", F.col("open") & (F.size("out") < breadth)), "taken")
        if taken.where("open").isEmpty():
            break
    return scratch.result(taken.select("group", F.slice("out", 1, breadth).alias("queries")), "fresh-queries")


def matrix_cells(entities: DataFrame, dimensions: DataFrame, cells: DataFrame) -> DataFrame:
    """The whole grid of (entity, dimension) with its values, blanks where none is known; both lists are short."""
    grid = entities.join(F.broadcast(dimensions))
    return grid.join(cells, ["entity", "dimension"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def evidence_pages(hits: DataFrame) -> DataFrame:
    """One row per page that several claims lean on: its best score, its claims, the first of them."""
    return hits.groupBy("url").agg(F.max("score").alias("score"), F.count_distinct("claim").alias("claims"), F.min("claim").alias("first_claim"))


def refusal_shares(events: DataFrame) -> DataFrame:
    """Usage by kind with the share of cached tokens: counts, sums and a ratio in one pass."""
    made = events.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("prompt"), 4).alias("prompt"), F.round(F.sum("cached"), 4).alias("cached"))
    return made.withColumn("cached_share", F.round(F.col("cached") / F.nullif(F.col("prompt"), F.lit(0.0)), 4))


def chosen_claims(claims: DataFrame, cap: int) -> DataFrame:
    """The most important checkable claims of each document in document order; the rest say why they were left."""
    rank = F.row_number().over(W.partitionBy("doc_id", "checkable").orderBy(F.desc("importance"), "pos"))
    fate = F.when(~F.col("checkable"), "uncheckable").when(F.col("_k") <= cap, "checked").otherwise("skipped")
    return claims.withColumn("_k", rank).withColumn("fate", fate).drop("_k")


def worst_verdict(verdicts: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for pair in (("unsupported", 0), ("contested", 1), ("unverifiable", 2), ("supported", 3)) for x in pair])
    return verdicts.groupBy("claim").agg(F.min_by("verdict", F.struct(order[F.col("verdict")], "verdict")).alias("verdict"), F.count(F.lit(1)).alias("n"))


def hit_rates(ranked: DataFrame, ks=(1, 3, 10)) -> DataFrame:
    """Share of queries whose right run is among the first k."""
    own = ranked.groupBy("q").agg(F.min(F.when(F.col("right"), F.col("rank"))).alias("first"))
    return own.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")), 4).alias(f"hit_{k}") for k in ks])


def score_calibration(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by a document's own heuristic score: does the score order quality?"""
    score = F.least(F.floor(F.length("text") / 1000), F.lit(10))
    return docs.select("doc_id", score.alias("score")).join(labels, "doc_id").groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))


def _docs(spark, d):
    return views.table(spark, d, "documents")


def _links(spark, d):
    p = views.table(spark, d, "pages").select("page_id", "url", F.regexp_replace("html", 'href="/', 'href="https://site.example/').alias("html"))
    found = urls.outbound_links(p).join(p.select("page_id", urls.domain_of(F.col("url")).alias("domain")), "page_id")
    return found.withColumn("anchor", F.regexp_extract("link", "[^/]*$", 0))


def _feeds(spark, d, feed: str = "page_id % 9"):
    p = views.table(spark, d, "pages")
    item = F.concat(F.lit("<item><title>t"), F.col("page_id"), F.lit("</title><link>"), "url", F.lit("</link><pubDate>Mon, 0"), F.col("page_id") % 9 + 1, F.lit(" Jan 2024 10:00:00 GMT</pubDate></item>"))
    return p.groupBy(F.expr(feed).alias("feed")).agg(F.concat(F.lit("<rss>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x["i"]), ""), F.lit("</rss>")).alias("body"))


def _claims(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_quantity").cast("int").alias("importance"), (F.col("l_returnflag") != "R").alias("checkable"), "l_partkey", "l_suppkey")


def _sniffed(spark, d):
    """Documents as pages, some of them walls, Markdown, degenerate or with a table."""
    return _docs(spark, d).select("doc_id", F.expr(_SNIFF).alias("text"))


_SNIFF = """case doc_id % 6 when 0 then 'Just a MOMENT... ' || text when 1 then '# T' || chr(10) || text when 2 then text || chr(10) || '| a | b |' || chr(10) || '| --- | :-: |' || chr(10)
  when 3 then '## H' || chr(10) || repeat('abab ', 60) when 4 then text || chr(10) || 'a | b' || chr(10) || '|---|---|' else '<script>POW_challenge_data</script>' || text end"""
_URL = "lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1))"
QUERIES = {
    "page_sniffs": (
        lambda s, d: _sniffed(s, d).select("doc_id", looks_bot_walled(F.col("text")).alias("walled"), is_markdown_document(F.col("text")).alias("markdown"), has_table(F.col("text")).alias("table")),
        f"""with t as (select doc_id, {_SNIFF} as t from documents), h as (select doc_id, t, substr(t, 1, 4000) as f, string_split(t, chr(10)) as l, string_split(trim(t), chr(10))[1:3] as top from t),
        c as (select *, list_distinct(string_split(f, '')) as cs from h)
        select doc_id, contains(lower(substr(t, 1, 8000)), 'just a moment...') or contains(lower(substr(t, 1, 8000)), 'pow_challenge_data') as walled,
          len(list_filter(top, lambda x: regexp_matches(x, '^#{{1,6}}\\s'))) > 0 and not (length(t) >= 200 and (len(cs) <= 12 or list_max(list_transform(cs, lambda c: length(f) - length(replace(f, c, '')))) > 0.5 * length(f))) as markdown,
          len(list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '{TABLE_RULE}') and length(l[i - 1]) - length(replace(l[i - 1], '|', '')) >= 2)) > 0 as table from c""",
    ),
    "feed_union": (
        lambda s, d: merged_feeds(feed_entries(_feeds(s, d)), F.lit("2024-01-03").cast("date")).select("link", "feed", F.col("published").cast("string").alias("published")),
        """with k as (select page_id, url, page_id % 9 as feed, row_number() over (partition by page_id % 9 order by page_id) as n from pages)
        select url as link, feed, '2024-01-0' || (page_id % 9 + 1) as published from k where n <= 25 and page_id % 9 + 1 >= 3 qualify row_number() over (partition by url order by page_id % 9 desc, feed, n) = 1""",
    ),
    "feed_union_all": (
        lambda s, d: merged_feeds(feed_entries(_feeds(s, d, "page_id div 20")), F.lit("2024-01-03").cast("date")).select("link", "feed", F.col("published").cast("string").alias("published")),
        """select url as link, page_id // 20 as feed, '2024-01-0' || (page_id % 9 + 1) as published from pages
        where page_id % 9 + 1 >= 3 qualify row_number() over (partition by url order by page_id % 9 desc, page_id) = 1""",
    ),
    "vocabulary_filter": (
        lambda s, d: filter_by_vocabulary(_docs(s, d).select("doc_id", "text"), ["schein", "keit", "zzz"], 5).select("doc_id", "shares", "tier"),
        f"""with v as (select doc_id, list_has_any({tx._VOC}, ['schein', 'keit', 'zzz']) as shares from documents)
        select doc_id, shares, case when shares then 0 else 1 end as tier from v where shares or (select count(*) from v where shares) < 5""",
    ),
    "vocabulary_filter_short": (
        lambda s, d: filter_by_vocabulary(_docs(s, d).select("doc_id", "text", F.concat(F.lit("d"), F.col("doc_id") % 3, F.lit(".org")).alias("domain")), ["zzz"], 10**6, ["d1.org"]).select("doc_id", "shares", "tier"),
        "select doc_id, doc_id % 3 = 1 as shares, case when doc_id % 3 = 1 then 0 else 1 end as tier from documents",
    ),
    "reference_links": (lambda s, d: select_references(_links(s, d), "the and für Nicht site").select("page_id", "link", "score", "place"), None),
    "fresh_queries": (lambda s, d: fresh_queries(_docs(s, d).select(F.col("source").alias("group"), F.col("doc_id").alias("pos"), F.substring("text", 1, 60).alias("query")), ["the quick brown fox"], 5), None),
    "matrix_grid": (
        lambda s, d: matrix_cells(
            views.table(s, d, "nation").select(F.col("n_name").alias("entity")),
            views.table(s, d, "region").select(F.col("r_name").alias("dimension")),
            views.table(s, d, "nation").join(views.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("dimension"), F.lit("yes").alias("value")),
        ),
        "select n.n_name as entity, r.r_name as dimension, case when n.n_regionkey = r.r_regionkey then 'yes' else '' end as value from nation n cross join region r",
    ),
    "evidence_pages": (
        lambda s, d: evidence_pages(_claims(s, d).select(F.concat(F.lit("p"), F.col("l_partkey")).alias("url"), F.col("importance").alias("score"), F.col("doc_id").alias("claim"))),
        "select 'p' || l_partkey as url, max(cast(trunc(l_quantity) as int)) as score, count(distinct l_orderkey) as claims, min(l_orderkey) as first_claim from lineitem group by l_partkey",
    ),
    "usage_rollup": (
        lambda s, d: refusal_shares(views.table(s, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("prompt"), F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0).alias("cached"))),
        "with g as (select event_type as kind, count(*) as calls, round(sum(value), 4) as prompt, round(sum(case when event_id % 3 = 0 then value else 0.0 end), 4) as cached from events group by 1) select *, round(cached / nullif(prompt, 0.0), 4) as cached_share from g",
    ),
    "claim_selection": (
        lambda s, d: chosen_claims(_claims(s, d).groupBy("doc_id", "pos").agg(F.max("importance").alias("importance"), F.bool_or("checkable").alias("checkable")), 2),
        """with c as (select l_orderkey as doc_id, cast(l_linenumber as int) as pos, max(cast(trunc(l_quantity) as int)) as importance, bool_or(l_returnflag <> 'R') as checkable from lineitem group by 1, 2)
        select *, case when not checkable then 'uncheckable' when row_number() over (partition by doc_id, checkable order by importance desc, pos) <= 2 then 'checked' else 'skipped' end as fate from c""",
    ),
    "worst_verdict": (
        lambda s, d: worst_verdict(
            views.table(s, d, "lineitem").select(
                F.col("l_orderkey").alias("claim"), F.when(F.col("l_quantity") < 5, "unsupported").when(F.col("l_quantity") < 15, "contested").when(F.col("l_quantity") < 30, "unverifiable").otherwise("supported").alias("verdict")
            )
        ),
        """with v as (select l_orderkey as claim, case when l_quantity < 5 then 0 when l_quantity < 15 then 1 when l_quantity < 30 then 2 else 3 end as k from lineitem)
        select claim, ['unsupported', 'contested', 'unverifiable', 'supported'][min(k) + 1] as verdict, count(*) as n from v group by claim""",
    ),
    "score_calibration": (
        lambda s, d: score_calibration(_docs(s, d), views.table(s, d, "labels")),
        "select least(length(text) // 1000, 10) as score, count(*) as n, round(avg(quality), 4) as quality, round(avg(toxic), 4) as toxic from documents join labels using (doc_id) group by 1",
    ),
    "retrieval_hit_rates": (
        lambda s, d: hit_rates(views.table(s, d, "embeddings").select((F.col("vec_id") % 40).alias("q"), F.floor(F.col("vec_id") / 40).alias("rank"), (F.col("label") == F.col("vec_id") % 10).alias("right"))),
        """with f as (select vec_id % 40 as q, min(case when label = vec_id % 10 then vec_id // 40 end) as first from embeddings group by 1)
        select count(*) as queries, round(avg(case when first <= 1 then 1 else 0 end), 4) as hit_1, round(avg(case when first <= 3 then 1 else 0 end), 4) as hit_3, round(avg(case when first <= 10 then 1 else 0 end), 4) as hit_10 from f""",
    ),
}
