"""Candidates of a search round: their full order, who is spared, shares of engines, what dropped ones have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views

# Fixed values.
GENERAL_ENGINES = ("bing", "google", "google cse", "duckduckgo", "brave", "startpage", "mojeek", "qwant", "yahoo", "wikipedia", "wikidata", "presearch", "marginalia", "mullvad leta", "mwmbl", "braveapi")
FIRST_ENGINES = ("braveapi", "marginalia", "google cse")
ROUNDUP = r"(?i)\b(best|top\s*\d+|\d+\s+best|vs\.?|versus|compared?|comparison|alternatives?|which\s+(?:one|is)|reviews?|reviewed|roundup|ranked)\b"
GENERIC_DOMAINS = ("wikipedia.org", "reddit.com", "youtube.com", "youtu.be", "github.com", "amazon.com", "medium.com", "stackexchange.com", "stackoverflow.com", "quora.com", "facebook.com", "x.com", "twitter.com")
CHALLENGE_CODES = (202, 401, 403, 405, 406, 429, 503)
SCOPES = {"web": "general", "video": "videos", "code": "it", "academic": "science", "qa": "q&a", "news": "news", "social": "social media", "files": "files"}


def engine_key(engine: Column, known_yield: Column, promote=()) -> list[Column]:
    """(tier, turn, unproven, -yield): general engines before others, keyed and promoted ones first, records before none."""
    e = F.lower(F.trim(engine))
    first = e.isin(*FIRST_ENGINES, *promote)
    tier = F.when(e.isin(*GENERAL_ENGINES, *promote), 0).otherwise(1)
    return [tier, F.when(first, 0).otherwise(1), F.when(known_yield.isNull(), 1).otherwise(0), -F.round(F.coalesce(known_yield, F.lit(0.0)), 3)]


def refill_key(engine: Column, read: Column, kept: Column, known_yield: Column, promote=()) -> list[Column]:
    """As ``engine_key`` for what an engine's share held back: this run's own record counts before the install's."""
    e = F.lower(F.trim(engine))
    tier = F.when(e.isin(*GENERAL_ENGINES, *promote), 0).otherwise(1)
    own = F.when(F.coalesce(read, F.lit(0)) > 0, F.coalesce(kept, F.lit(0)) / read)
    return [tier, F.when(e.isin(*promote), 0).otherwise(1) if promote else F.lit(1), F.when(own.isNull(), 1).otherwise(0), -F.round(F.coalesce(own, known_yield, F.lit(0.0)), 3)]


def candidate_sort(candidates: DataFrame, keys: list[Column], group: str = "round") -> DataFrame:
    """``candidates`` (shares, dead, index_page, relevance, pos) with their place within the group.

    Those without a word of the question come last, then dead domains, the engine's keys, index pages, relevance; ties
    keep their arrival.
    """
    order = [~F.col("shares"), F.col("dead"), *keys, F.col("index_page"), -F.col("relevance"), F.col("pos")]
    return candidates.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def engine_records(outcomes: DataFrame, least: int = 15) -> DataFrame:
    """(engine, known_yield) of engines with ``least`` reads or more; as many rows as there are engines."""
    made = outcomes.groupBy("engine").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("outcome") == "kept").alias("kept"))
    return made.where(F.col("reads") >= least).select("engine", (F.col("kept") / F.col("reads")).alias("known_yield"))


def spared_roundups(condemned: DataFrame, limit: int = 4, video_hosts=("youtube.com", "vimeo.com")) -> DataFrame:
    """The best-ranked condemned candidates of each round whose title is a roundup's and whose host shows no videos."""
    like = condemned.where(F.col("title").rlike(ROUNDUP) & ~F.col("domain").isin(*video_hosts))
    return like.withColumn("place", F.row_number().over(W.partitionBy("round").orderBy("pos"))).where(F.col("place") <= limit)


def is_generic(domain: Column) -> Column:
    out = F.lit(False)
    for g in GENERIC_DOMAINS:
        out = out | (domain == g) | domain.endswith("." + g)
    return out


def spared_productive(condemned: DataFrame, kept: DataFrame) -> DataFrame:
    """Condemned candidates on a domain, or below one, that the round's run has kept a source from; generic hosts aside.

    Hosts are taken apart into their suffixes and meet the kept domains in an equi-join.
    """
    parts = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = condemned.select("round", "pos", F.explode(suffixes).alias("suffix"))
    good = kept.where(~is_generic(F.col("domain"))).select("round", F.col("domain").alias("suffix")).distinct()
    return asked.join(good, ["round", "suffix"], "left_semi").select("round", "pos").distinct()


def dropped_domains(dropped: DataFrame, most: int = 4) -> DataFrame:
    """Per round the domains that most dropped candidates have, as ``domain ×n``; of equals the one that came first."""
    n = dropped.groupBy("round", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("round").orderBy(F.desc("n"), "first"))).where(F.col("k") <= most)
    label = F.when(F.col("n") > 1, F.concat("domain", F.lit(" ×"), "n")).otherwise(F.col("domain"))
    return top.groupBy("round").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", label.alias("label")))), lambda x: x["label"]), ", ").alias("domains"))


def productive_queries(searched: DataFrame, found: DataFrame, breadth: int = 3) -> DataFrame:
    """Per run the searched queries with most kept sources; the opening queries where nothing was kept."""
    kept = found.groupBy("run", "query").agg(F.count(F.lit(1)).alias("kept"))
    made = searched.groupBy("run", "query").agg(F.min("pos").alias("pos")).join(kept, ["run", "query"], "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    whole = F.max("kept").over(W.partitionBy("run"))
    place = F.row_number().over(W.partitionBy("run").orderBy(F.desc("kept"), "pos"))
    return made.withColumn("_any", whole).where((F.col("kept") > 0) | (F.col("_any") == 0)).withColumn("place", place).where(F.col("place") <= breadth).select("run", "query", "kept", "place")


def engine_share(limit: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(limit / 3)).cast("int")


def seeds(kept: DataFrame) -> DataFrame:
    """(domain, seed): what related runs kept earns a start; three sources two slots, two one, generic hosts none."""
    d = F.regexp_replace(F.lower("domain"), r"^www\.", "")
    rows = kept.select(d.alias("domain"), "kept").where((F.col("domain") != "") & ~is_generic(F.col("domain")))
    return rows.withColumn("seed", F.when(F.col("kept") >= 3, 2).when(F.col("kept") == 2, 1)).where("seed is not null").select("domain", "seed")


def is_challenge(reason: Column) -> Column:
    code = F.regexp_extract(reason, r"http (\d+)", 1).try_cast("int")
    return F.coalesce(code.isin(*CHALLENGE_CODES) | code.between(520, 526), F.lit(False))


def degraded_runs(searches: DataFrame) -> DataFrame:
    """Runs all of whose searches were empty while some engine refused."""
    made = searches.groupBy("run").agg(F.bool_and(F.col("results") == 0).alias("empty"), F.bool_or("refused").alias("refused"))
    return made.select("run", (F.col("empty") & F.col("refused")).alias("degraded"))


def _of_events(spark, d):
    e = views.table(spark, d, "events")
    names = F.array(*[F.lit(x) for x in _ENGINES])
    titles = F.array(*[F.lit(x) for x in _TITLES])
    return e.select(
        F.floor(F.col("event_id") / 60).alias("round"),
        F.col("event_id").alias("pos"),
        F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("engine"),
        F.concat(F.lit("d"), F.col("user_id") % 12, F.when(F.col("user_id") % 4 == 0, ".reddit.com").otherwise(".example")).alias("domain"),
        F.element_at(titles, (F.col("user_id") % 5 + 1).cast("int")).alias("title"),
        (F.col("event_id") % 5 != 0).alias("shares"),
        (F.col("event_id") % 6 == 0).alias("index_page"),
        F.floor(F.least("value", F.lit(100.0)) / 10).cast("int").alias("relevance"),
        F.when(F.col("event_type") == "purchase", "kept").when(F.col("event_type") == "error", "fail").otherwise("rejected").alias("outcome"),
    )


_ENGINES = ("bing", "duckduckgo", "braveapi", "youtube", "arxiv", "google cse", "vimeo", "mojeek")
_TITLES = ("Best tents of the year", "A field guide", "Tents vs tarps", "Notes on canvas", "12 alternatives reviewed")
_C = f"""c as (select event_id // 60 as round, event_id as pos, {list(_ENGINES)}[event_id % 8 + 1] as engine,
  'd' || (user_id % 12) || case when user_id % 4 = 0 then '.reddit.com' else '.example' end as domain, {list(_TITLES)}[user_id % 5 + 1] as title,
  event_id % 5 <> 0 as shares, event_id % 6 = 0 as index_page, cast(floor(least(value, 100.0) / 10) as int) as relevance,
  case event_type when 'purchase' then 'kept' when 'error' then 'fail' else 'rejected' end as outcome from events)"""
_Y = "y as (select engine, count(*) filter (outcome = 'kept') / count(*) as known_yield from c where pos % 3 > 0 group by engine having count(*) >= 15), dead as (select domain from c group by domain having count(*) filter (outcome = 'kept') < 2)"
_TIER = f"case when engine in {GENERAL_ENGINES + ('vimeo',)} then 0 else 1 end"


def _full(spark, d):
    c = _of_events(spark, d)
    records = engine_records(c.where("pos % 3 > 0"))
    dead = c.groupBy("domain").agg(F.count_if(F.col("outcome") == "kept").alias("k")).where("k < 2").select("domain", F.lit(True).alias("dead"))
    return c.join(records, "engine", "left").join(dead, "domain", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))


def _refill(spark, d):
    c = _full(spark, d)
    own = c.where("pos % 2 = 0").groupBy("round", "engine").agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("outcome") == "kept").alias("kept"))
    c = c.join(own, ["round", "engine"], "left")
    return candidate_sort(c, refill_key(F.col("engine"), F.col("read"), F.col("kept"), F.col("known_yield"), ("vimeo",))).select("pos", "round", "place")


def _seeded(spark, d):
    c = _of_events(spark, d).where("outcome = 'kept'")
    return seeds(c.groupBy(F.concat(F.lit("WWW."), "domain").alias("domain")).agg((F.count(F.lit(1)) % 5).alias("kept")))


QUERIES = {
    "candidate_sort": (
        lambda s, d: candidate_sort(_full(s, d), engine_key(F.col("engine"), F.col("known_yield"), ("vimeo",))).select("pos", "round", "place"),
        f"""with {_C}, {_Y} select pos, round, cast(row_number() over (partition by round order by not shares, dead.domain is not null, {_TIER},
          case when engine in ('braveapi', 'marginalia', 'google cse', 'vimeo') then 0 else 1 end, known_yield is null, -round(coalesce(known_yield, 0), 3), index_page, -relevance, pos) as int) as place
        from c left join y using (engine) left join dead using (domain)""",
    ),
    "refill_sort": (
        _refill,
        f"""with {_C}, {_Y}, o as (select round, engine, count(*) as read, count(*) filter (outcome = 'kept') as kept from c where pos % 2 = 0 group by all)
        select pos, round, cast(row_number() over (partition by round order by not shares, dead.domain is not null, {_TIER}, case when engine = 'vimeo' then 0 else 1 end, read is null,
          -round(coalesce(kept / read, known_yield, 0), 3), index_page, -relevance, pos) as int) as place
        from c left join y using (engine) left join dead using (domain) left join o using (round, engine)""",
    ),
    "spared_roundups": (
        lambda s, d: spared_roundups(_of_events(s, d).where("outcome = 'fail'"), 2, ("d1.example",)).select("round", "pos", "place"),
        f"with {_C} select round, pos, cast(row_number() over (partition by round order by pos) as int) as place from c where outcome = 'fail' and domain <> 'd1.example' and regexp_matches(title, '{ROUNDUP}') qualify place <= 2",
    ),
    "spared_productive": (
        lambda s, d: spared_productive(_of_events(s, d).where("outcome = 'fail'").withColumn("domain", F.concat(F.lit("m."), "domain")), _of_events(s, d).where("outcome = 'kept'")),
        f"with {_C}, k as (select distinct round, domain from c where outcome = 'kept' and not ends_with(domain, '.reddit.com')) select distinct round, pos from c where outcome = 'fail' and exists (select 1 from k where k.round = c.round and ends_with('m.' || c.domain, '.' || k.domain))",
    ),
    "dropped_domains": (
        lambda s, d: dropped_domains(_of_events(s, d).where("outcome = 'rejected'")),
        f"with {_C}, n as (select round, domain, count(*) as n, min(pos) as f from c where outcome = 'rejected' group by all), k as (select *, row_number() over (partition by round order by n desc, f) as k from n) select round, string_agg(case when n > 1 then domain || ' ×' || n else domain end, ', ' order by k) as domains from k where k <= 4 group by round",
    ),
    "productive_queries": (
        lambda s, d: productive_queries(
            _of_events(s, d).select(F.floor(F.col("round") / 2).alias("run"), F.concat(F.lit("q"), F.col("pos") % 7).alias("query"), "pos"),
            _of_events(s, d).where("outcome = 'kept' and round % 4 > 1").select(F.floor(F.col("round") / 2).alias("run"), F.concat(F.lit("q"), F.col("pos") % 9).alias("query")),
        ),
        f"""with {_C}, s as (select round // 2 as run, 'q' || (pos % 7) as query, min(pos) as pos from c group by 1, 2), k as (select round // 2 as run, 'q' || (pos % 9) as query, count(*) as kept from c where outcome = 'kept' and round % 4 > 1 group by 1, 2),
        m as (select s.*, coalesce(kept, 0) as kept, max(coalesce(kept, 0)) over (partition by s.run) as top from s left join k using (run, query))
        select run, query, kept, cast(row_number() over (partition by run order by kept desc, pos) as int) as place from m where kept > 0 or top = 0 qualify place <= 3""",
    ),
    "source_seeds": (
        _seeded,
        f"with {_C}, k as (select domain, count(*) % 5 as kept from c where outcome = 'kept' group by domain) select domain, case when kept >= 3 then 2 else 1 end as seed from k where kept >= 2 and not ends_with(domain, '.reddit.com')",
    ),
    "challenge_statuses": (
        lambda s, d: _of_events(s, d).select("pos", is_challenge(F.concat(F.lit("failed: http "), 400 + F.col("pos") % 130)).alias("challenge"), is_challenge(F.col("title")).alias("none"), engine_share(F.col("relevance") + 1).alias("share")),
        f"with {_C} select pos, (400 + pos % 130) in {CHALLENGE_CODES} or (400 + pos % 130) between 520 and 526 as challenge, false as none, cast(greatest(1, ceil((relevance + 1) / 3)) as int) as share from c",
    ),
    "degraded_runs": (
        lambda s, d: degraded_runs(_of_events(s, d).select(F.floor(F.col("pos") / 3).alias("run"), F.when(F.col("outcome") == "kept", F.col("relevance")).otherwise(0).alias("results"), (F.col("outcome") == "fail").alias("refused"))),
        f"with {_C} select pos // 3 as run, bool_and(outcome <> 'kept' or relevance = 0) and bool_or(outcome = 'fail') as degraded from c group by 1",
    ),
}
