"""Search queries as Column expressions: shortening, thinning out names, anchoring, scopes, and what people type for a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views
from .text import FILLER, let

# Fixed values.
QUERY_STOPWORDS = "the a an of for to in on at by with and or vs how do does did is are was what which why when where who i my your best top guide diy".split()
SCOPES = {"web": "general", "video": "videos", "code": "it", "academic": "science", "qa": "q&a", "news": "news", "social": "social media", "files": "files"}
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
_EDGE = "\"'()[],.:;"


def _tokens(query: Column) -> Column:
    return F.array_remove(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), "")


def shorten_query(query: Column, words: int = 4) -> Column:
    """The first content words without site: terms; the first words of any kind where there is no content."""
    plain = F.filter(_tokens(query), lambda t: ~F.lower(t).startswith("site:"))
    content = F.filter(plain, lambda t: ~F.btrim(F.lower(t), F.lit("?.,!:;\"'()")).isin(*QUERY_STOPWORDS))
    return F.array_join(F.slice(F.when(F.size(content) > 0, content).otherwise(plain), 1, words), " ")


def generalize_query(query: Column, known: Column) -> Column:
    """The query without the names that ``known`` (lower-case words) lacks, or but its first name if it has them all; empty
    where fewer than two names or two words would be left."""

    def row(t: Column, i: Column) -> Column:
        name = lambda c: (F.length(c) >= 2) & c.rlike("[A-Za-z]") & ((c == F.upper(c)) | c.rlike("^[A-Z].*[a-z]"))
        return let(F.btrim(t, F.lit(_EDGE)), lambda c: F.struct(t.alias("t"), i.alias("i"), name(c).alias("name"), F.array_contains(known, F.lower(c)).alias("known")))

    def thin(rows: Column) -> Column:
        names = F.filter(rows, lambda x: x["name"])
        marks = F.struct(F.size(names).alias("n"), F.exists(names, lambda x: ~x["known"]).alias("strange"), F.array_min(F.transform(names, lambda x: x["i"])).alias("first"))
        return let(marks, lambda m: rest(rows, m, F.filter(rows, lambda x: ~(x["name"] & F.when(m["strange"], ~x["known"]).otherwise(x["i"] != m["first"])))))

    def rest(rows: Column, m: Column, kept: Column) -> Column:
        good = lambda k: (m["n"] >= 2) & (F.size(k) >= 2) & (F.size(k) < F.size(rows))
        return let(kept, lambda k: F.when(good(k), F.array_join(F.transform(k, lambda x: x["t"]), " ")).otherwise(""))

    return let(F.transform(_tokens(query), row), thin)


def facet_query(facet: Column, subject: Column | None = None) -> Column:
    """The facet's words without filler behind up to three words of the subject, 120 characters of them."""
    name = F.trim(F.regexp_replace(F.replace(F.lower(facet), F.lit("_"), F.lit(" ")), r"\s+", " "))
    words = F.filter(F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*FILLER))
    head = F.lit("") if subject is None else F.array_join(F.slice(_tokens(subject), 1, 3), " ")
    return F.trim(F.substring(F.trim(F.concat_ws(" ", head, F.array_join(words, " "))), 1, 120))


def top_up_queries(facet: Column, subject: Column, from_question: Column) -> Column:
    """What to ask about an uncovered facet, best first: plain first if the question itself named it."""
    plain, anchored = facet_query(facet), facet_query(facet, subject)
    return F.array_distinct(F.filter(F.when(from_question, F.array(plain, anchored)).otherwise(F.array(anchored, plain)), lambda q: q != ""))


def categories_for_scope(scope: Column, allowed: Column) -> Column:
    """Categories of a query's scope within those allowed; a web query where none is left, null where that is not allowed."""
    names = F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair])
    wanted = F.filter(F.transform(F.split(F.lower(F.trim(scope)), r"[+,/ ]+"), lambda t: F.try_element_at(names, t)), lambda c: c.isNotNull())
    allowed_list = F.filter(F.transform(F.split(allowed, ","), lambda c: F.trim(c)), lambda c: c != "")

    def choose(ok: Column) -> Column:
        kept = F.array_distinct(F.filter(wanted, lambda c: (F.size(ok) == 0) | F.array_contains(ok, c)))
        web = F.when(F.array_contains(ok, "general"), F.when(F.array_contains(ok, "videos"), "general,videos").otherwise("general"))
        return F.when(F.size(kept) > 0, F.array_join(kept, ",")).otherwise(web)

    return let(allowed_list, choose)


def limit_site_queries(queries: DataFrame, authority: DataFrame) -> DataFrame:
    """(round, pos, query, searched): one query of a round keeps its site: scope, and those of authorities do; the others
    lose the operator; of equal ones the first stays."""
    site = F.regexp_replace(F.lower(F.regexp_extract("query", r"(?i)\bsite:(\S+)", 1)), r"^www\.", "")
    made = queries.withColumn("site", site).join(authority.select(F.col("site").alias("known")).distinct(), F.col("site") == F.col("known"), "left")
    scoped = (F.col("site") != "") & F.col("known").isNull()
    earlier = F.count_if(scoped).over(W.partitionBy("round").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    open_ = F.trim(F.regexp_replace(F.regexp_replace("query", r"(?i)\bsite:\S+", " "), r"\s+", " "))
    made = made.withColumn("searched", F.when(scoped & (earlier > 0) & (open_ != ""), open_).otherwise(F.col("query")))
    first = F.row_number().over(W.partitionBy("round", F.lower("searched")).orderBy("pos"))
    return made.withColumn("_k", first).where("_k = 1").select("round", "pos", "query", "searched")


def typed_url(raw: Column) -> Column:
    """What someone types for a site as a URL: a host gains https, ``owner/name`` is a repository; empty if nothing is left."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    short = t.rlike(r"^[\w.-]+/[\w.-]+/?$") & ~F.substring_index(t, "/", 1).contains(".")
    full = F.when(t.rlike("(?i)^https?://"), t).when(short, F.concat(F.lit("https://github.com/"), F.btrim(t, F.lit("/")))).otherwise(F.concat(F.lit("https://"), F.ltrim(t, F.lit("/"))))
    head = F.lower(F.regexp_extract(full, r"(?i)^(https?://[^/?#]*)", 1))
    rest = F.regexp_extract(full, r"(?i)^https?://[^/?#]*([^#]*)", 1)
    return F.when((t == "") | head.rlike("^https?://$"), F.lit("")).otherwise(F.concat(head, rest))


def release_feed(url: Column) -> Column:
    """The releases feed of a repository's page, else null."""
    p = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)"
    return F.when(url.rlike(p), F.concat(F.lit("https://github.com/"), F.regexp_extract(url, p, 1), F.lit("/"), F.regexp_replace(F.regexp_extract(url, p, 2), r"\.git$", ""), F.lit("/releases.atom")))


def declared_feeds(html: Column) -> Column:
    """Distinct targets of a page's <link rel=alternate> of a feed's type, as they stand, whatever the attributes' order."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    attr = lambda x, a: F.regexp_extract(x, rf"(?i)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    hit = F.filter(links, lambda x: F.array_contains(F.split(F.lower(attr(x, "rel")), r"\s+"), "alternate") & F.lower(attr(x, "type")).isin(*FEED_TYPES))
    return F.array_distinct(F.filter(F.transform(hit, lambda x: F.trim(attr(x, "href"))), lambda h: h != ""))


def _docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "lang", "text")


def _known() -> Column:
    return F.array(*[F.lit(x) for x in ("the", "that", "acme")])


_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_T = "list_filter(regexp_split_to_array(trim(Q), '\\s+'), lambda t: t <> '')"
_RAW = "case doc_id % 6 when 0 then 'owner' || doc_id || '/name.x/' when 1 then 'Example.COM/Path?x=1#f' when 2 then ' HTTPS://A.b/c ' when 3 then '' when 4 then '//h.org' else 'http://' end"
_GIT = "case doc_id % 4 when 0 then 'https://www.github.com/o' || doc_id || '/r.git' when 1 then 'https://github.com/only' when 2 then 'https://gitlab.com/a/b' else 'http://github.com/a/b/tree?x' end"
_SCOPE = "case doc_id % 7 when 0 then 'code' when 1 then 'Video+web' when 2 then '' when 3 then 'junk' when 4 then 'news, video' when 5 then 'files/web' else 'academic' end"
_ALLOW = "case doc_id % 5 when 0 then 'general, science' when 1 then 'general,videos,news' when 2 then 'it' when 3 then '' else 'videos' end"
_LINKS = "'<head><link rel=\"Alternate home\" type=\"application/rss+xml\" href=\"/f' || page_id || '\"><link href=''/g'' type=''application/atom+xml'' rel=''alternate''><link rel=\"stylesheet\" href=\"/s\"><link rel=alternate type=\"text/css\" href=\"/t\"><link rel=\"alternate\" type=\"application/rss+xml\" href=\"/f' || page_id || '\"></head>' || html"
QUERIES = {
    "short_queries": (
        lambda s, d: _docs(s, d).select("doc_id", shorten_query(F.concat(F.lit("How do the site:x.org "), F.col("text"))).alias("short"), shorten_query(F.lit("what is the")).alias("none")),
        f"""with p as (select doc_id, list_filter({_T.replace('Q', "('How do the site:x.org ' || text)")}, lambda t: not starts_with(lower(t), 'site:')) as p from documents),
        c as (select doc_id, p, list_filter(p, lambda t: not list_contains({_LIST(QUERY_STOPWORDS)}, trim(lower(t), '?.,!:;"''()'))) as c from p)
        select doc_id, array_to_string((case when len(c) > 0 then c else p end)[1:4], ' ') as short, 'what is the' as none from c""",
    ),
    "general_queries": (
        lambda s, d: _docs(s, d).select("doc_id", generalize_query(F.col("text"), _known()).alias("general"), generalize_query(F.lit("The ACME That"), _known()).alias("all_known"), generalize_query(F.lit("one Name only"), _known()).alias("one")),
        f"""with t as (select doc_id, {_T.replace('Q', 'text')} as t from documents),
        r as (select doc_id, t, list_transform(range(1, len(t) + 1), lambda i: {{'t': t[i], 'i': i, 'c': trim(t[i], '"''()[],.:;')}}) as r from t),
        n as (select doc_id, t, list_transform(r, lambda x: {{'t': x.t, 'i': x.i, 'name': length(x.c) >= 2 and regexp_matches(x.c, '[A-Za-z]') and (x.c = upper(x.c) or regexp_matches(x.c, '^[A-Z].*[a-z]')), 'known': lower(x.c) in ('the', 'that', 'acme')}}) as r from r),
        k as (select doc_id, t, r, len(list_filter(r, lambda x: x.name)) as names, len(list_filter(r, lambda x: x.name and not x.known)) > 0 as strange, list_min(list_transform(list_filter(r, lambda x: x.name), lambda x: x.i)) as f from n),
        z as (select doc_id, t, names, list_filter(r, lambda x: not (x.name and case when strange then not x.known else x.i <> f end)) as z from k)
        select doc_id, case when names < 2 or len(z) < 2 or len(z) = len(t) then '' else array_to_string(list_transform(z, lambda x: x.t), ' ') end as general, '' as all_known, '' as one from z""",
    ),
    "facet_queries": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(top_up_queries(F.concat(F.lit("The Price_of "), F.substring("text", 1, 80)), F.col("lang"), F.col("doc_id") % 2 == 0), "|").alias("queries")),
        f"""with n as (select doc_id, lang, trim(regexp_replace(replace(lower('The Price_of ' || substr(text, 1, 80)), '_', ' '), '\\s+', ' ', 'g')) as n from documents),
        w as (select doc_id, lang, array_to_string(list_filter(regexp_extract_all(n, '[A-Za-z0-9]+'), lambda w: not list_contains({_LIST(FILLER)}, w)), ' ') as w from n),
        q as (select doc_id, trim(substr(trim(w), 1, 120)) as p, trim(substr(trim(lang || ' ' || w), 1, 120)) as a from w)
        select doc_id, case when p = a then p when doc_id % 2 = 0 then p || '|' || a else a || '|' || p end as queries from q""",
    ),
    "scope_categories": (
        lambda s, d: _docs(s, d).select("doc_id", categories_for_scope(F.expr(_SCOPE), F.expr(_ALLOW)).alias("categories")),
        f"""with x as (select doc_id, list_transform(list_filter(string_split_regex(lower(trim({_SCOPE})), '[+,/ ]+'), lambda t: t in ('web', 'video', 'code', 'news', 'files', 'academic')),
          lambda t: case t when 'web' then 'general' when 'video' then 'videos' when 'code' then 'it' when 'academic' then 'science' else t end) as w, list_filter(list_transform(string_split({_ALLOW}, ','), lambda c: trim(c)), lambda c: c <> '') as ok from documents),
        k as (select doc_id, ok, list_filter(w, lambda c: len(ok) = 0 or list_contains(ok, c)) as k from x)
        select doc_id, case when len(k) > 0 then array_to_string(list_filter(k, lambda c, i: list_position(k, c) = i), ',') when list_contains(ok, 'general') then case when list_contains(ok, 'videos') then 'general,videos' else 'general' end end as categories from k""",
    ),
    "site_queries": (
        lambda s, d: limit_site_queries(
            _docs(s, d).select(F.floor(F.col("doc_id") / 6).alias("round"), F.col("doc_id").alias("pos"), F.expr("case doc_id % 3 when 0 then 'tents site:WWW.a.org' when 1 then concat('canvas site:b', doc_id % 2, '.org') else 'Tents' end").alias("query")),
            s.createDataFrame([("b1.org",)], "site string"),
        ),
        """with q as (select doc_id // 6 as round, doc_id as pos, case doc_id % 3 when 0 then 'tents site:WWW.a.org' when 1 then 'canvas site:b' || (doc_id % 2) || '.org' else 'Tents' end as query from documents),
        s as (select *, contains(query, 'site:') and not contains(query, 'b1.org') as scoped from q), e as (select *, count(*) filter (scoped) over (partition by round order by pos rows between unbounded preceding and 1 preceding) as e from s),
        n as (select round, pos, query, case when scoped and e > 0 then trim(regexp_replace(query, 'site:\\S+', '')) else query end as searched from e) select * from n qualify row_number() over (partition by round, lower(searched) order by pos) = 1""",
    ),
    "typed_urls": (
        lambda s, d: _docs(s, d).select("doc_id", typed_url(F.expr(_RAW.replace("'owner' || doc_id || '/name.x/'", "concat('owner', doc_id, '/name.x/')"))).alias("url"), release_feed(F.expr(_GIT.replace("'https://www.github.com/o' || doc_id || '/r.git'", "concat('https://www.github.com/o', doc_id, '/r.git')"))).alias("feed")),
        """select doc_id, case doc_id % 6 when 0 then 'https://github.com/owner' || doc_id || '/name.x' when 1 then 'https://example.com/Path?x=1' when 2 then 'https://a.b/c' when 3 then '' when 4 then 'https://h.org' else '' end as url,
        case doc_id % 4 when 0 then 'https://github.com/o' || doc_id || '/r/releases.atom' when 3 then 'https://github.com/a/b/releases.atom' end as feed from documents""",
    ),
    "declared_feeds": (
        lambda s, d: views.table(s, d, "pages").select("page_id", F.array_join(declared_feeds(F.expr(_LINKS.replace("''/g''", "\\'/g\\'").replace("''application/atom+xml''", "\\'application/atom+xml\\'").replace("''alternate''", "\\'alternate\\'"))), " ").alias("feeds")),
        f"""with l as (select page_id, list_filter(regexp_extract_all({_LINKS}, '(?i)<link\\b[^>]*>'), lambda x: list_contains(string_split(lower(regexp_extract(x, '(?i)rel=["'']([^"'']*)', 1)), ' '), 'alternate') and regexp_matches(x, 'application/(rss|atom)[+]xml')) as l from pages),
        h as (select page_id, list_transform(l, lambda x: regexp_extract(x, 'href=["'']([^"'']*)', 1)) as h from l) select page_id, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ' ') as feeds from h""",
    ),
}
