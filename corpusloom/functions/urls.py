"""URLs as Column expressions: canonical form, host, source, and what can be read at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views

# Fixed values.
TRACKING_KEYS = (
    "fbclid", "gclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "cmpid", "msockid", "ascsubtag", "spm_id_from", "trackid", "srsltid",
    "yclid", "gbraid", "wbraid", "mkt_tok", "igsh", "_ga",
)
UNREADABLE_HOSTS = (
    "facebook.com", "instagram.com", "tiktok.com", "threads.net", "x.com", "twitter.com", "linkedin.com", "dailymotion.com", "vimeo.com", "twitch.tv",
    "rumble.com", "bitchute.com", "odysee.com", "sepiasearch.org", "bilibili.com", "msn.com", "scribd.com", "tumblr.com", "linkresolver.bsigroup.com",
)
DEFAULT_BLOCKED = (
    "dictionary.com", "thesaurus.com", "merriam-webster.com", "thefreedictionary.com", "dictionary.cambridge.org", "vocabulary.com", "wordnik.com",
    "definitions.net", "pinterest.com", "quora.com", "amazon.com", "ebay.com", "walmart.com", "homedepot.com", "lowes.com", "basspro.com", "cabelas.com",
    "capitalone.com", "aliexpress.com", "etsy.com", "bestbuy.com", "target.com", "acehardware.com", "shop.app",
)
VIDEO_HOSTS = ("youtube.com", "youtu.be", "youtube-nocookie.com", "music.youtube.com")
REPO_HOSTS = ("github.com", "gitlab.com", "codeberg.org", "bitbucket.org")
INDEX_PATH = r"(?i)^/(?:forums?|blogs?|news|downloads?|community|threads|home|index\.(?:php|html?))?$"
DATED_PATH = r"(?i)/(?:issues|pull|pulls|discussions|commit|commits|compare|blog|papers|posts)(?:/|$)"
PEERTUBE_PATH = r"(?i)^/(?:videos/watch|w)/[0-9a-f]{8}-[0-9a-f-]{20,}"

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def fold_host(host: Column) -> Column:
    """www. and mobile hosts serve the page of the plain host."""
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")
    at = F.instr(host, ".m.")
    return F.when(at > 0, F.concat(F.substring(host, F.lit(1), at - 1), F.lit("."), F.substring(host, at + 3, F.length(host)))).otherwise(host)


def domain_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", "")
    return fold_host(F.regexp_extract(host, r"^([^:]*)", 1))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return _part(url, 4)


def _quoted(text: Column) -> Column:
    """Decodes and encodes again as form values are: space becomes +, and only letters, digits and _.-~ stay."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize(url: Column) -> Column:
    scheme = F.lower(F.when(_part(url, 1) == "", F.lit("https")).otherwise(_part(url, 1)))
    host = fold_host(F.regexp_replace(F.lower(_part(url, 2)), r":(?:80|443)$", ""))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, r"/+$", "")).otherwise(path)
    name = lambda kv: F.lower(F.substring_index(kv, "=", 1))
    used = F.filter(
        F.split(query_of(url), "&"),
        lambda kv: (kv != "") & ~name(kv).startswith("utm_") & ~name(kv).isin(*TRACKING_KEYS) & ~((name(kv) == "tag") & host.contains("amazon.")),
    )
    pair = lambda kv: F.concat(_quoted(F.substring_index(kv, "=", 1)), F.lit("="), _quoted(F.when(F.instr(kv, "=") > 0, F.regexp_replace(kv, r"^[^=]*=", "")).otherwise(F.lit(""))))
    query = F.array_join(F.transform(used, pair), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def under(host: Column, domains) -> Column:
    """``host`` is one of ``domains`` or below one."""
    out = host.isin(*domains)
    for d in domains:
        out = out | host.endswith(f".{d}")
    return out


def is_unreadable(url: Column) -> Column:
    host, path = domain_of(url), path_of(url)
    return under(host, UNREADABLE_HOSTS) | (under(host, ("reddit.com",)) & ~path.contains("/comments/")) | path.rlike(PEERTUBE_PATH)


def is_blocked(url: Column, blocked=DEFAULT_BLOCKED) -> Column:
    return under(domain_of(url), blocked)


def looks_like_index(url: Column) -> Column:
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return (query_of(url) == "") & F.when(path == "", F.lit("/")).otherwise(path).rlike(INDEX_PATH)


def is_living_page(url: Column) -> Column:
    """A project page whose date says when the project began."""
    host, segs = domain_of(url), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    deep = F.size(segs) - F.when(host.endswith("huggingface.co") & F.get(segs, F.lit(0)).isin("datasets", "spaces"), 1).otherwise(0)
    return under(host, (*REPO_HOSTS, "huggingface.co")) & ~path_of(url).rlike(DATED_PATH) & (deep >= 2)


def source_key(url: Column, author: Column | None = None) -> Column:
    """What counts as one source: a channel, a repository, a forum, an account, else the host."""
    who = F.coalesce(F.lower(F.trim(author)), F.lit("")) if author is not None else F.lit("")

    def of(canon: Column, host: Column, segs: Column) -> Column:
        seg = lambda k: F.lower(F.get(segs, F.lit(k)))
        return (
            F.when(under(host, VIDEO_HOSTS), F.concat(F.lit("youtube:"), F.when(who != "", who).otherwise(canon)))
            .when(under(host, REPO_HOSTS) & (F.size(segs) >= 2), F.concat(host, F.lit(":"), seg(0), F.lit("/"), seg(1)))
            .when(host.endswith("reddit.com") & (F.size(segs) >= 2) & (F.get(segs, F.lit(0)) == "r"), F.concat(F.lit("reddit:r/"), seg(1)))
            .when((host == "medium.com") & (F.size(segs) >= 1), F.concat(F.lit("medium:"), seg(0)))
            .otherwise(host)
        )

    # Bound step by step, so that the long expression of the canonical form stands in the plan once.
    bind = lambda value, body: F.transform(F.array(value), body)[0]
    parts = lambda canon: F.filter(F.split(path_of(canon), "/"), lambda s: s != "")
    return bind(canonicalize(url), lambda c: bind(domain_of(c), lambda h: bind(parts(c), lambda p: of(c, h, p))))


def suffixes(host: Column) -> Column:
    """Every host above and including ``host``: for equi-joins with lists of domains of any size."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def without_domains(pages: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` whose host is not under any row of ``domains`` (domain): each host is looked up once, by its suffixes."""
    marked = pages.withColumn("_host", domain_of(F.col(url)))
    hosts = marked.select("_host").where("_host is not null").distinct()
    hit = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("domain")).join(domains, "domain", "left_semi").select("_host").distinct()
    return marked.join(hit, "_host", "left_anti").drop("_host")


def unseen(pages: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` whose canonical URL is not among those of ``seen``."""
    return pages.withColumn("_c", canonicalize(F.col(url))).join(seen.select(canonicalize(F.col(url)).alias("_c")).distinct(), "_c", "left_anti").drop("_c")


def outbound_links(pages: DataFrame, html: str = "html", limit: int = 150) -> DataFrame:
    """Absolute http(s) links of each page in order, at most ``limit``."""
    found = F.filter(F.regexp_extract_all(F.col(html), F.lit(r'<a href="([^"]*)"'), F.lit(1)), lambda u: u.rlike("^https?://"))
    return pages.select("page_id", F.posexplode(F.slice(found, 1, limit)).alias("pos", "link"))


def _p(**made):
    return lambda spark, d: views.table(spark, d, "pages").select("page_id", *[fn(F.col("url")).alias(name) for name, fn in made.items()])


_SQL = r"""
with u as (
  select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)) as net,
    regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) as query from pages
), h as (
  select *, regexp_replace(regexp_replace(regexp_replace(net, ':(80|443)$', ''), '^www[.]', ''), '^m[.]', '') as h0 from u
), c as (
  select *, replace(case when strpos(h0, '.m.') > 0 then substr(h0, 1, strpos(h0, '.m.') - 1) || '.' || substr(h0, strpos(h0, '.m.') + 3) else h0 end, chr(0), '') as host,
    case when path = '' then '/' when path <> '/' and ends_with(path, '/') then regexp_replace(path, '/+$', '') else path end as cpath,
    list_filter(string_split(query, '&'), lambda kv: kv <> '' and not starts_with(lower(string_split(kv, '=')[1]), 'utm_') and not list_contains([KEYS], lower(string_split(kv, '=')[1]))) as kv from h
), f as (
  select page_id, url, scheme, path, query, host, cpath, scheme || '://' || host || cpath || case when len(kv) > 0 then '?' || array_to_string(list_transform(kv, lambda x: case when strpos(x, '=') > 0 then x else x || '=' end), '&') else '' end as canonical from c
)""".replace("KEYS", ", ".join(f"'{k}'" for k in TRACKING_KEYS))
_IDX = INDEX_PATH.replace("(?i)", "")
QUERIES = {
    "canonical_urls": (_p(canonical=canonicalize), _SQL + " select page_id, canonical from f"),
    "url_domains": (_p(domain=domain_of), _SQL + " select page_id, host as domain from f"),
    "source_keys": (_p(source_key=source_key), _SQL + " select page_id, host as source_key from f"),
    "unreadable_urls": (
        _p(unreadable=is_unreadable, blocked=is_blocked, living=is_living_page),
        _SQL
        + " select page_id, len(list_filter([LIST], lambda d: host = d or ends_with(host, '.' || d))) > 0 as unreadable, len(list_filter([BLOCK], lambda d: host = d or ends_with(host, '.' || d))) > 0 as blocked, false as living from f".replace(
            "LIST", ", ".join(f"'{k}'" for k in UNREADABLE_HOSTS)
        ).replace("BLOCK", ", ".join(f"'{k}'" for k in DEFAULT_BLOCKED)),
    ),
    "index_pages": (
        _p(is_index=looks_like_index),
        _SQL + f" select page_id, query = '' and regexp_matches(case when regexp_replace(path, '/+$', '') = '' then '/' else regexp_replace(path, '/+$', '') end, '(?i){_IDX}') as is_index from f",
    ),
    "blocked_domains_antijoin": (
        lambda s, d: without_domains(views.table(s, d, "pages").select("page_id", "url"), s.createDataFrame([("example.net",), ("example.org",)], "domain string")).select("page_id"),
        _SQL + " select page_id from f where not (ends_with('.' || host, '.example.net') or ends_with('.' || host, '.example.org'))",
    ),
    "seen_url_antijoin": (
        lambda s, d: unseen(views.table(s, d, "pages").select("page_id", "url"), views.table(s, d, "pages").where("page_id % 3 = 0").select("url")).select("page_id"),
        _SQL + " select page_id from f where canonical not in (select canonical from f where page_id % 3 = 0)",
    ),
    "page_links": (
        lambda s, d: outbound_links(views.table(s, d, "pages").select("page_id", F.regexp_replace("html", 'href="/', 'href="https://site.example/').alias("html"))),
        """select page_id, cast(unnest(range(0, len(l))) as int) as pos, unnest(l) as link from (
          select page_id, list_filter(regexp_extract_all(replace(html, 'href="/', 'href="https://site.example/'), '<a href="([^"]*)"', 1), lambda u: regexp_matches(u, '^https?://'))[1:150] as l from pages)""",
    ),
    "url_site_scope": (
        _p(in_site=lambda u: under(domain_of(u), ("example.com", "example.org")), labels=lambda u: F.size(suffixes(domain_of(u)))),
        _SQL + " select page_id, ends_with('.' || host, '.example.com') or ends_with('.' || host, '.example.org') as in_site, cast(len(string_split(host, '.')) as int) as labels from f",
    ),
}
