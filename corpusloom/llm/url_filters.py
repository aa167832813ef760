"""Operator 2: URL filters by hashed host-suffix / path-prefix expressions.

Every URL is expanded into (host suffix, path prefix) expressions, only at the label counts and path lengths that the
rules have. The expressions meet the rules in an equi-join on the first four bytes of their SHA-256; the full digest
confirms a match, and the longest rule decides (then the longer host, then block over allow).

Defined results: a null url or one without ``://`` has empty host and path; no rule fits an empty host. Hosts keep
ports and user names as they stand. Repeated rows give repeated results. Without a fitting rule the verdict is
``default_verdict`` and the rule is null. Rules may be of any length. All other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

#: (verdict, host, path) of the contract's rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rules up to this many bytes of digests and strings are broadcast; larger lists are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Distinct lengths of rules' paths that are listed; with more of them, every prefix of a path is looked up.
LENGTHS = 1024


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(host.rlike("[A-Z]"), _ascii_lower(host)).otherwise(host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default_verdict: str = "allow", max_lengths: int = LENGTHS) -> DataFrame:
    """``pages`` plus url_host, url_path, url_rule, url_verdict, n_rules (rules that fit); columns of these names are replaced."""
    pages = without(pages, "url_host", "url_path", "url_rule", "url_verdict", "n_rules")
    u_host, u_path = "_u_host", "_u_path"
    made = rules.select("verdict", "host", "path").where("host is not null and path is not null and verdict is not null")
    made = made.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow': a contradiction blocks
    made = made.select(
        F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"),
            F.length("host").alias("host_n"),
            F.col("verdict"),
            F.concat("host", "path").alias("rule"),
        ).alias("found"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_n"),
    ).withColumn("rule_short", F.substring("rule_digest", 1, 8))
    facts = made.agg(F.max("labels"), F.count(F.lit(1)), F.sum(F.length("found.rule") + 200), F.max("path_n")).first()
    lengths = sorted(r[0] for r in made.select("path_n").distinct().limit(max_lengths + 1).collect())
    labels = facts[0] or 0

    host, path = F.col(u_host), F.col(u_path)
    # Each distinct url is judged once, so a row's other columns are in no expression's row, and a url of many rows is one.
    base = pages.select(F.col(url).alias("url")).distinct().withColumns({u_host: host_of(F.col("url")), u_path: path_of(F.col("url"))})
    tail = F.split(F.substring_index(host, ".", -max(labels, 1)), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    if len(lengths) > max_lengths:
        fits = F.sequence(F.lit(0), F.least(F.length(path), F.lit(facts[3])))
    elif lengths:
        fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    else:
        fits = F.array().cast("array<int>")
    exprs = F.flatten(F.transform(hosts, lambda h: F.transform(fits, lambda n: F.sha2(F.concat_ws("\x00", h, F.substring(path, F.lit(1), n)), 256))))
    asked = base.select("url", F.explode(F.when((host != "") & F.lit(bool(labels)), F.array_distinct(exprs))).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    if (facts[2] or 0) <= BROADCAST_BYTES:
        made = F.broadcast(made)
    met = asked.join(made, F.col("short") == F.col("rule_short")).where(F.col("digest") == F.col("rule_digest"))
    best = met.groupBy("url").agg(F.max("found").alias("best"), F.count(F.lit(1)).alias("n_rules")).alias("judged")
    own = pages.alias("own")
    out = own.join(best, F.col(f"own.`{url}`") == F.col("judged.url"), "left")
    return out.select(
        *[F.col(f"own.`{c}`") for c in pages.columns],
        host_of(F.col(f"own.`{url}`")).alias("url_host"),
        path_of(F.col(f"own.`{url}`")).alias("url_path"),
        F.col("judged.best.rule").alias("url_rule"),
        F.coalesce("judged.best.verdict", F.lit(default_verdict)).alias("url_verdict"),
        F.coalesce("judged.n_rules", F.lit(0)).cast("long").alias("n_rules"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(pages, rules_frame(spark))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


SQL = """
with u as (
  select page_id, coalesce(url, '') as url from pages
), p as (
  select page_id,
    case when contains(url, '://') then
      translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      else '' end as host,
    case when contains(url, '://') then
      regexp_extract(regexp_replace(substr(url, strpos(url, '://') + 3), '^[^/?#]*', ''), '^[^?#]*')
      else '' end as path
  from u
), rules(verdict, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best as (
  select p.page_id, p.host, p.path, r.verdict, r.rhost || r.rpath as rule,
    row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc nulls last, length(r.rhost) desc, r.verdict desc) as k
  from p left join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best where k = 1
"""
