"""Citations and figures in written reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views

# Fixed value: what a citation group looks like.
GROUP = r"\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\]"


def citation_ids(text: Column) -> Column:
    """Numbers of all groups such as [3] or [1, 2; 5], in order."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GROUP), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,;]\s*"), lambda x: F.trim(x).cast("int"))))


def cited_ids(text: Column) -> Column:
    """Distinct citations of the body, which ends at the heading of unused sources."""
    return F.array_distinct(citation_ids(F.substring_index(text, "\n## Researched but not used", 1)))


def validate_citations(text: Column, n: Column) -> Column:
    """struct(text, removed): citations outside 1 to n go, and groups without any left go whole.

    Groups are the pieces between splits, so each is rewritten without a function call out of the JVM.
    """
    groups = F.regexp_extract_all(text, F.lit(GROUP), F.lit(0))
    ids = lambda g: F.transform(F.split(F.regexp_replace(g, r"[\[\]]", ""), r"\s*[,;]\s*"), lambda x: F.trim(x).cast("int"))
    good = lambda g: F.filter(ids(g), lambda k: k.between(F.lit(1), n))
    new = lambda g: F.when(F.size(good(g)) == F.size(ids(g)), g).when(F.size(good(g)) > 0, F.concat(F.lit("["), F.array_join(F.transform(good(g), lambda k: k.cast("string")), ", "), F.lit("]"))).otherwise(F.lit(""))
    joined = F.array_join(F.transform(F.arrays_zip(F.split(text, GROUP, -1).alias("t"), groups.alias("g")), lambda x: F.concat(x["t"], F.when(x["g"].isNull(), F.lit("")).otherwise(new(x["g"])))), "")
    removed = F.array_sort(F.array_distinct(F.filter(citation_ids(text), lambda k: ~k.between(F.lit(1), n))))
    return F.struct(joined.alias("text"), removed.alias("removed"))


def figures(text: Column) -> Column:
    """Distinct numbers without thousands marks and trailing zeros; bare digits and years 1900-2099 are no figures."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), GROUP, " "), F.lit(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
    real = F.filter(plain, lambda x: x.contains(".") | ((F.length(x) > 1) & ~x.rlike("^(19|20)[0-9][0-9]$")))
    return F.array_distinct(F.transform(real, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)))


def uncited(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Sources (report, n) that no citation of their report names."""
    named = reports.select("report", F.explode(cited_ids(F.col("text"))).alias("n"))
    return sources.join(named, ["report", "n"], "left_anti")


def unmatched_figures(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """(report, figure) of cited sentences whose figure no cited source states."""
    asked = sentences.select("report", F.explode(F.array_distinct(citation_ids(F.col("text")))).alias("n"), figures(F.col("text")).alias("f"))
    asked = asked.select("report", "n", F.explode("f").alias("figure"))
    known = sources.select("report", "n", F.explode(figures(F.col("text"))).alias("figure"), F.lit(True).alias("hit"))
    return asked.join(known, ["report", "n", "figure"], "left").groupBy("report", "figure").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("matched"))


def _reports(spark, d):
    """Reports with citations: documents, a group after each, numbered by what they hold."""
    x = views.table(spark, d, "documents")
    mark = F.concat(F.lit(" ["), F.col("doc_id") % 9, F.lit(", "), F.col("doc_id") % 4 + 1, F.lit("] and ["), F.col("doc_id") % 13, F.lit("]"))
    return x.select(F.col("doc_id").alias("report"), F.concat(F.col("text"), mark).alias("text"))


def _sources(spark, d):
    x = views.table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("report"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))


_REP = "r as (select doc_id as report, text || ' [' || (doc_id % 9) || ', ' || (doc_id % 4 + 1) || '] and [' || (doc_id % 13) || ']' as text from documents)"
_IDS = r"list_transform(flatten(list_transform(regexp_extract_all(text, '\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\]', 1), lambda g: string_split_regex(g, '\s*[,;]\s*'))), lambda x: cast(x as int))"
_FIG = r"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\]', ' ', 'g'), '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda x: replace(x, ',', '')), lambda x: contains(x, '.') or (length(x) > 1 and not regexp_full_match(x, '(19|20)[0-9][0-9]'))), lambda x: case when contains(x, '.') then rtrim(rtrim(x, '0'), '.') else x end))"
QUERIES = {
    "citation_ids": (lambda s, d: _reports(s, d).select("report", F.size(citation_ids(F.col("text"))).alias("n"), F.array_join(F.array_sort(cited_ids(F.col("text"))).cast("array<string>"), ",").alias("ids")), f"with {_REP} select report, cast(len(i) as int) as n, array_to_string(list_sort(list_distinct(i)), ',') as ids from (select report, {_IDS} as i from r)"),
    "uncited_sources": (lambda s, d: uncited(_sources(s, d), _reports(s, d)), f"with {_REP}, i as (select report, {_IDS} as i from r) select report, cast(n as int) as n from i, range(1, 6) x(n) where not list_contains(i, n)"),
    "cited_stats": (
        lambda s, d: _reports(s, d).select("report", F.array_distinct(citation_ids(F.col("text"))).alias("i")).select((F.col("report") % 10).alias("bucket"), F.size(F.filter("i", lambda k: k.between(1, 5))).alias("c")).groupBy("bucket").agg(F.sum("c").alias("cited"), F.sum(5 - F.col("c")).alias("uncited")),
        f"with {_REP}, i as (select report % 10 as bucket, len(list_filter(list_distinct({_IDS}), lambda k: k between 1 and 5)) as c from r) select bucket, cast(sum(c) as bigint) as cited, cast(sum(5 - c) as bigint) as uncited from i group by bucket",
    ),
    "validate_citations": (lambda s, d: _reports(s, d).select("report", validate_citations(F.col("text"), F.lit(5)).alias("v")).select("report", F.length("v.text").alias("chars"), F.array_join(F.col("v.removed").cast("array<string>"), ",").alias("removed")), None),
    "figure_tokens_core": (lambda s, d: _reports(s, d).select("report", F.array_join(F.array_sort(figures(F.col("text"))), " ").alias("figures")), f"with {_REP} select report, array_to_string(list_sort({_FIG}), ' ') as figures from r"),
    "figure_unmatched": (
        lambda s, d: unmatched_figures(_reports(s, d), _sources(s, d).join(views.table(s, d, "documents").select(F.col("doc_id").alias("report"), "text"), "report").where("n % 2 = 0")),
        f"""with {_REP}, a as (select report, unnest(f) as figure, i from (select report, {_FIG} as f, list_distinct({_IDS}) as i from r)),
        k as (select report, unnest({_FIG}) as figure from (select doc_id as report, text from documents))
        select a.report, a.figure, len(list_filter(a.i, lambda n: n in (2, 4))) > 0 and k.figure is not null as matched from a left join k on a.report = k.report and a.figure = k.figure""",
    ),
}
