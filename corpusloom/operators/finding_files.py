"""Findings as Markdown files: a renderer, its inverse, and a folder of them as sink and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views

FACT = "struct<claim:string,confidence:int,quote:string>"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def render_facts(facts: Column, limit: int | None = None, by_confidence: bool = False, quotes: bool = True) -> Column:
    """Bullets of facts (claim, confidence, quote), the surest first if asked; facts without a claim are left out."""
    if by_confidence:
        by = F.transform(facts, lambda f, i: F.struct((-F.coalesce(f["confidence"], F.lit(0))).alias("k"), i.alias("i"), f.alias("f")))
        facts = F.transform(F.array_sort(by), lambda x: x["f"])
    if limit is not None:
        facts = F.slice(facts, 1, limit)

    def line(f: Column) -> Column:
        sure = F.when(f["confidence"].isNotNull(), F.concat(F.lit(" (confidence "), f["confidence"], F.lit("/10)"))).otherwise("")
        quote = F.trim(_or_empty(f["quote"]))
        said = F.when((quote != "") & F.lit(quotes), F.concat(F.lit('\n  > "'), quote, F.lit('"'))).otherwise("")
        return F.concat(F.lit("- "), F.trim(f["claim"]), sure, said)

    return _or_empty(F.array_join(F.transform(F.filter(facts, lambda f: F.trim(_or_empty(f["claim"])) != ""), line), "\n"))


def finding_markdown() -> Column:
    """A finding's file, from the columns idx, title, url, domain, published, relevance, source_type, publisher, query,
    summary, notes and facts; nulls are empty, or the word that stands for them."""
    c = lambda name: _or_empty(F.col(name).cast("string"))
    named = lambda name, other: F.when(c(name) == "", other).otherwise(c(name))
    facts = render_facts(F.col("facts"))
    kind = F.concat(named("source_type", "unclassified"), F.when(c("publisher") == "", "").otherwise(F.concat(F.lit(" — "), c("publisher"))))
    fields = [("URL", c("url")), ("Domain", c("domain")), ("Published", named("published", "unknown")), ("Relevance", F.concat(c("relevance"), F.lit("/10"))), ("Source type", kind), ("Found via", c("query"))]
    header = F.concat_ws("\n", *[F.concat(F.lit(f"- **{k}:** "), v) for k, v in fields])
    return F.concat(
        F.lit("# ["), c("idx"), F.lit("] "), c("title"), F.lit("\n\n"), header, F.lit("\n\n**Summary:** "), c("summary"),
        F.lit("\n\n## Notes\n\n"), c("notes"), F.lit("\n\n## Key facts\n\n"), F.when(facts == "", "_none extracted_").otherwise(facts), F.lit("\n"),
    )


def field(text: Column, label: str) -> Column:
    """The value of a header line; empty without the line or a value."""
    return F.trim(_or_empty(F.regexp_extract(text, rf"(?m)^- \*\*{label}:\*\*[ \t]*(.*)$", 1)))


def section(text: Column, heading: str) -> Column:
    """What stands below a heading, up to the next of its level."""
    return F.trim(_or_empty(F.regexp_extract(text, rf"(?ms)^## {heading}[ \t]*$\n?(.*?)(?=^## |\z)", 1)), F.lit(" \t\n"))


def parse_facts(text: Column) -> Column:
    """The bullets of a file's facts; a quoted line belongs to the bullet above it."""
    lines = F.transform(F.split(section(text, "Key facts"), "\n"), lambda x: F.trim(x))
    sure = r"\s*\(confidence ([0-9]+)/10\)$"

    def take(done: Column, x: Column) -> Column:
        said = F.regexp_extract(x, '^> "(.*?)"*$', 1)
        last = F.element_at(done, -1)
        fact = F.struct(F.trim(F.regexp_replace(F.substring(x, 3, 1 << 30), sure, "")).alias("claim"), F.nullif(F.regexp_extract(x, sure, 1), F.lit("")).cast("int").alias("confidence"), F.lit("").alias("quote"))
        quoted = F.struct(last["claim"].alias("claim"), last["confidence"].alias("confidence"), F.trim(said).alias("quote"))
        return (
            F.when(x.startswith("- "), F.concat(done, F.array(fact)))
            .when(x.startswith('> "') & (F.size(done) > 0), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(quoted)))
            .otherwise(done)
        )

    return F.aggregate(lines, F.array().cast(f"array<{FACT}>"), take)


def parsed(files: DataFrame, text: str = "text") -> DataFrame:
    """Files' columns and idx, title, url, domain, published, relevance, source_type, publisher, query, summary, notes and
    facts. A file without a numbered heading is no finding and has no row; an unknown date is null, junk relevance 0."""
    t = F.col(text)
    head = lambda k: F.regexp_extract(t, r"(?m)^# \[([0-9]+)\][ \t]+(.*)$", k)
    kind = F.split(field(t, "Source type"), " — ", 2)
    made = {
        "idx": head(1).try_cast("int"),
        "title": F.trim(head(2)),
        "url": field(t, "URL"),
        "domain": field(t, "Domain"),
        "published": F.when(~field(t, "Published").isin("", "unknown"), field(t, "Published")),
        "relevance": F.coalesce(F.regexp_replace(field(t, "Relevance"), "/10.*$", "").try_cast("double"), F.lit(0.0)),
        "source_type": F.when(kind[0] != "unclassified", kind[0]),
        "publisher": F.get(kind, F.lit(1)),
        "query": field(t, "Found via"),
        "summary": F.trim(F.regexp_extract(t, r"(?m)^\*\*Summary:\*\*[ \t]*(.*)$", 1)),
        "notes": section(t, "Notes"),
        "facts": parse_facts(t),
    }
    return files.where(head(1) != "").withColumns(made)


def write_files(findings: DataFrame, path: str) -> None:
    """A folder per run and finding with one Markdown file in it; whole folders of the runs written are replaced."""
    out = findings.select("run_id", F.col("idx").alias("finding"), finding_markdown().alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "finding").option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a folder that ``write_files`` made, with their run_id; a run is a partition, so a filter on it prunes."""
    return parsed(spark.read.text(path, wholetext=True).select("run_id", F.col("value").alias("text"))).drop("text")


def _findings(spark, d):
    """Documents as findings with every kind of missing value."""
    k = F.col("doc_id")
    fact = lambda c, n, q: F.struct(c.alias("claim"), n.cast("int").alias("confidence"), q.alias("quote"))
    line = F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 80))
    facts = F.array(fact(F.concat(F.lit("c"), k), k % 11, F.concat(F.lit("said "), k)), fact(F.concat(F.lit("d"), k), F.when(k % 2 == 0, k % 7), F.lit("")), fact(F.lit(" "), F.lit(3), F.lit("x")))
    return views.table(spark, d, "documents").select(
        k.alias("run_id"), (k % 40 + 1).cast("int").alias("idx"), F.concat(F.lit("T"), k).alias("title"), F.concat(F.lit("https://a.org/"), k).alias("url"), F.col("source").alias("domain"),
        F.when(k % 3 > 0, F.concat(F.lit("2024-01-1"), k % 10)).alias("published"), (k % 11).cast("double").alias("relevance"), F.when(k % 4 > 0, F.lit("standard")).alias("source_type"),
        F.when(k % 5 == 0, F.lit("Maker")).alias("publisher"), F.col("lang").alias("query"), line.alias("summary"), F.concat(F.lit("n"), k, F.lit("\n- b")).alias("notes"), F.when(k % 6 > 0, facts).alias("facts"),
    )


def _round_trip(spark, d):
    made = parsed(_findings(spark, d).select("run_id", finding_markdown().alias("text")))
    said = F.array_join(F.transform("facts", lambda f: F.concat_ws("|", f["claim"], F.coalesce(f["confidence"].cast("string"), F.lit("-")), f["quote"])), ";")
    return made.select("run_id", "idx", "title", "url", "domain", "published", "relevance", "source_type", "publisher", "query", F.md5("summary").alias("summary"), "notes", said.alias("facts"))


_ORIGIN = r"""select doc_id as run_id, cast(doc_id % 40 + 1 as int) as idx, 'T' || doc_id as title, 'https://a.org/' || doc_id as url, source as domain, case when doc_id % 3 > 0 then '2024-01-1' || (doc_id % 10) end as published,
  cast(doc_id % 11 as double) as relevance, case when doc_id % 4 > 0 then 'standard' end as source_type, case when doc_id % 5 = 0 then 'Maker' end as publisher, lang as query,
  md5(trim(substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 80))) as summary, 'n' || doc_id || chr(10) || '- b' as notes,
  case when doc_id % 6 > 0 then 'c' || doc_id || '|' || (doc_id % 11) || '|said ' || doc_id || ';d' || doc_id || '|' || case when doc_id % 2 = 0 then cast(doc_id % 7 as varchar) else '-' end || '|' else '' end as facts from documents"""
QUERIES = {"finding_files_round_trip": (_round_trip, _ORIGIN)}
