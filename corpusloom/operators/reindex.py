"""The library's tables rebuilt from a research folder: ``<run>/meta.json``, ``<run>/overview.md``, ``<run>/findings/*.md``.

Only what is missing is restored: runs that the table lacks (an anti-join), the findings of those runs, and index entries of
runs that the indexes lack. So a second call writes nothing, and one that was cut short is completed by the next. Files that
are torn, or none of these, are skipped: a run without a readable meta.json is not restored, and a finding without its
numbered heading is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import charsets
from ..sources import views
from .finding_files import _or_empty, field, parse_facts, parsed, section
from .postings import PostingIndex
from .run_index import RunIndex

RUNS = "id string, query string, depth int, recency string, origin string, parent_run_id string, status string, title string, stop_reason string, finished_at string"
FINDINGS = "run_id string, idx int, path string, title string, url string, domain string, published string, relevance double, summary string"
_NAMED = r"([^/]+)/(meta\.json|overview\.md|findings/[^/]+\.md)$"


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, name, text) of a folder's files; bytes that are no UTF-8 are read as what they most likely are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,md}").load(folder)
    part = lambda k: F.regexp_extract("path", _NAMED, k)
    return files.select(part(1).alias("run_id"), part(2).alias("name"), charsets.decoded(F.col("content"), F.lit(None).cast("string")).alias("text")).where("name <> ''")


def runs_of(files: DataFrame) -> DataFrame:
    """Rows of the run table out of the files' meta.json; what it does not say has the table's defaults."""
    meta = files.where("name = 'meta.json'").withColumn("m", F.try_parse_json("text")).where("schema_of_variant(m) like 'OBJECT%'")

    def said(key: str, other: str | None = None, kind: str = "string") -> Column:
        value = F.try_variant_get("m", f"$.{key}", kind)
        return (value if other is None else F.coalesce(value, F.lit(other).cast(kind))).alias(key)

    fields = [said("depth", "1", "int"), said("recency", "all"), said("origin", "web"), said("parent_run_id"), said("status", "completed"), said("title"), said("stop_reason"), said("finished_at")]
    return meta.select(F.col("run_id").alias("id"), F.coalesce(F.try_variant_get("m", "$.query", "string"), F.col("run_id")).alias("query"), *fields)


def findings_of(files: DataFrame) -> DataFrame:
    """Rows of the finding table; of files with one number in a run the first by name counts."""
    made = parsed(files.where("name like 'findings/%'")).where("idx is not null")
    first = made.withColumn("_k", F.row_number().over(W.partitionBy("run_id", "idx").orderBy("name"))).where("_k = 1")
    return first.select("run_id", "idx", F.col("name").alias("path"), "title", "url", "domain", "published", "relevance", "summary")


def missing(files: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) that the files have and ``runs`` (id) lacks."""
    new = runs_of(files).join(runs.select("id").distinct(), "id", "left_anti")
    return new, findings_of(files).join(new.select(F.col("id").alias("run_id")), "run_id", "left_semi")


def stored_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The finding table's rows with what only their files hold: notes, facts, query, source type and publisher.

    A finding whose file is gone has its summary as notes; a file without notes is its own notes.
    """
    t = F.col("text")
    body = findings.join(files.select("run_id", F.col("name").alias("path"), "text"), ["run_id", "path"], "left").withColumn("text", F.coalesce("text", "summary", F.lit("")))
    notes = F.when(section(t, "Notes") == "", t).otherwise(section(t, "Notes"))
    kind = F.split(field(t, "Source type"), " — ", 2)
    source = F.when(kind[0].isin("", "unclassified"), F.lit("")).otherwise(kind[0])
    made = {"notes": notes, "facts": parse_facts(t), "query": field(t, "Found via"), "source_type": source, "publisher": _or_empty(F.get(kind, F.lit(1)))}
    return body.withColumns(made).drop("text")


class Library:
    """Tables ``runs`` and ``findings`` and the two indexes under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.postings, self.vectors = PostingIndex(spark, f"{path}/words"), RunIndex(spark, f"{path}/vectors")

    def _table(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/{name}") if there else empty

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS)

    def findings(self) -> DataFrame:
        return self._table("findings", FINDINGS)

    def reindex(self, folder: str) -> dict[str, int]:
        """Restore from ``folder`` what is missing; how many rows and runs were written.

        A run's row is written after its findings, so that one cut short between them is completed the next time: findings
        that are there already are not written again.
        """
        files = scanned(self.spark, folder)
        runs, findings = missing(files, self.runs())
        done = {"runs": runs.count(), "findings": 0, "indexed": 0}
        if done["runs"]:
            fresh = findings.join(self.findings().select("run_id", "idx"), ["run_id", "idx"], "left_anti").select(*self.findings().columns)
            done["findings"] = fresh.count()
            fresh.write.mode("append").parquet(f"{self.path}/findings")
            runs.write.mode("append").parquet(f"{self.path}/runs")
        # Indexed are runs with a row; words and vectors each know theirs.
        known = self.runs().select(F.col("id").alias("run_id"), F.coalesce("title", "query").alias("run_title"))
        texts = files.where("name <> 'meta.json'").join(self.findings().select("run_id", F.col("path").alias("name"), "idx", "title"), ["run_id", "name"], "left")
        texts = texts.where("name = 'overview.md' or idx is not null").join(known, "run_id").withColumn("title", F.when(F.col("name") == "overview.md", F.col("run_title")).otherwise(F.col("title")))
        for name, schema, write in (("words/docs", "run_id string", self._write_words), ("vectors", "run_id string", self._write_vectors)):
            rows = texts.join(self._table(name, schema).select("run_id").distinct(), "run_id", "left_anti")
            n = rows.select("run_id").distinct().count()
            if n:
                write(rows)
            done["indexed"] = max(done["indexed"], n)
        return done

    def _write_words(self, rows: DataFrame) -> None:
        kind = F.when(F.col("name") == "overview.md", "overview").otherwise("finding")
        self.postings.write(rows.select("run_id", F.coalesce("idx", F.lit(0)).alias("doc"), kind.alias("kind"), "title", F.col("text").alias("body")))

    def _write_vectors(self, rows: DataFrame) -> None:
        self.vectors.index(rows.where("name = 'overview.md'"), rows.where("name <> 'overview.md'"))


def _files(spark, d):
    """The library's folder as rows: each document a finding of its source's run, every sixth file torn, and a meta.json and
    an overview of each run."""
    docs = views.table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    torn = F.col("doc_id") % 6 == 5
    head = F.format_string("# [%d] %s\n\n- **URL:** https://a.org/%d\n- **Domain:** a.org\n- **Relevance:** %d/10\n- **Found via:** %s\n\n**Summary:** s\n\n## Notes\n\n", "doc_id", "lang", "doc_id", F.col("doc_id") % 11, "source")
    found = docs.select(F.col("source").alias("run_id"), F.format_string("findings/%09d_x.md", "doc_id").alias("name"), F.when(torn, "text").otherwise(F.concat(head, "text")).alias("text"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("k"))
    meta = F.when(F.col("k") % 4 == 3, '{"query": "torn').when(F.col("k") % 4 == 2, "{}").otherwise(F.format_string('{"query": "q %d", "depth": %d, "title": "t", "extra": [1]}', "k", "k"))
    return found.unionByName(first.select(F.col("source").alias("run_id"), F.lit("meta.json").alias("name"), meta.alias("text")))


def _known(spark, d):
    return views.table(spark, d, "documents").where("doc_id % 5 = 1").select(F.col("source").alias("id")).where("id in ('src1', 'src6')")


def _restored(spark, d):
    runs, findings = missing(_files(spark, d), _known(spark, d))
    n = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("relevance").alias("relevance"))
    return runs.select("id", "query", "depth", "status", "title").join(n.withColumnRenamed("run_id", "id"), "id", "left")


def _stored(spark, d):
    files = _files(spark, d)
    rows = findings_of(files).withColumn("path", F.when(F.col("idx") % 7 == 0, "gone.md").otherwise(F.col("path")))
    return stored_findings(rows, files).select("run_id", "idx", "query", F.md5("notes").alias("notes"), F.size("facts").alias("facts"))


# A text's own lines can look like a heading or a field, so only files whose text has none are held against SQL's plain reading.
_META = "m as (select source as id, k, case when k % 4 = 2 then source else 'q ' || k end as query, case when k % 4 = 2 then 1 else k end as depth, case when k % 4 <> 2 then 't' end as title from (select source, min(doc_id) as k from documents group by source) where k % 4 <> 3)"
QUERIES = {
    "restored_runs": (
        _restored,
        f"""with {_META}, f as (select source as id, count(*) as findings, cast(sum(doc_id % 11) as double) as relevance from documents where doc_id % 6 <> 5 group by source)
        select id, query, cast(depth as int) as depth, 'completed' as status, title, findings, relevance from m left join f using (id) where id not in (select source from documents where doc_id % 5 = 1 and source in ('src1', 'src6'))""",
    ),
    "stored_findings": (
        _stored,
        r"""select source as run_id, cast(doc_id as int) as idx, case when doc_id % 7 = 0 then '' else source end as query,
        md5(case when doc_id % 7 = 0 then 's' else trim(text, ' ' || chr(9) || chr(10)) end) as notes, 0 as facts from documents where doc_id % 6 <> 5""",
    ),
}
