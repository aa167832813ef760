"""Operator 5: secret scans with corpus-wide ownership frequency (DataFrame functions only).

The scan finds base candidates (assign, access, hex) and further ones (extra: bearer and vendor tokens, web tokens,
credentials in URLs, private-key headers). Every candidate value is hashed, and the hashes are counted over the corpus
by distinct owners and repositories. Values of few owners and few repositories look live: these are an owner's own.
Those of more owners, or copied into more repositories, are examples. Base spans stay whatever their count, and
live-looking extra spans are added to them.

The table of texts is read once (each kind's pattern is matched on its own, for hits, values and the text between): the
matches, not the texts, are written to the shared folder, and everything after reads that table. Positions come from the
lengths between matches, as a running sum within one text.

Defined results: null and empty texts have no spans and still give their row. Spans are code points, end exclusive. A
null owner counts as one owner of its own. Repeated rows are scanned each on its own, and the same repository twice is
one repository. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, table, written

#: (kind, pattern, group that holds the value, least length of that group), in the order in which kinds are listed.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    (
        "extra",
        r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{16,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
        r"|[Bb]earer [A-Za-z0-9._~+/-]{20,})|://[^\s/:@]+:[^\s/:@]{6,}@|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
        0,
        1,
    ),
)
BASE = ("assign", "access", "hex")
#: Example values that are broadcast to the hits; more of them meet the hits in a join.
BROADCAST_VALUES = 500_000
#: A value that this many owners and repositories have at most looks live; one that more have is an example.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 20
#: Code points in the pieces of a text from which redaction cuts.
CHUNK = 4096
#: Spans (of about 80 bytes) that are broadcast to the texts at most.
BROADCAST_SPANS = 500_000


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (kind, ord, before, length, value_n, value): text between matches is measured by splitting at them."""
    p = F.lit(pattern)
    hits, values = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("b"), hits.alias("h"), values.alias("v"))
    made = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("ord"),
            F.char_length(x["b"]).cast("long").alias("before"),
            F.char_length(x["h"]).cast("long").alias("n"),
            F.char_length(x["v"]).cast("long").alias("value_n"),
            F.substring(F.sha2(x["v"], 256), 1, 32).alias("value"),
        ),
    )
    made = F.filter(made, lambda x: x["n"].isNotNull())  # the piece after the last match has none
    return F.when(text.rlike(pattern), made)


def scan(docs: DataFrame, *, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per match and at least one per document: row, repository, owner, kind, start, end, value (a hash)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), t.alias("_t"))
    arrays = [F.coalesce(_found(F.col("_t"), k, p, g), F.array()) for k, p, g, _ in KINDS]
    hits = base.select("row", "repository", "owner", F.inline_outer(F.concat(*arrays)))
    hits = written(hits, "secret-hits")
    upto = F.sum(F.col("before") + F.col("n")).over(W.partitionBy("row", "kind").orderBy("ord"))
    hits = hits.withColumn("end", upto).withColumn("start", F.col("end") - F.col("n"))
    enough = F.lit(True)
    for kind, _, _, least in KINDS:
        enough = enough & ((F.col("kind") != kind) | (F.col("value_n") >= least))
    real = F.col("kind").isNotNull() & enough
    return hits.select("row", "repository", "owner", *[F.when(real, F.col(c)).alias(c) for c in ("kind", "start", "end", "value")])


def ownership(hits: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories: distinct pairs first, so a value that a third of all rows hold is combined early."""
    pairs = hits.where("value is not null").select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


_SPANS = "array<struct<start:bigint,kind_no:bigint,kind:string,end:bigint,live:boolean,added:boolean,before:bigint>>"


def find_secrets(
    docs: DataFrame, *, text: str = "text", owner: str = "source", repository: str = "doc_id", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES
) -> DataFrame:
    """Per document: repository, owner, spans array<struct<start, kind_no, kind, end, live, added, before>> in order of
    start, then kind; ``before`` is the furthest end of the spans before it."""
    hits = scan(docs, text=text, owner=owner, repository=repository)
    # Few values are examples, and these are the ones that many hits have: where they are few enough they are broadcast, so
    # that no value's hits meet in a task.
    wide = written(ownership(hits).where((F.col("n_owners") > live_owners) | (F.col("n_repositories") > live_repositories)).select("value", F.lit(False).alias("_narrow")), "example-values")
    if wide.count() <= BROADCAST_VALUES:
        wide = F.broadcast(wide)
    judged = hits.where("value is not null").join(wide, "value", "left").withColumn("live", F.coalesce("_narrow", F.lit(True)))
    order = F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind"))
    added = ~F.col("kind").isin(*BASE)
    shown = judged.where(~added | F.col("live")).select("row", "start", order.alias("kind_no"), "kind", "end", "live", added.alias("added"))
    earlier = W.partitionBy("row").orderBy("start", "kind_no").rowsBetween(W.unboundedPreceding, -1)
    shown = shown.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    spans = shown.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end", "live", "added", "before"))).alias("spans"))
    rows = hits.groupBy("row").agg(F.first("repository").alias("repository"), F.first("owner").alias("owner"))
    return rows.join(spans, "row", "left").select("repository", "owner", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(
    docs: DataFrame, *, text: str = "text", owner: str = "source", repository: str = "doc_id", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES
) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans become one, named by the first.

    Spans meet their text by a digest of key and text, so rows that share a key may differ, and repeated rows are alike.
    Values are counted by ``repository`` as in ``find_secrets``. The text is cut into chunks once, so that a piece costs
    its own length and not its distance from the text's start.
    """
    own, other, spans = free_name(docs, "_own"), free_name(docs, "_other"), free_name(docs, "_spans")
    marked = docs.withColumn(own, F.md5(F.concat_ws(chr(0), F.coalesce(F.col(repository).cast("string"), F.lit("")), F.col(text))))
    pair = F.struct(F.col(repository).alias("key"), F.col(own).alias("own"))
    named = marked.select(F.col(text).alias("text"), F.col(owner).alias("owner"), pair.alias("repository"))
    found = find_secrets(named, owner="owner", repository="repository", live_owners=live_owners, live_repositories=live_repositories).where(F.size("spans") > 0)
    found = found.groupBy(F.col("repository.own").alias(other)).agg(F.first("spans").alias(spans))
    if (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= BROADCAST_SPANS:  # then the texts stay where they are; else both sides are shuffled
        found = F.broadcast(found)
    t, chunk = F.col(text), F.lit(CHUNK).cast("long")

    def piece(chunks, a, b):
        first = F.floor(a / chunk)
        part = F.slice(chunks, (first + 1).cast("int"), (F.floor(b / chunk) - first + 1).cast("int"))
        return F.when(b > a, F.substring(F.array_join(part, ""), (a - first * chunk + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def joined(chunks):
        kept = F.filter(F.col(spans), lambda s: s["start"] >= s["before"])
        cut = F.transform(kept, lambda s: F.concat(piece(chunks, s["before"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        last = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))
        return F.concat(F.array_join(cut, ""), piece(chunks, last, F.char_length(t).cast("long")))

    whole = F.transform(F.array(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))), joined)[0]
    out = marked.join(found, F.col(own) == F.col(other), "left")
    return out.withColumn(text, F.when(F.col(spans).isNotNull(), whole).otherwise(t)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("repository").alias("doc_id"),
        *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(digest(F.filter("spans", lambda s: ~s["added"])), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text from documents
), m as (
  select doc_id, source, text, 1 as kind_no, 'assign' as kind, 8 as least,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as h,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as v,
    string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as b from d
  union all
  select doc_id, source, text, 2, 'access', 16, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'),
    string_split_regex(text, 'AKIA[A-Z0-9]+') from d
  union all
  select doc_id, source, text, 3, 'hex', 32, regexp_extract_all(text, '[0-9a-f]{32,}'), regexp_extract_all(text, '[0-9a-f]{32,}'),
    string_split_regex(text, '[0-9a-f]{32,}') from d
  union all
  select doc_id, source, text, 4, 'extra', 1, regexp_extract_all(text, 'EXTRA'), regexp_extract_all(text, 'EXTRA'), string_split_regex(text, 'EXTRA') from d
), e as (
  select doc_id, source, kind_no, kind, least, unnest(h) as h, unnest(v) as v, unnest(b[1:len(h)]) as b, unnest(range(1, len(h) + 1)) as i from m
), s as (
  select doc_id, source, kind_no, kind, v, length(v) >= least as ok,
    (sum(length(b) + length(h)) over (partition by doc_id, kind_no order by i))::bigint as e_, length(h) as n from e
), o as (
  select v, count(distinct coalesce(source, chr(1))) as owners, count(distinct (source, doc_id)) as places from s where ok group by v
), k as (
  select s.*, e_ - n as s_, owners <= 2 and places <= 20 as live from s join o using (v) where ok and (kind_no < 4 or (owners <= 2 and places <= 20))
), g as (
  select doc_id,
    count(*) filter (kind_no = 1)::bigint as n_assign, count(*) filter (kind_no = 2)::bigint as n_access, count(*) filter (kind_no = 3)::bigint as n_hex,
    coalesce(string_agg(kind || ':' || s_ || ':' || e_, ',' order by s_, kind_no) filter (kind_no < 4), '') as base,
    string_agg(kind || ':' || s_ || ':' || e_, ',' order by s_, kind_no) as spans, count(*) filter (live)::bigint as n_live
  from k group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from d left join g using (doc_id)
""".replace("EXTRA", KINDS[3][1])
