"""Passages: evidence windows of a page, chunks of a document, quotes, threads, mined names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import claim_terms, normalized, normalized_is_verbatim, repair_quote
from ..sources import views

EVIDENCE = 1200
TARGET, MAXIMUM, OVERLAP = 1300, 1800, 400


def windows(text: Column, size: int = EVIDENCE) -> Column:
    """Starts at a third of a window's stride, without the last quarter window."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size / 4) / (size // 3)).cast("int") - 1)), lambda k: k * (size // 3))


def best_passage(pages: DataFrame, claim: str, key: str, text: str = "text", size: int = EVIDENCE) -> DataFrame:
    """(key, start) of each page's window that holds the claim's rarest terms; the middle one of the best.

    A term weighs ln(1 + windows / windows with it). Texts stay where they are; (key, start, term) rows are what is shuffled.
    """
    t = F.col(text)
    found = F.transform(windows(t, size), lambda s: F.struct(s.alias("s"), F.array_intersect(claim_terms(F.substring(t, s + 1, F.lit(size))), claim_terms(F.lit(claim))).alias("hit")))
    made = pages.select(key, F.length(t).alias("n"), found.alias("f"))
    made = made.select(key, "n", F.posexplode_outer("f").alias("k", "w")).select(key, "n", "w.s", "w.hit")
    hits = made.select(key, "s", "n", F.count(F.lit(1)).over(W.partitionBy(key)).alias("m"), F.explode_outer("hit").alias("term"))
    weighed = hits.withColumn("df", F.count("term").over(W.partitionBy(key, "term")))
    scores = weighed.groupBy(key, "s", "n").agg(F.round(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.ln(1 + F.col("m") / F.col("df")))), F.lit(0.0)), 9).alias("score"))
    top = scores.groupBy(key, "n").agg(F.max("score").alias("best"), F.collect_list(F.struct("s", "score")).alias("all"))
    tied = F.array_sort(F.transform(F.filter("all", lambda x: x["score"] == F.col("best")), lambda x: x["s"]))
    start = F.when((F.col("n") <= size) | (F.col("best") == 0), F.lit(0)).otherwise(F.get(tied, F.floor(F.size(tied) / 2).cast("int")))
    return top.select(key, start.cast("int").alias("start"), F.col("best").alias("score"))


def chunk_array(text: Column, target: int = TARGET, most: int = MAXIMUM, overlap: int = OVERLAP) -> Column:
    """Chunks of a text with Markdown headings, as an array, by one fold over its blocks.

    A heading line is a block of its own, marked so; other blocks are paragraphs between blank lines, and one of more
    than ``most`` characters is cut every ``target``. A chunk takes paragraphs while their lengths stay within ``target``
    and carries the heading above it; the next one begins with the last paragraph if that has ``overlap`` characters or
    less. A heading closes the chunk before it, and one without text is a chunk alone.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?md)^(#{1,6}\s.*)$", "\n\n\u0001$1\n\n")
    blocks = F.filter(F.transform(F.split(marked, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / target).cast("int")), lambda k: F.substring(x, k * target + 1, F.lit(target)))
    blocks = F.flatten(F.transform(blocks, lambda x: F.when(x.startswith("\u0001") | (F.length(x) <= most), F.array(x)).otherwise(cut(x))))

    none = F.array().cast("array<string>")
    state = lambda head, held, out: F.struct(head.alias("head"), held.alias("held"), out.alias("out"))
    closed = lambda a: F.when((F.size(a["held"]) == 0) & (a["head"] == ""), a["out"]).otherwise(
        F.concat(a["out"], F.array(F.array_join(F.concat(F.when(a["head"] == "", none).otherwise(F.array(a["head"])), a["held"]), "\n\n")))
    )

    def take(a, x):
        size = F.aggregate(a["held"], F.lit(0), lambda n, p: n + F.length(p))
        last = F.element_at(a["held"], -1)
        full = (F.size(a["held"]) > 0) & (size + F.length(x) > target)
        carried = F.when(F.length(last) <= overlap, F.array(last)).otherwise(none)
        return (
            F.when(x.startswith("\u0001"), state(F.substring(x, F.lit(2), F.length(x)), none, closed(a)))
            .when(full, state(a["head"], F.concat(carried, F.array(x)), closed(a)))
            .otherwise(state(a["head"], F.concat(a["held"], F.array(x)), a["out"]))
        )

    return F.aggregate(blocks, state(F.lit(""), none, none), take, closed)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, chunk): within each row, without a shuffle."""
    return docs.select(key, F.posexplode(chunk_array(F.col(text))).alias("chunk_idx", "chunk"))


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000) -> DataFrame:
    """Pieces of fixed length by position, for texts without structure."""
    n = F.ceil(F.length(text) / size).cast("int")
    return docs.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col(text), k * size + 1, F.lit(size)))).alias("piece", "text")).where("text <> ''")


def threads(turns: DataFrame) -> DataFrame:
    """Each conversation as one text, a line per turn in order, indented by who speaks."""
    line = F.concat(F.when(F.col("role") == "user", F.lit("")).otherwise(F.lit("  ")), F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    made = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return made.select("conv_id", "turns", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("thread"))


def mined_names(docs: DataFrame, group: str, at_least: int = 2) -> DataFrame:
    """Capitalised words within sentences that several sources share: folded key, its commonest form, its sources."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[a-z,] ([A-Z][A-Za-z0-9]{3,})"), F.lit(1))
    rows = docs.select(group, F.explode_outer(found).alias("form")).where("form is not null").withColumn("key", F.lower("form"))
    forms = rows.groupBy("key", "form").agg(F.count(F.lit(1)).alias("n"))
    best = forms.groupBy("key").agg(F.max_by("form", F.struct("n", "form")).alias("form"))
    per = rows.select("key", group).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= at_least)
    return per.join(best, "key")


CLAIM = "there then thing ation hereth 42 percent"


def _docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text")


def _quotes(spark, d):
    """Every document with a quote that stands in it, and one that does not."""
    x = _docs(spark, d)
    x = x.select("doc_id", F.substring("text", 20, 120).alias("q"), normalized(F.col("text")).alias("t"))
    return x.select("doc_id", normalized_is_verbatim(F.col("q"), F.col("t")).alias("own"), normalized_is_verbatim(F.reverse("q"), F.col("t")).alias("reversed"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(translate(TEXT, '‘’“”–—' || chr(160), '''''' || chr(34) || chr(34) || '-- ')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_N = lambda t: _NORM.replace("TEXT", t)


def _verbatim(q: str, t: str) -> str:
    g = f"list_transform(range(1, len(string_split({q}, ' ')) - 4), lambda i: array_to_string(string_split({q}, ' ')[i:i + 5], ' '))"
    return f"case when length({q}) < 12 then true when contains({t}, {q}) then true when len(string_split({q}, ' ')) < 8 then false else len(list_filter({g}, lambda x: contains({t}, x))) / len({g}) >= 0.6 end"


def _sectioned(spark, d):
    """Every document with a heading above its first and a bare one above its last thousand characters, and paragraphs."""
    t = F.regexp_replace("text", r"([.!?]) ([A-Z])", "$1\n\n$2")
    return _docs(spark, d).select("doc_id", F.concat(F.lit("# Title\n"), F.substring(t, 1, 1000), F.lit("\n## Empty\n### Rest\n"), F.substring(t, F.lit(1001), F.length(t))).alias("text"))


_CHUNKS = r"""with recursive t as (select doc_id, regexp_replace(text, '([.!?]) ([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g') as t from documents),
  m as (select doc_id, regexp_replace('# Title' || chr(10) || substr(t, 1, 1000) || chr(10) || '## Empty' || chr(10) || '### Rest' || chr(10) || substr(t, 1001), '(?m)^(#{1,6}\s.*)$', chr(10) || chr(10) || chr(1) || '\1' || chr(10) || chr(10), 'g') as t from t),
  b as (select doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as b from m),
  c as (select doc_id, flatten(list_transform(b, lambda x: case when starts_with(x, chr(1)) or length(x) <= 1800 then [x]
    else list_transform(range(0, cast(floor((length(x) - 1) / 1300) as bigint) + 1), lambda k: substr(x, k * 1300 + 1, 1300)) end)) as b from b),
  f(doc_id, b, k, head, held, done) as (
    select doc_id, b, 0, '', cast([] as varchar[]), cast(null as varchar) from c
    union all
    select doc_id, b, k + 1, case when starts_with(b[k + 1], chr(1)) then substr(b[k + 1], 2) else head end,
      case when k = len(b) or starts_with(b[k + 1], chr(1)) then [] when full_ then (case when length(held[-1]) <= 400 then [held[-1]] else [] end) || [b[k + 1]] else held || [b[k + 1]] end,
      case when (k = len(b) or starts_with(b[k + 1], chr(1)) or full_) and (len(held) > 0 or head <> '') then array_to_string(case when head = '' then held else [head] || held end, chr(10) || chr(10)) end
    from (select *, len(held) > 0 and list_sum(list_transform(held, lambda p: length(p))) + length(b[k + 1]) > 1300 as full_ from f) where k <= len(b))
  select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) as chunk_idx, length(done) as n, md5(done) as digest from f where done is not null"""
QUERIES = {
    "best_passage": (lambda s, d: best_passage(_docs(s, d), CLAIM, "doc_id"), None),
    "chunk_documents": (lambda s, d: chunks(_sectioned(s, d)).select("doc_id", "chunk_idx", F.length("chunk").alias("n"), F.md5("chunk").alias("digest")), _CHUNKS),
    "fixed_pieces": (
        lambda s, d: pieces(_docs(s, d)).select("doc_id", "piece", F.length("text").alias("n"), F.md5("text").alias("digest")),
        "select doc_id, cast(k as int) as piece, cast(length(substr(text, k * 2000 + 1, 2000)) as int) as n, md5(substr(text, k * 2000 + 1, 2000)) as digest from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 2000) as bigint))) as k from documents)",
    ),
    "quote_verbatim": (_quotes, f"with n as (select doc_id, {_N('text')} as t, {_N('substr(text, 20, 120)')} as q, {_N('reverse(substr(text, 20, 120))')} as r from documents) select doc_id, {_verbatim('q', 't')} as own, {_verbatim('r', 't')} as reversed from n"),
    "quote_repair": (lambda s, d: _docs(s, d).select("doc_id", repair_quote(F.substring("text", 30, 150), F.col("text")).alias("repaired")), None),
    "thread_flatten": (
        lambda s, d: threads(views.table(s, d, "conversations")),
        "select conv_id, count(*) as turns, string_agg(case when role = 'user' then '' else '  ' end || '[' || role || '] ' || text, chr(10) order by turn) as thread from conversations group by conv_id",
    ),
    "mined_names": (
        lambda s, d: mined_names(views.table(s, d, "documents"), "source"),
        """with r as (select source, unnest(regexp_extract_all(text, '[a-z,] ([A-Z][A-Za-z0-9]{3,})', 1)) as form from documents), k as (select source, form, lower(form) as key from r),
        f as (select key, form, count(*) as n from k group by all), b as (select key, form from f qualify row_number() over (partition by key order by n desc, form desc) = 1)
        select k.key, count(distinct source) as sources, any_value(b.form) as form from k join b on k.key = b.key group by k.key having count(distinct source) >= 2""",
    ),
}
