"""What reports are made of: facets of questions, reranked hits, evidence lines, repeats, listed asks, model JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..sources import views


def facet_name(name: Column, most: int = 110) -> Column:
    """A facet's key: lower case, single spaces, cut at a word."""
    plain = F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), r"\s+", " "))
    cut = F.regexp_replace(F.substring(plain, 1, most), r" [^ ]*$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(cut)


def facet_of_query(queries: DataFrame, facets: DataFrame, at_least: int = 2) -> DataFrame:
    """The facet that shares most stems with each query, the first of equals; null below ``at_least``.

    queries: id, query. facets: facet, facet_order (a short list, broadcast).
    """
    q = queries.select("id", F.explode_outer(tx.facet_words(F.col("query"))).alias("w"))
    f = facets.select("facet", "facet_order", F.explode(tx.facet_words(F.col("facet"))).alias("w"))
    shared = q.join(F.broadcast(f), "w").groupBy("id", "facet", "facet_order").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= at_least)
    best = shared.groupBy("id").agg(F.max_by("facet", F.struct("shared", -F.col("facet_order"))).alias("facet"))
    return queries.select("id").join(best, "id", "left")


def reranked(hits: DataFrame) -> DataFrame:
    """Places by a second score where every hit of a query has one, else as they were: all or nothing."""
    w = W.partitionBy("q")
    whole = F.count_if(F.col("second").isNull()).over(w) == 0
    order = F.when(whole, -F.col("second")).otherwise(F.col("rank").cast("double"))
    return hits.withColumn("place", F.row_number().over(w.orderBy(order, "rank")))


def evidence_lines(lines: DataFrame, per_source: int = 3, most: int = 30) -> DataFrame:
    """Lines of each topic, a few per source and so many in all, without those that fold to the same 80 characters."""
    folded = F.substring(F.regexp_replace(F.lower("line"), "[^a-z0-9]", ""), 1, 80)
    first = lines.withColumn("_f", folded).groupBy("topic", "_f").agg(F.min_by(F.struct("source", "pos", "line"), F.struct("source", "pos")).alias("s")).select("topic", "s.*")
    few = first.withColumn("_k", F.row_number().over(W.partitionBy("topic", "source").orderBy("pos"))).where(F.col("_k") <= per_source)
    return few.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy("source", "pos"))).where(F.col("place") <= most).drop("_k")


def repeats(sentences: DataFrame, similar: float = 0.5, least: int = 8) -> DataFrame:
    """Sentences (report, section, pos, text) like an earlier one of another section: report, pos, earlier, similarity.

    Of a sentence only its rarest words in the report are joined: one of n words that is ``similar`` to another shares one of
    its n - ceil(similar * n) + 1 rarest with it. Pairs are then counted on whole vocabularies. A report is a bounded group.
    """
    ready = sentences.select("report", "section", "pos", tx.vocabulary(F.col("text")).alias("v")).where(F.size("v") >= least)
    words = ready.select("report", "section", "pos", F.size("v").alias("n"), F.explode("v").alias("w"))
    words = words.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("report", "w")))
    place = F.row_number().over(W.partitionBy("report", "section", "pos").orderBy("df", "w"))
    rare = words.withColumn("k", place).where(F.col("k") <= F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1).where("df > 1").select("report", "section", "pos", "w")
    met = rare.alias("a").join(rare.alias("b"), (F.col("a.report") == F.col("b.report")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.section") != F.col("b.section")))
    pairs = met.select(F.col("a.report").alias("report"), F.col("a.section").alias("sa"), F.col("a.pos").alias("earlier"), F.col("b.section").alias("sb"), F.col("b.pos").alias("pos")).distinct()
    side = lambda p, s, v: ready.select("report", F.col("section").alias(s), F.col("pos").alias(p), F.col("v").alias(v))
    both = pairs.join(side("earlier", "sa", "va"), ["report", "sa", "earlier"]).join(side("pos", "sb", "vb"), ["report", "sb", "pos"])
    k = F.size(F.array_intersect("va", "vb"))
    made = both.select("report", "pos", "earlier", F.round(k / (F.size("va") + F.size("vb") - k), 4).alias("similarity"))
    return made.where(F.col("similarity") >= similar)


def kinds_by_head(candidates: DataFrame) -> DataFrame:
    """Candidates (report, name, sources) grouped by the stem of their last word; groups of one go unless all are."""
    head = tx.facet_stem(F.lower(F.element_at(F.split(F.trim("name"), " "), -1)))
    groups = candidates.withColumn("head", head).groupBy("report", "head").agg(F.count(F.lit(1)).alias("n"), F.sum("sources").alias("sources"), F.max_by("name", F.struct("sources", "name")).alias("label"))
    any_ = F.max("n").over(W.partitionBy("report"))
    return groups.withColumn("_m", any_).where((F.col("n") > 1) | (F.col("_m") == 1)).drop("_m")


#: Items of a list have this many characters, and a colon begins a list of this many lines at least.
ITEM_CHARS, COLON_LINES = (3, 300), 3


def listed_asks(questions: DataFrame, key: str, text: str) -> DataFrame:
    """What a question lists: key, pos, item. Lines that begin with a bullet or a number count where there are two or more
    of them, and plain lines below one that ends in a colon where there are three or more up to the next blank one."""
    low, high = ITEM_CHARS
    mark = r"^[ \t]*([-*\u2022\u2013]|[0-9]{1,2}[.)])[ \t]+"

    def kinds(lines):
        return F.transform(lines, lambda x: F.when(x.rlike(mark), "mark").when(F.trim(x) == "", "blank").when(F.rtrim(x).endswith(":"), "colon").otherwise("plain"))

    def body(lines, kind):
        items = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, mark, ""), r"[ \t]+$", "")), lambda x, i: (F.get(kind, i) == "mark") & F.length(x).between(low, high))
        runs = F.filter(F.transform(kind, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: x["k"] == "colon")

        def below(x):
            rest = F.slice(kind, x["i"] + 2, F.size(kind))
            stop = F.coalesce(F.array_min(F.filter(F.transform(rest, lambda k, j: F.when(k != "plain", j)), lambda j: j.isNotNull())), F.size(rest))
            return F.when(stop >= COLON_LINES, F.transform(F.slice(lines, x["i"] + 2, stop), lambda y: F.trim(y)))

        blocks = F.filter(F.transform(runs, below), lambda b: b.isNotNull())
        return F.concat(F.when(F.size(items) > 1, items).otherwise(F.array().cast("array<string>")), F.flatten(blocks))

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    found = F.transform(F.array(lines), lambda x: F.transform(F.array(kinds(x)), lambda k: body(x, k))[0])[0]
    return questions.select(key, F.posexplode(found).alias("pos", "item"))


def tolerant_json(reply: str | None) -> str | None:
    """The first JSON object or array of a model's reply as canonical JSON: fences, thoughts, trailing commas and cut ends are forgiven."""
    s = re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", reply or "")
    start = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    open_, quoted, escaped, end, comma = [], False, False, None, None
    for i in range(start, len(s)):
        c = s[i]
        if quoted:
            quoted, escaped = (escaped or c != '"'), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == ",":
            comma = (i, "".join(reversed(open_)))
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                end = i + 1
                break
    body = s[start:end] if end else s[start:] + '"' * quoted
    tries = [body]
    if not end:  # closed as it is, or without what follows the last comma
        tries = [re.sub(r"[,:\s]+$", "", body) + "".join(reversed(open_))] + ([s[start : comma[0]] + comma[1]] if comma else [])
    for t in tries:
        try:
            return json.dumps(json.loads(re.sub(r",(\s*[}\]])", r"\1", t)), sort_keys=True)
        except ValueError:
            continue
    return None


def parsed_replies(rows: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(tolerant_json)

    return rows.withColumn(out, parse(F.col(column)))


def metered_requests(runs: DataFrame) -> DataFrame:
    """Requests per owner: a run's own count, else its searches where its categories include the general one."""
    n = F.coalesce(F.col("requests"), F.when((F.col("categories") == "") | F.col("categories").contains("general"), F.col("searches")).otherwise(F.lit(0)))
    return runs.groupBy("owner").agg(F.sum(n).cast("long").alias("requests"))


def adaptive_caps(kept: DataFrame, base: int = 2, most: int = 6) -> DataFrame:
    """A source's cap in a run grows with what it has given."""
    return kept.withColumn("cap", F.least(F.lit(most), base + F.col("kept")).cast("int"))


def _sentences(spark, d):
    x = views.table(spark, d, "documents").select(F.col("doc_id").alias("report"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return x.withColumn("section", F.floor(F.col("pos") / 2))


def _hits(spark, d):
    e = views.table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 25).alias("q"), F.floor(F.col("vec_id") / 25).alias("rank"), F.when((F.col("vec_id") % 25 > 5) | (F.col("vec_id") % 4 > 0), F.round(F.get("embedding", F.lit(1)).cast("double"), 4)).alias("second"), F.col("vec_id").alias("id"))


def _names(spark, d):
    c = views.table(spark, d, "part")
    return c.select((F.col("p_partkey") % 40).alias("report"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("sources"))


_FACETS = (("there then the thing", 0), ("ation ing ent erer", 1), ("heren thand onth", 2), ("the that there then", 3))
_LINES = "l as (select report, i - 1 as pos, x from (select doc_id as report, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"


def _asked(spark, d):
    """Documents as questions with bulleted and numbered lines, a list below a colon, and one that is too short."""
    head = F.lit("Which of these:\n- alpha\n2) beta \nAlso:\n")
    body = F.replace(F.substring("text", 1, 400), F.lit(". "), F.lit(".\n"))
    return views.table(spark, d, "documents").select("doc_id", F.concat(head, body, F.lit("\n\nEnd:\nx")).alias("q"))


QUERIES = {
    "facet_names": (
        lambda s, d: views.table(s, d, "documents").select("doc_id", F.md5(facet_name(F.concat(F.lit("A_"), "text"))).alias("digest")),
        r"""with p as (select doc_id, trim(regexp_replace(lower(replace('A_' || text, '_', ' ')), '\s+', ' ', 'g')) as p from documents)
        select doc_id, md5(case when length(p) <= 110 then p else regexp_replace(substr(p, 1, 110), ' [^ ]*$', '') end) as digest from p""",
    ),
    "reranked_hits": (
        lambda s, d: reranked(_hits(s, d)).select("q", "id", "place"),
        """with h as (select vec_id % 25 as q, vec_id // 25 as rank, case when vec_id % 25 > 5 or vec_id % 4 > 0 then round(cast(embedding[2] as double), 4) end as second, vec_id as id from embeddings),
        w as (select *, count(*) filter (second is null) over (partition by q) = 0 as whole from h)
        select q, id, cast(row_number() over (partition by q order by case when whole then -second else rank end, rank) as int) as place from w""",
    ),
    "metered_requests": (
        lambda s, d: metered_requests(
            views.runs(s, d).select("owner", F.when(F.col("id") % 3 == 0, F.col("depth")).alias("requests"), F.when(F.col("id") % 5 == 0, "science").when(F.col("id") % 2 == 0, "general,news").otherwise("").alias("categories"), (F.col("depth") * 2).alias("searches"))
        ),
        f"""with {views.RUNS_SQL}, m as (select owner, case when id % 3 = 0 then depth when id % 5 = 0 then 0 else depth * 2 end as n from runs) select owner, cast(sum(n) as bigint) as requests from m group by owner""",
    ),
    "adaptive_caps": (
        lambda s, d: adaptive_caps(views.outcomes(s, d).groupBy("run_id", "domain").agg(F.count_if(F.col("outcome") == "kept").alias("kept"))),
        f"with {views.OUTCOMES_SQL} select run_id, domain, count(*) filter (outcome = 'kept') as kept, cast(least(6, 2 + count(*) filter (outcome = 'kept')) as int) as cap from outcomes group by all",
    ),
    "facet_of_query": (
        lambda s, d: facet_of_query(views.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query")), s.createDataFrame(list(_FACETS), "facet string, facet_order int")),
        f"""with f as (select * from (values {', '.join(map(str, _FACETS))}) as t(text, o)), fw as (select text as facet, o, unnest({tx._FTOK}) as w from f), q as (select item_id as id, unnest({tx._FTOK}) as w from benchmark),
        k as (select id, facet, o, count(*) as n from q join fw using (w) group by all having count(*) >= 2), b as (select id, facet from k qualify row_number() over (partition by id order by n desc, o) = 1)
        select item_id as id, facet from benchmark left join b on item_id = id""",
    ),
    "evidence_lines": (
        lambda s, d: evidence_lines(_sentences(s, d).select((F.col("report") % 5).alias("topic"), F.col("report").alias("source"), "pos", F.col("text").alias("line"))).select("topic", "source", "pos", "place"),
        f"""with {_LINES}, f as (select report % 5 as topic, report as source, pos, substr(regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), 1, 80) as f from l),
        o as (select * from f qualify row_number() over (partition by topic, f order by source, pos) = 1), k as (select * from o qualify row_number() over (partition by topic, source order by pos) <= 3)
        select topic, source, pos, cast(row_number() over (partition by topic order by source, pos) as int) as place from k qualify place <= 30""",
    ),
    "report_repeats": (
        lambda s, d: repeats(_sentences(s, d)),
        f"""with {_LINES}, v as (select report, pos, pos // 2 as section, {tx._VOC} as v from (select report, pos, x as text from l)), w as (select report, pos, section, len(v) as n, unnest(v) as w from v where len(v) >= 8),
        p as (select b.report, b.pos, a.pos as earlier, count(*) as k, any_value(a.n + b.n) as n from w a join w b on a.report = b.report and a.w = b.w and a.pos < b.pos and a.section <> b.section group by all)
        select report, pos, earlier, round(k / (n - k), 4) as similarity from p where round(k / (n - k), 4) >= 0.5""",
    ),
    "candidate_kinds": (
        lambda s, d: kinds_by_head(_names(s, d)),
        f"""with c as (select p_partkey % 40 as report, p_name as name, p_partkey % 7 as sources, lower(string_split(trim(p_name), ' ')[-1]) as t from part), h as (select report, name, sources, {tx._FSTEM} as head from c),
        g as (select report, head, count(*) as n, sum(sources) as sources, max({{'s': sources, 'n': name}}).n as label from h group by all), m as (select *, max(n) over (partition by report) as m from g)
        select report, head, n, cast(sources as bigint) as sources, label from m where n > 1 or m = 1""",
    ),
    "listed_asks": (
        lambda s, d: listed_asks(_asked(s, d), "doc_id", "q"),
        r"""with q as (select doc_id, string_split('Which of these:' || chr(10) || '- alpha' || chr(10) || '2) beta ' || chr(10) || 'Also:' || chr(10) || replace(substr(text, 1, 400), '. ', '.' || chr(10)) || chr(10) || chr(10) || 'End:' || chr(10) || 'x', chr(10)) as l from documents),
        l as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from q),
        k as (select *, case when regexp_matches(x, '^[ \t]*([-*•–]|[0-9]{1,2}[.)])[ \t]+') then 'mark' when trim(x) = '' then 'blank' when ends_with(rtrim(x), ':') then 'colon' else 'plain' end as k from l),
        m as (select doc_id, i, regexp_replace(regexp_replace(x, '^[ \t]*([-*•–]|[0-9]{1,2}[.)])[ \t]+', ''), '[ \t]+$', '') as item from k where k = 'mark'),
        m2 as (select *, count(*) over (partition by doc_id) as n from m where length(item) between 3 and 300),
        e as (select c.doc_id, c.i, coalesce(min(o.i), max(a.i) + 1) as stop from k c join k a on a.doc_id = c.doc_id left join k o on o.doc_id = c.doc_id and o.i > c.i and o.k <> 'plain' and o.i = a.i where c.k = 'colon' group by all),
        b as (select e.doc_id, e.i as block, k.i, trim(k.x) as item from e join k on k.doc_id = e.doc_id and k.i > e.i and k.i < e.stop where e.stop - e.i > 3),
        u as (select doc_id, 0 as block, i, item from m2 where n > 1 union all select * from b)
        select doc_id, cast(row_number() over (partition by doc_id order by block, i) - 1 as int) as pos, item from u""",
    ),
    "tolerant_json": (lambda s, d: parsed_replies(views.table(s, d, "events").select("event_id", F.concat(F.lit("<think>x</think>```json\n"), "props", F.lit("\n```")).alias("reply")), "reply").select("event_id", "parsed"), "select event_id, props as parsed from events"),
}
