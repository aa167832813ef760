"""Excerpts of long pages around keywords: hits, merged windows, a choice under a budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import views

WINDOW, MOST, BUDGET = 1200, 8, 12_000
#: Hits that one keyword may bring, characters of the page's head, and the shortest excerpt that is worth cutting.
HITS, HEAD, SHORTEST = 20, 1000, 200
GAP = "\n[…]\n"


def keyword_pattern(keyword: str) -> str | None:
    """A keyword as whole words in either case, with any white space between its parts; null for a blank one."""
    parts = keyword.split()
    if not parts:
        return None
    edge = lambda c: r"\b" if c.isalnum() or c == "_" else ""
    return "(?i)" + edge(parts[0][0]) + r"\s+".join(map(re.escape, parts)) + edge(parts[-1][-1])


def _hits(text: Column, pattern: str, number: int) -> Column:
    """(start, end, keyword) of the first matches; their places follow from the lengths of what lies between them."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    total = lambda xs, k: F.aggregate(F.slice(xs, 1, k), F.lit(0), lambda a, x: a + x)

    def placed(between: Column, own: Column) -> Column:
        at = lambda i: total(between, i + 1) + total(own, i)
        return F.transform(own, lambda n, i: F.struct(at(i).alias("start"), (at(i) + n).alias("end"), F.lit(number).alias("keyword")))

    unicode = "(?U)" + pattern
    matches = F.slice(F.regexp_extract_all(text, F.lit(unicode), F.lit(0)), 1, HITS)
    return let(lengths(F.split(text, unicode, HITS + 1)), lambda b: let(lengths(matches), lambda o: placed(b, o)))


def _merged(hits: Column, n: Column, half: int) -> Column:
    """Windows around hits in order of place, those that touch made one: (start, end, keywords)."""
    wide = F.transform(F.array_sort(hits), lambda h: F.struct(F.greatest(F.lit(0), h["start"] - half).alias("start"), F.least(n, h["end"] + half).alias("end"), F.array(h["keyword"]).alias("keywords")))
    none = F.array().cast("array<struct<start:int,end:int,keywords:array<int>>>")

    def take(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.array_union(last["keywords"], x["keywords"]).alias("keywords"))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(wide, none, take)


def excerpt_spans(text: Column, keywords: list[str], *, window: int = WINDOW, most: int = MOST, budget: int = BUDGET) -> Column:
    """(start, end) of a text's excerpts in its order; an empty array without hits, a text or keywords.

    Up to HITS hits of each keyword and the text's head are widened by half a window and merged. The windows with most
    keywords come first, then the earlier ones; the first that overflows the budget is cut if SHORTEST is left, and ends
    the choice. All within the row: nothing is shuffled, and what a fold holds is bounded by the hits.
    """
    patterns = [p for p in map(keyword_pattern, keywords) if p]
    none = F.array().cast("array<struct<start:int,end:int>>")
    if not patterns:
        return none
    found = F.concat(*[_hits(text, p, k) for k, p in enumerate(patterns)])
    head = F.struct(F.lit(0).alias("start"), F.least(F.lit(HEAD), F.length(text)).alias("end"), F.lit(-1).alias("keyword"))
    ranked = lambda ms: F.array_sort(F.transform(ms, lambda m, i: F.struct((-F.size(m["keywords"])).alias("few"), i.alias("at"), m["start"].alias("start"), m["end"].alias("end"))))
    state = lambda left, open_, out: F.struct(left.alias("left"), open_.alias("open"), out.alias("out"))

    def take(a: Column, x: Column) -> Column:
        size = x["end"] - x["start"]
        span = lambda end: F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), end.alias("end"))))
        return (
            F.when(~a["open"] | (F.size(a["out"]) >= most), a)
            .when(size <= a["left"], state(a["left"] - size, F.lit(True), span(x["end"])))
            .when(a["left"] >= SHORTEST, state(F.lit(0), F.lit(False), span(x["start"] + a["left"])))
            .otherwise(state(a["left"], F.lit(False), a["out"]))
        )

    chosen = lambda hs: F.aggregate(ranked(_merged(F.concat(hs, F.array(head)), F.length(text), max(1, window // 2))), state(F.lit(budget), F.lit(True), none), take, lambda a: F.array_sort(a["out"]))
    return F.coalesce(let(found, lambda hs: F.when(F.size(hs) > 0, chosen(hs)).otherwise(none)), none)


def excerpts(docs: DataFrame, keywords: list[str], key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(key, spans, excerpt): the excerpts of whole texts, trimmed and joined by a mark of what is left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = lambda x: F.regexp_replace(F.substring(t, x["start"] + 1, x["end"] - x["start"]), r"^\s+|\s+$", "")
    made = docs.select(F.col(key), t.alias(text), excerpt_spans(t, keywords, **limits).alias("spans"))
    t = F.col(text)
    return made.select(key, "spans", F.array_join(F.transform("spans", cut), GAP).alias("excerpt"))


#: Keywords of the registered query: frequent and rare words, a phrase, a sign.
KEYWORDS = ("there", "und", "the  of", "ation", "%", "password")


def _sql(keywords=KEYWORDS) -> str:
    hits = " union all ".join(
        f"select doc_id, {k} as k, regexp_split_to_array(w, '{p}') as b, regexp_extract_all(w, '{p}') as o from d" for k, p in enumerate(map(keyword_pattern, keywords))
    )
    # This dialect's word boundaries know ASCII alone, so other letters are looked at as an x.
    return rf"""with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[^\x00-\x7F\PL]', 'x', 'g') as w from documents), m as ({hits}),
    i as (select doc_id, k, b, o, unnest(range(1, least(len(o), {HITS}) + 1)) as i from m where len(o) > 0),
    p as (select doc_id, k, length(o[i]) as n, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(o[1:i - 1], lambda x: length(x))), 0) as b from i),
    h as (select doc_id, k, b, b + n as e from p union all select doc_id, -1, 0, least({HEAD}, length(text)) from d where doc_id in (select doc_id from p)),
    w as (select doc_id, k, greatest(0, b - {WINDOW // 2}) as s, least(length(text), e + {WINDOW // 2}) as e from h join d using (doc_id)),
    u as (select *, max(e) over (partition by doc_id order by s, e, k rows between unbounded preceding and 1 preceding) as upto from w),
    g as (select *, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by doc_id order by s, e, k rows unbounded preceding) as g from u),
    r as (select doc_id, g, min(s) as s, max(e) as e, count(distinct k) as ks from g group by all),
    c as (select *, row_number() over (partition by doc_id order by ks desc, g) as place, sum(e - s) over (partition by doc_id order by ks desc, g rows unbounded preceding) as upto from r),
    x as (select doc_id, s, case when upto <= {BUDGET} then e else s + {BUDGET} - (upto - (e - s)) end as e from c where place <= {MOST} and (upto <= {BUDGET} or {BUDGET} - (upto - (e - s)) >= {SHORTEST})),
    t as (select doc_id, count(*) as n, string_agg(regexp_replace(substr(text, cast(s + 1 as bigint), cast(e - s as bigint)), '^\s+|\s+$', '', 'g'), '{GAP}' order by s) as t from x join d using (doc_id) group by doc_id)
    select doc_id, cast(coalesce(n, 0) as int) as spans, cast(coalesce(length(t), 0) as int) as n_chars, md5(coalesce(t, '')) as digest from d left join t using (doc_id)"""


QUERIES = {
    "keyword_excerpts": (
        lambda s, d: excerpts(views.table(s, d, "documents"), list(KEYWORDS)).select("doc_id", F.size("spans").alias("spans"), F.length("excerpt").alias("n_chars"), F.md5("excerpt").alias("digest")),
        _sql(),
    ),
}
