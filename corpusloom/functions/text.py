"""Text as Column expressions: content words, two stemmers, overlap, quotes, budgets.

Expressions that are used more than once inside a lambda are bound first (``let``), because an expression that a lambda
refers to is evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views

# Fixed values.
STOPWORDS = (
    "the and for with from that this what which how are was were been being have has had can could should would will may might must about into over under "
    "between best top guide 2024 2025 2026 2027"
).split()
FILLER = (
    "the a an of for to in on at by and or with vs versus how what which any all other others etc anything everything else including but not limited it its "
    "this that these those they them is are be can could should would do does our we my your"
).split()
SUFFIXES = "ations ation ments ment ities ity ison ings ing ies ers es ed er s".split()
YEAR = r"(19|20)\d\d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _except(found: Column, stop: list[str]) -> Column:
    """Distinct elements but ``stop``; sets of words are made without lambdas, which run word by word uncompiled."""
    return F.array_except(found, F.array(*[F.lit(w) for w in stop]))


def _rewritten(found: Column, *changes: tuple[str, str]) -> Column:
    """Distinct words after the replacements, made in all of them at once; a word is bounded by spaces or the ends."""
    joined = F.array_join(found, " ")
    for pattern, new in changes:
        joined = F.regexp_replace(joined, pattern, new)
    return F.array_remove(F.array_distinct(F.split(joined, " ")), "")


def content_tokens(text: Column) -> Column:
    """Distinct ASCII words of three letters or more that are not stop words."""
    return _except(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)), STOPWORDS)


def stem_token(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return F.when((n > 5) & t.endswith("ing"), cut(3)).when((n > 5) & t.endswith("ed"), cut(2)).when((n > 4) & t.endswith("s") & ~t.endswith("ss"), cut(1)).otherwise(t)


#: What ``stem_token`` and ``facet_stem`` cut, at the ends of words between spaces; what stands before is looked at last.
_STEMMED = (r"(?:ing(?= |$)(?<=[a-z0-9]{3}ing)|ed(?= |$)(?<=[a-z0-9]{4}ed)|s(?= |$)(?<=[a-z0-9]{3}[a-rt-z0-9]s))", "")
#: SUFFIXES in groups of which a word ends in one at most, longer ones first.
_GROUPS = ("ations?", "ments?", "it(?:ies|y)", "i(?:son|ngs?|es)", "e(?:rs?|s|d)", "s")
_FACET_STEMMED = ("(?=[aeims])(?:" + "|".join(f"{x}(?= |$)(?<=[a-z0-9]{{3}}{x})" for x in _GROUPS) + ")", "")


def vocabulary(text: Column) -> Column:
    return _rewritten(content_tokens(text), _STEMMED)


def facet_stem(t: Column) -> Column:
    """The facets' own stemmer: the longest suffix that leaves three letters goes."""
    out = None
    for s in SUFFIXES:
        hit = t.endswith(s) & (F.length(t) - len(s) >= 3)
        out = F.when(hit, F.substring(t, F.lit(1), F.length(t) - len(s))) if out is None else out.when(hit, F.substring(t, F.lit(1), F.length(t) - len(s)))
    return out.otherwise(t)


def facet_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return _rewritten(_except(found, FILLER), _FACET_STEMMED)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's content words that the text holds; 0 for a query without any."""
    return let(content_tokens(query), lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, content_tokens(text))) / F.size(q)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; null where both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, let(F.size(F.array_intersect(a, b)), lambda k: k / (both - k)))


def is_about(facet: Column, text: Column) -> Column:
    """The text holds two of the facet's words, or its only one."""
    return words_are_about(facet_words(facet), facet_words(text))


def words_are_about(facet: Column, text: Column) -> Column:
    """``is_about`` of the facet words of both."""
    return (F.size(facet) == 0) | (F.size(F.array_intersect(facet, text)) >= F.least(F.size(facet), F.lit(2)))


def normalized(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces: what quotes are compared by."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def quote_is_verbatim(quote: Column, text: Column) -> Column:
    """Within the text, or six words in ten of its six-word runs are; under 12 characters there is nothing to check."""
    return let(normalized(text), lambda t: normalized_is_verbatim(quote, t))


def normalized_is_verbatim(quote: Column, text: Column) -> Column:
    """``quote_is_verbatim`` of a text that is ``normalized``."""

    def check(q: Column, t: Column) -> Column:
        w = F.split(q, " ")
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 5), lambda i: F.array_join(F.slice(w, i, 6), " "))
        share = let(grams, lambda g: F.size(F.filter(g, lambda x: t.contains(x))) / F.size(g) >= 0.6)
        return F.when(F.length(q) < 12, True).when(t.contains(q), True).when(F.size(w) < 8, False).otherwise(share)

    return let(normalized(quote), lambda q: check(q, text))


def sentences(text: Column) -> Column:
    """Trimmed pieces of 20 to 320 characters between sentence ends and line breaks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s).between(20, 320))


def repair_quote(quote: Column, text: Column) -> Column:
    """The first sentence that is most like the quote, if similar by half; 200 characters of it."""

    def best(q: Column) -> Column:
        scored = F.transform(sentences(text), lambda s: F.struct(F.coalesce(let(vocabulary(s), lambda v: jaccard(q, v)), F.lit(0.0)).alias("score"), s.alias("s")))
        top = F.aggregate(scored, F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("s")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
        return F.when((F.size(q) >= 4) & (top["score"] >= 0.5), F.substring(top["s"], 1, 200))

    return let(vocabulary(quote), best)


#: Words of one or two characters but two digits, and years, with the space after them.
_TOO_LITTLE = (r"(?<![^ ])(?:[a-z0-9]|[a-z][a-z0-9]|[0-9][a-z]|(?:19|20)[0-9]{2})(?: |$)", "")


def claim_terms(text: Column) -> Column:
    """Stemmed content words and numbers of two characters or more, without years."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d)", ""), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return _rewritten(_except(found, STOPWORDS), _TOO_LITTLE, _STEMMED)  # numbers and what ends in one have no suffix


def distinctive_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.rlike(f"^{YEAR}$")))


def est_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3)


def target_words(n: Column) -> Column:
    return F.least(F.greatest(50 * n, F.lit(900)), F.lit(5000))


def clip_text(text: Column, head: int = 34_000, tail: int = 6_000) -> Column:
    short = F.length(text) <= head + tail
    cut = F.concat(F.substring(text, 1, head), F.lit("\n\n[... document truncated ...]\n\n"), F.substring(text, -tail, tail))
    return F.when(short, text).otherwise(cut)


def is_degenerate(text: Column, most: int = 4000) -> Column:
    """200 characters or more with at most 12 distinct ones, or one of them more than half of the first ``most``."""

    def check(head: Column, cs: Column) -> Column:
        top = F.array_max(F.transform(cs, lambda c: F.length(head) - F.length(F.replace(head, c, F.lit("")))))
        return (F.size(cs) <= 12) | (top > 0.5 * F.length(head))

    return (F.length(text) >= 200) & let(F.substring(text, 1, most), lambda head: let(F.array_remove(F.array_distinct(F.split(head, "")), ""), lambda cs: check(head, cs)))


def score_10(value: Column, default: int = 0) -> Column:
    """0 to 10; a percentage is a tenth of itself, junk is the default."""
    v = value.try_cast("double")
    v = F.when(v.isNull() | F.isnan(v), F.lit(float(default))).when((v > 10) & (v <= 100), v / 10).otherwise(v)
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(10.0)).cast("int")


def lexical_rank(docs: DataFrame, queries: list[str], text: str = "text") -> DataFrame:
    """(doc_id, q, overlap) of every document with each of a few stated queries."""
    qs = F.array(*[F.lit(q) for q in queries])
    made = docs.select("doc_id", content_tokens(F.col(text)).alias("t"), F.posexplode(qs).alias("q", "query")).withColumn("w", content_tokens(F.col("query")))
    return made.select("doc_id", "q", F.round(F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_intersect("w", "t")) / F.size("w")), 6).alias("overlap"))


#: Queries that the registered rankings use.
ASKED = ("there then thing ation hereth", "enheit schein stung verbe", "the of and")


def _docs(fn):
    return lambda spark, d: fn(views.table(spark, d, "documents"))


def _bench(fn):
    return lambda spark, d: fn(views.table(spark, d, "benchmark"))


def _md5(a: Column) -> Column:
    return F.md5(F.array_join(F.array_sort(a), " "))


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_TOK = f"list_distinct(list_filter({_WORDS}, lambda t: length(t) >= 3 and not list_contains({_LIST(STOPWORDS)}, t)))"
_STEM = "case when length(t) > 5 and ends_with(t, 'ing') then t[:length(t) - 3] when length(t) > 5 and ends_with(t, 'ed') then t[:length(t) - 2] when length(t) > 4 and ends_with(t, 's') and not ends_with(t, 'ss') then t[:length(t) - 1] else t end"
_FSTEM = "case " + " ".join(f"when ends_with(t, '{s}') and length(t) - {len(s)} >= 3 then t[:length(t) - {len(s)}]" for s in SUFFIXES) + " else t end"
_FTOK = f"list_distinct(list_transform(list_filter({_WORDS}, lambda t: length(t) >= 2 and not list_contains({_LIST(FILLER)}, t)), lambda t: {_FSTEM}))"
_M = lambda e: f"md5(array_to_string(list_sort({e}), ' '))"
_VOC = f"list_distinct(list_transform({_TOK}, lambda t: {_STEM}))"
_NORM = r"trim(regexp_replace(regexp_replace(lower(translate(coalesce(text, ''), '‘’“”–—' || chr(160), '''''' || chr(34) || chr(34) || '-- ')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _facets(spark, d):
    """How much of each benchmark item's wording each language's documents cover: facet words against document frequency."""
    items = views.table(spark, d, "benchmark").select("item_id", F.explode(facet_words(F.col("text"))).alias("w"))
    docs = views.table(spark, d, "documents").select("lang", F.explode(facet_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return items.join(docs, "w", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("df").isNull()).alias("uncovered"), F.count_if(F.col("df") >= 3).alias("common"))


QUERIES = {
    "content_tokens": (_docs(lambda x: x.select("doc_id", content_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), _md5(F.col("t")).alias("digest"))), f"select doc_id, cast(len(t) as int) as n, {_M('t')} as digest from (select doc_id, {_TOK} as t from documents)"),
    "stemmed_vocab": (_docs(lambda x: x.select("doc_id", vocabulary(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), _md5(F.col("t")).alias("digest"))), f"select doc_id, cast(len(t) as int) as n, {_M('t')} as digest from (select doc_id, {_VOC} as t from documents)"),
    "facet_words": (_bench(lambda x: x.select("item_id", facet_words(F.col("text")).alias("t")).select("item_id", F.size("t").alias("n"), _md5(F.col("t")).alias("digest"))), f"select item_id, cast(len(t) as int) as n, {_M('t')} as digest from (select item_id, {_FTOK} as t from benchmark)"),
    "facet_coverage": (
        _facets,
        f"""with i as (select item_id, unnest({_FTOK}) as w from benchmark), d as (select w, count(*) as df from (select unnest({_FTOK}) as w from documents) group by w)
        select item_id, count(*) as words, count(*) filter (df is null) as uncovered, count(*) filter (df >= 3) as common from i left join d using (w) group by item_id""",
    ),
    "lexical_overlap": (
        _docs(lambda x: lexical_rank(x, list(ASKED))),
        f"""with q(q, text) as (values {", ".join(f"({k}, '{v}')" for k, v in enumerate(ASKED))}), w as (select q, {_TOK} as w from q), t as (select doc_id, {_TOK} as t from documents)
        select doc_id, cast(q as int) as q, round(case when len(w) = 0 then 0.0 else len(list_intersect(w, t)) / len(w) end, 6) as overlap from t, w""",
    ),
    "normalized_text": (_docs(lambda x: x.select("doc_id", F.md5(normalized(F.col("text"))).alias("digest"))), f"select doc_id, md5({_NORM}) as digest from documents"),
    "exact_duplicates": (
        _docs(lambda x: x.select("doc_id", F.md5(normalized(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")),
        f"select digest, min(doc_id) as first_id, count(*) as copies from (select doc_id, md5({_NORM}) as digest from documents) group by digest having count(*) > 1",
    ),
    "distinctive_numbers": (
        _docs(lambda x: x.select("doc_id", distinctive_numbers(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), _md5(F.col("t")).alias("digest"))),
        f"select doc_id, cast(len(t) as int) as n, {_M('t')} as digest from (select doc_id, list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda t: length(t) >= 2 and not regexp_full_match(t, '(19|20)[0-9][0-9]'))) as t from documents)",
    ),
    "degenerate_docs": (
        _docs(lambda x: x.select("doc_id", is_degenerate(F.col("text")).alias("degenerate"))),
        """with c as (select doc_id, length(text) as n, unnest(string_split(substr(text, 1, 4000), '')) as c from documents), k as (select doc_id, n, c, count(*) as m from c group by all),
        s as (select doc_id, n >= 200 and (count(*) <= 12 or max(m) > 0.5 * sum(m)) as degenerate from k group by doc_id, n)
        select d.doc_id, coalesce(degenerate, false) as degenerate from documents d left join s using (doc_id)""",
    ),
    "clip_and_budget": (
        _docs(lambda x: x.select("doc_id", est_tokens(F.col("text")).alias("est_tokens"), target_words(F.size(words(F.col("text")))).alias("target"), F.length(clip_text(F.col("text"), 3000, 500)).alias("clipped"), score_10(F.col("n_chars") % 120).alias("score"))),
        f"select doc_id, length(text) // 3 as est_tokens, cast(least(greatest(50 * len({_WORDS}), 900), 5000) as int) as target, cast(case when length(text) <= 3500 then length(text) else 3532 end as int) as clipped, cast(trunc(least(10.0, case when n_chars % 120 > 10 and n_chars % 120 <= 100 then (n_chars % 120) / 10 else n_chars % 120 end)) as int) as score from documents",
    ),
    "vocabulary_likeness": (
        _docs(lambda x: x.select("doc_id", vocabulary(F.col("text")).alias("a"), vocabulary(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).alias("b")).select("doc_id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("likeness"))),
        f"""with a as (select doc_id, {_VOC} as a from documents), b as (select doc_id, {_VOC} as b from (select doc_id, substr(text, 1, length(text) // 2) as text from documents))
        select doc_id, round(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 6) as likeness from a join b using (doc_id)""",
    ),
    "texts_about": (
        _docs(lambda x: x.select("doc_id", facet_words(F.col("text")).alias("w")).select("doc_id", *[words_are_about(facet_words(F.lit(q)), F.col("w")).alias(f"about{k}") for k, q in enumerate(ASKED)])),
        "with t as (select doc_id, " + _FTOK + " as t from documents), " + ", ".join(f"q{k} as (select {_FTOK} as w{k} from (select '{q}' as text))" for k, q in enumerate(ASKED))
        + " select doc_id, " + ", ".join(f"len(w{k}) = 0 or len(list_intersect(w{k}, t)) >= least(len(w{k}), 2) as about{k}" for k in range(len(ASKED))) + " from t, " + ", ".join(f"q{k}" for k in range(len(ASKED))),
    ),
    "claim_terms": (
        _bench(lambda x: x.select("item_id", F.size(claim_terms(F.col("text"))).alias("n"))),
        f"""with t as (select item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?'), lambda t: case when regexp_full_match(replace(t, '.', ''), '[0-9]+') then length(t) >= 2 and not regexp_full_match(t, '(19|20)[0-9][0-9]')
          else length(t) >= 3 and not list_contains({_LIST(STOPWORDS)}, t) end) as t from benchmark)
        select item_id, cast(len(list_distinct(list_transform(t, lambda t: case when regexp_full_match(replace(t, '.', ''), '[0-9]+') then t else {_STEM} end))) as int) as n from t""",
    ),
}
