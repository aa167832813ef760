"""Checks of finished reports: known errors by block and condition, quotes that stand in a report, conflicting pairs,
mentions of names however they are punctuated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import citation_ids
from ..functions.text import let
from ..sources import views
from ..sources.scratch import bounded

#: Quotes of fewer characters say too little to be looked for, and subjects of fewer.
QUOTE_CHARS, SUBJECT_CHARS = 12, 3


def plain(text: Column) -> Column:
    """Without emphasis and code marks, white space as single spaces: how quotes and reports are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[*`]", ""), r"\s+", " "))


def body_of(text: Column, tails: tuple[str, ...] = ("## Researched but not used",)) -> Column:
    """A report up to the first of its closing lists."""
    out = F.coalesce(text, F.lit(""))
    for t in tails:
        out = F.substring_index(out, "\n" + t, 1)
    return out


def quotes_in_reports(quotes: DataFrame, reports: DataFrame) -> DataFrame:
    """quotes (report, quote, ...) with ``found``: the report's body holds the quote. One equi-join on the report; a
    report that is not there holds nothing."""
    bodies = reports.select("report", plain(body_of(F.col("text"))).alias("_body"))
    q = plain(F.col("quote"))
    return quotes.join(bodies, "report", "left").withColumn("found", F.coalesce((F.length(q) >= QUOTE_CHARS) & F.col("_body").contains(q), F.lit(False))).drop("_body")


def known_errors(blocks: DataFrame, facts: list[dict]) -> DataFrame:
    """(report, fact, status) of each report (report, text: one row per block) and fact.

    A fact has ``name``, ``terms`` and ``conditions``, each with patterns ``all`` and ``none`` and source numbers
    ``needs_cite`` (the block must cite, and none of these). Present: every condition holds in some block; absent: no block
    has a term; else clear. The facts are the caller's list, so a block is read once, where it is, into one flag per
    condition, and a report's flags are or-ed before they are shuffled.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    has = lambda p: t.rlike("(?i)" + p)

    def holds(c: dict) -> Column:
        out = F.lit(True)
        for p in c.get("all", ()):
            out = out & has(p)
        for p in c.get("none", ()):
            out = out & ~has(p)
        need = c.get("needs_cite")
        if need:
            ids = citation_ids(t)
            out = out & (F.size(ids) > 0) & ~F.arrays_overlap(ids, F.array(*map(F.lit, need)))
        return out

    flags = {f"c{i}_{j}": holds(c) for i, f in enumerate(facts) for j, c in enumerate(f["conditions"])}
    flags |= {f"t{i}_{j}": has(p) for i, f in enumerate(facts) for j, p in enumerate(f["terms"])}
    met = blocks.groupBy("report").agg(*[F.bool_or(v).alias(k) for k, v in flags.items()])

    def status(i: int, f: dict) -> Column:
        every = F.forall(F.array(*[F.col(f"c{i}_{j}") for j in range(len(f["conditions"]))]), lambda x: x)
        some = F.exists(F.array(F.lit(False), *[F.col(f"t{i}_{j}") for j in range(len(f["terms"]))]), lambda x: x)
        return F.struct(F.lit(f["name"]).alias("fact"), F.when(every, "present").when(some, "clear").otherwise("absent").alias("status"))

    return met.select("report", F.inline(F.array(*[status(i, f) for i, f in enumerate(facts)])))


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def conflict_pairs(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs (report, pos, subject, a, b) that a reader can check, the first of each unordered two quotes.

    Both quotes are long enough, neither holds the other, and the first block (report, at, text) that holds each names the
    subject. Only blocks of a pair's own report are looked at.
    """
    q = pairs.select("report", "pos", plain(F.col("a")).alias("_a"), plain(F.col("b")).alias("_b"), folded(F.col("subject")).alias("_s"))
    a, b = F.col("_a"), F.col("_b")
    q = q.where((F.length(a) >= QUOTE_CHARS) & (F.length(b) >= QUOTE_CHARS) & ~a.contains(b) & ~b.contains(a) & (F.length("_s") >= SUBJECT_CHARS))
    where = q.join(blocks.select("report", "at", plain(F.col("text")).alias("_t")), "report")
    home = lambda x: F.min(F.when(F.col("_t").contains(F.col(x)), F.struct(F.col("at"), folded(F.col("_t")).contains(F.col("_s")).alias("named"))))
    named = where.groupBy("report", "pos", "_a", "_b").agg(home("_a").alias("ha"), home("_b").alias("hb")).where("ha.named and hb.named")
    first = named.groupBy("report", F.least("_a", "_b").alias("_1"), F.greatest("_a", "_b").alias("_2")).agg(F.min("pos").alias("pos"))
    return pairs.join(first.select("report", "pos"), ["report", "pos"], "left_semi")


def mentions(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, n): how often a text names each name, however either is punctuated or spaced, as whole words.

    A name folds to its ASCII letters and digits in lower case; so do runs of a text's words, and both meet in an
    equi-join. A run has at most as many words as the longest folded name has characters, and one that grows beyond that
    length ends, so a text gives rows in proportion to its words. A letter beyond ASCII ends a run. Names that fold to one
    key are all named by it; a name without letters or digits is named nowhere. Runs are grown from words alone that begin
    some name, or a name's first word: at most three characters of each, so the list of beginnings is of bounded size.
    """
    named = names.select("name", folded(F.col("name")).alias("_key")).where("_key <> ''").distinct()
    longest = named.agg(F.coalesce(F.max(F.length("_key")), F.lit(0))).scalar()
    word = r"(?U)[A-Za-z0-9]+|[^\W_]"
    heads = F.explode(F.array(*[F.substring("_key", 1, k) for k in (1, 2, 3)]))
    begins = [r.h for r in named.select(heads.alias("h")).distinct().collect()]
    words = texts.select(key, F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0)).alias("_w"), longest.alias("_most"))

    def grown(w: Column, i: Column, most: Column) -> Column:
        start = F.struct(F.lit("").alias("run"), F.array().cast("array<string>").alias("all"), F.lit(True).alias("open"))

        def take(a: Column, x: Column) -> Column:
            run = F.concat(a["run"], F.lower(x))
            fits = a["open"] & (F.length(run) <= most) & x.rlike("^[A-Za-z0-9]")
            return F.when(fits, F.struct(run.alias("run"), F.concat(a["all"], F.array(run)).alias("all"), F.lit(True).alias("open"))).otherwise(F.struct(a["run"].alias("run"), a["all"].alias("all"), F.lit(False).alias("open")))

        return F.aggregate(F.slice(w, i + 1, F.greatest(most, F.lit(1))), start, take)["all"]

    runs = words.select(key, F.explode(let(F.col("_w"), lambda w: F.flatten(F.filter(F.transform(w, lambda x, i: F.when(F.lower(F.substring(x, 1, 3)).isin(begins), grown(w, i, F.col("_most")))), lambda a: a.isNotNull())))).alias("_key"))
    return runs.join(bounded(named), "_key").groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"))


FACTS = [
    {"name": "uncited rise", "terms": ["there"], "conditions": [{"all": ["there", r"\bthen\b"], "none": ["zebra"]}, {"all": ["ation"], "needs_cite": [2, 3]}]},
    {"name": "never said", "terms": ["quagga"], "conditions": [{"all": ["quagga"]}]},
    {"name": "half", "terms": ["UND"], "conditions": [{"all": [r"\bund\b"]}, {"all": ["quagga"]}]},
]


def _blocks(spark, d):
    """Lines of documents as blocks, with a citation after each."""
    x = views.table(spark, d, "documents").select(F.col("doc_id").alias("report"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return x.withColumn("text", F.concat("text", F.lit(" ["), (F.col("report") + F.col("at")) % 5, F.lit("]")))


def _quotes(spark, d):
    x = views.table(spark, d, "documents")
    cut = lambda at: F.substring("text", at, 40)
    both = F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("**"), cut(31), F.lit("**")).alias("quote")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("zq "), cut(31)).alias("quote")))
    made = quotes_in_reports(x.select(F.col("doc_id").alias("report"), F.inline(both)), x.select(F.col("doc_id").alias("report"), "text"))
    return made.select("report", "k", "found")


def _conflicts(spark, d):
    """Of every document two pieces as conflicting quotes, both ways round, and one that is too short."""
    x = views.table(spark, d, "documents").where("text is not null")
    cut = lambda at, n=40: F.substring("text", at, n)
    pair = lambda k, a, b: F.struct(F.lit(k).alias("pos"), cut(11, 8).alias("subject"), a.alias("a"), b.alias("b"))
    pairs = x.select(F.col("doc_id").alias("report"), F.inline(F.array(pair(0, cut(11), cut(61)), pair(1, cut(61), cut(11)), pair(2, cut(11), cut(61, 8)))))
    return conflict_pairs(pairs, _blocks(spark, d)).select("report", "pos")


_LINES = "l as (select report, i - 1 as at, x || ' [' || ((report + i - 1) % 5) || ']' as t, (report + i - 1) % 5 as c from (select doc_id as report, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"
_PLAIN = lambda e: rf"trim(regexp_replace(regexp_replace({e}, '[*`]', '', 'g'), '\s+', ' ', 'g'))"
QUERIES = {
    "known_errors": (
        lambda s, d: known_errors(_blocks(s, d), FACTS),
        rf"""with {_LINES}, m as (select report, bool_or(regexp_matches(t, '(?i)there') and regexp_matches(t, '(?i)\bthen\b') and not regexp_matches(t, '(?i)zebra')) as a, bool_or(regexp_matches(t, '(?i)ation') and len(list_intersect(list_transform(regexp_extract_all(t, '\[(\d{{1,3}})\]', 1), lambda x: cast(x as int)), [2, 3])) = 0) as b,
        bool_or(regexp_matches(t, '(?i)there')) as ta, bool_or(regexp_matches(t, '(?i)quagga')) as q, bool_or(regexp_matches(t, '(?i)und')) as tu, bool_or(regexp_matches(t, '(?i)\bund\b')) as u from l group by report)
        select report, 'uncited rise' as fact, case when a and b then 'present' when ta then 'clear' else 'absent' end as status from m
        union all select report, 'never said', case when q then 'present' else 'absent' end from m union all select report, 'half', case when u and q then 'present' when tu then 'clear' else 'absent' end from m""",
    ),
    "quotes_in_reports": (
        _quotes,
        f"""with q as (select doc_id as report, cast(k as int) as k, text, case k when 0 then '**' || substr(text, 31, 40) || '**' else 'zq ' || substr(text, 31, 40) end as quote from documents, range(2) r(k))
        select report, k, coalesce(length({_PLAIN('quote')}) >= 12 and contains({_PLAIN('text')}, {_PLAIN('quote')}), false) as found from q""",
    ),
    "checked_conflicts": (
        _conflicts,
        f"""with {_LINES}, b as (select report, "at" as pos, {_PLAIN('t')} as t from l), p as (select doc_id as report, k, text, lower(regexp_replace(substr(text, 11, 8), '[^A-Za-z0-9]', '', 'g')) as s from documents, range(3) r(k) where text is not null),
        q as (select report, k, s, {_PLAIN("substr(text, case k when 1 then 61 else 11 end, 40)")} as a, {_PLAIN("substr(text, case k when 1 then 11 else 61 end, case k when 2 then 8 else 40 end)")} as b from p),
        g as (select * from q where length(a) >= 12 and length(b) >= 12 and length(s) >= 3 and not contains(a, b) and not contains(b, a)),
        h as (select g.report, k, a, g.b, min(pos) filter (contains(t, a)) as ha, min(pos) filter (contains(t, g.b)) as hb, any_value(s) as s from g join b using (report) group by all),
        n as (select h.report, h.k, least(a, h.b) as x, greatest(a, h.b) as y from h join b m on m.report = h.report and m.pos = h.ha join b o on o.report = h.report and o.pos = h.hb
          where contains(regexp_replace(lower(m.t), '[^a-z0-9]', '', 'g'), s) and contains(regexp_replace(lower(o.t), '[^a-z0-9]', '', 'g'), s))
        select report, cast(min(k) as int) as pos from n group by report, x, y""",
    ),
    "name_mentions": (
        lambda s, d: mentions(views.table(s, d, "documents"), s.createDataFrame([(n,) for n in NAMES], "name string")),
        None,
    ),
}
#: Names of the registered query: one word, two words, one with dots.
NAMES = ("there", "the then", "o.n.e", "Verbe", "p a s s w o r d")
