"""Figures and numbered names that sentences assert, and the sources that state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.citations import GROUP
from ..functions.text import let
from ..sources import views

# What words, numbers, versions, numbers with a unit, and ranges look like; ordinals; sentences about the unknown.
WORD = r"[~≈]?\w[\w.,%×+/–-]*"
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
VERSION = r"\d+(?:\.\d+){2,}"
WITH_UNIT = r"(\d+(?:\.\d+)?)([A-Za-z%×]{1,5}(?:/[A-Za-z]{1,3})?)"
RANGE = r"(\d+(?:\.\d+)?)[–-](\d+(?:\.\d+)?)([A-Za-z%×]{0,5})"
ORDINAL = ("st", "nd", "rd", "th")
ABSENCE = (
    r"(?i)\b(?:missing|unknown|unclear|uncertain|undocumented|unreported|unverified|(?:less|poorly|under)[- ]documented"
    r"|no (?:public )?(?:data|figures?|benchmarks?|numbers?)|not (?:yet |fully |well |widely |publicly |independently )?"
    r"(?:documented|reported|published|benchmarked|detailed|measured|released|confirmed|available|verified|tested))\b"
)

_ENDS = r"(?<=[.!?])(?<!\b(?:e\.g|i\.e|vs|cf|etc|approx|Dr|Mr|Ms|No)\.) (?=[A-Z0-9])"
_TOKEN = "array<struct<kind:string,key:string,unit:string>>"


def number_key(value: Column) -> Column:
    """One spelling of a number: without thousands' commas and trailing zeros."""
    plain = F.replace(value, F.lit(","), F.lit(""))
    return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _token(kind: str, key: Column, unit: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), (F.lit("") if unit is None else F.replace(F.lower(unit), F.lit("×"), F.lit("x"))).alias("unit"))


def _number(value: Column, unit: Column | None = None, in_range: bool = False) -> Column:
    """An array of one number, or of none where it is a bare digit or a year."""
    plain = F.replace(value, F.lit(","), F.lit(""))
    bare = F.lit(True) if unit is None else unit == ""
    small = F.lit(False) if in_range else F.length(plain) == 1
    idle = bare & ~plain.contains(".") & (small | plain.rlike("^(19|20)[0-9][0-9]$"))
    return F.when(idle, F.array().cast(_TOKEN)).otherwise(F.array(_token("num", number_key(value), unit)))


def _of_word(w: Column) -> Column:
    whole = lambda p: f"^(?:{p})$"
    part = lambda p, k: F.regexp_extract(w, whole(p), k)
    none = F.array().cast(_TOKEN)
    both = F.concat(_number(part(RANGE, 1), part(RANGE, 3), True), _number(part(RANGE, 2), part(RANGE, 3), True))
    unit = F.when(F.lower(part(WITH_UNIT, 2)).isin(*ORDINAL), none).otherwise(_number(part(WITH_UNIT, 1), part(WITH_UNIT, 2)))
    name = F.when(w.rlike("[A-Za-z]") & (F.length(folded(w)) > 3), F.array(_token("name", folded(w)))).otherwise(none)
    return (
        F.when(~w.rlike("[0-9]"), none)
        .when(w.rlike(whole(VERSION)), F.array(_token("ver", w)))
        .when(w.rlike(whole(RANGE)), both)
        .when(w.rlike(whole(NUMBER)), _number(w))
        .when(w.rlike(whole(WITH_UNIT)), unit)
        .otherwise(name)
    )


def claim_tokens(text: Column) -> Column:
    """Distinct (kind, key, unit): numbers (not years, bare digits or ordinals), versions, and names with a digit.

    A compound with slashes that is no number with a unit is taken apart.
    """
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), GROUP, " "), F.lit(WORD), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, "^[~≈]+", ""), "[.,;:/–-]+$", ""))
    apart = F.flatten(
        F.transform(
            bare,
            lambda w: F.when(w.contains("/") & ~w.rlike(f"^(?:{WITH_UNIT})$"), F.transform(F.split(w, "/"), lambda x: F.regexp_replace(x, "^[.,;:–-]+|[.,;:–-]+$", ""))).otherwise(F.array(w)),
        )
    )
    return F.array_distinct(F.flatten(F.transform(apart, _of_word)))


def evidence_numbers(text: Column) -> Column:
    """Numbers that a source states, with what they are when cut or rounded to a whole."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), number_key))

    def wider(n: Column) -> Column:
        x = F.transform(F.filter(n, lambda v: v.contains(".")), lambda v: v.try_cast("double"))
        whole = lambda f: F.transform(x, lambda v: f(v).cast("decimal(38,0)").cast("string"))
        return F.array_distinct(F.concat(n, whole(F.floor), whole(F.bround)))

    return let(found, wider)


def states_absence(sentence: Column) -> Column:
    return sentence.rlike(ABSENCE)


def sentence_texts(text: Column) -> Column:
    """The sentences of ``sentence_spans`` alone, in time linear in the text."""
    return F.split(F.coalesce(text, F.lit("")), _ENDS)


def sentence_spans(text: Column) -> Column:
    """(start, end, sentence) between sentence ends, after which a capital or digit follows; an abbreviation ends none."""
    parts = sentence_texts(text)
    ends = lambda p: F.transform(p, lambda x, i: F.aggregate(F.slice(p, 1, i), F.lit(0), lambda n, y: n + F.length(y) + 1))
    return let(parts, lambda p: F.transform(F.arrays_zip(p.alias("s"), ends(p).alias("at")), lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["s"])).alias("end"), x["s"].alias("sentence"))))


def figure_sources(claims: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """Of claims (claim, cited, text) the numbers that the cited source does not state, and up to ``most`` others that do:
    claim, key, source, place. Tokens meet in an equi-join; nothing is compared text by text."""
    asked = claims.select("claim", "cited", F.explode(claim_tokens(F.col("text"))).alias("t")).where("t.kind = 'num'").select("claim", "cited", "t.key").distinct()
    stated = sources.select("source", F.explode(evidence_numbers(F.col("text"))).alias("key")).groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))
    own = stated.select(F.col("source").alias("cited"), "key")
    absent = asked.join(own, ["cited", "key"], "left_anti")
    found = absent.join(stated, "key").where("source <> cited")
    place = F.row_number().over(W.partitionBy("claim", "key").orderBy(F.desc("n"), "source"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("claim", "key", "source", "place")


def figure_stats(reports: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of a report that assert figures, those of them that cite, and those about what is not known."""
    # What a sentence asserts as a figure has a digit; most sentences have none.
    has = F.when(F.col("s").rlike("[0-9]"), F.size(claim_tokens(F.col("s"))) > 0).otherwise(False)
    rows = reports.select(key, F.explode(sentence_texts(F.col(text))).alias("s"))
    rows = rows.select(key, has.alias("has"), F.col("s").rlike(GROUP).alias("cites"), states_absence(F.col("s")).alias("absent"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.count_if("has").alias("with_figures"), F.count_if(F.col("has") & F.col("cites")).alias("cited"), F.count_if("absent").alias("absent"))


def _with_figures(spark, d):
    """Texts with a figure of every kind put before them."""
    return views.table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit(_SAID), F.col("doc_id"), F.lit(".50GB [1]. It is not yet measured, e.g. No. 3. "), F.col("text")).alias("text"))


_SAID = "Qwen3.8-Flash takes ~24 tok/s, 1,200 MB or 3-12GB in 2024, the 1st of 3 options, v1.2.3 and 10.4.2 on AVX2/FMA3 with 53.2% of "
_TEXT = f"'{_SAID}' || doc_id || '.50GB [1]. It is not yet measured, e.g. No. 3. ' || text"
_NUM = "case when contains(replace(V, ',', ''), '.') then regexp_replace(replace(V, ',', ''), '\\.?0+$', '') else replace(V, ',', '') end"
_FOLD = "regexp_replace(lower(W), '[^a-z0-9]', '', 'g')"


def _sql_number(value: str, unit: str, in_range: bool = False) -> str:
    plain = f"replace({value}, ',', '')"
    small = "false" if in_range else f"length({plain}) = 1"
    return f"case when {unit} = '' and not contains({plain}, '.') and ({small} or regexp_matches({plain}, '^(19|20)[0-9][0-9]$')) then [] else ['num:' || {_NUM.replace('V', value)} || ':' || replace(lower({unit}), '×', 'x')] end"


_X = lambda p, k: f"regexp_extract(w, '^(?:{p})$', {k})"
_OF = f"""case when not regexp_matches(w, '[0-9]') then [] when regexp_matches(w, '^(?:{VERSION})$') then ['ver:' || w || ':']
  when regexp_matches(w, '^(?:{RANGE})$') then {_sql_number(_X(RANGE, 1), _X(RANGE, 3), True)} || {_sql_number(_X(RANGE, 2), _X(RANGE, 3), True)}
  when regexp_matches(w, '^(?:{NUMBER})$') then {_sql_number("w", "''")}
  when regexp_matches(w, '^(?:{WITH_UNIT})$') then (case when lower({_X(WITH_UNIT, 2)}) in ('st', 'nd', 'rd', 'th') then [] else {_sql_number(_X(WITH_UNIT, 1), _X(WITH_UNIT, 2))} end)
  when regexp_matches(w, '[A-Za-z]') and length({_FOLD.replace("W", "w")}) > 3 then ['name:' || {_FOLD.replace("W", "w")} || ':'] else [] end"""
_BARE = f"list_transform(regexp_extract_all(regexp_replace(t, '{GROUP}', ' ', 'g'), '{WORD}'), lambda w: regexp_replace(regexp_replace(w, '^[~≈]+', ''), '[.,;:/–-]+$', ''))"
_APART = f"flatten(list_transform({_BARE}, lambda w: case when contains(w, '/') and not regexp_matches(w, '^(?:{WITH_UNIT})$') then list_transform(string_split(w, '/'), lambda x: regexp_replace(x, '^[.,;:–-]+|[.,;:–-]+$', '', 'g')) else [w] end))"
_TOKENS = f"list_distinct(flatten(list_transform({_APART}, lambda w: {_OF})))"
_STATED = """list_distinct(list_transform(regexp_extract_all(replace(t, ',', ''), '[0-9]+(?:[.][0-9]+)?'), lambda v: case when contains(v, '.') then regexp_replace(v, '[.]?0+$', '') else v end))"""
_WIDER = "n || list_transform(list_filter(n, lambda v: contains(v, '.')), lambda v: cast(cast(floor(cast(v as double)) as decimal(38, 0)) as varchar)) || list_transform(list_filter(n, lambda v: contains(v, '.')), lambda v: cast(cast(round_even(cast(v as double), 0) as decimal(38, 0)) as varchar))"
QUERIES = {
    "figure_claims": (
        lambda s, d: _with_figures(s, d).select("doc_id", claim_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join(F.array_sort(F.transform("t", lambda x: F.concat_ws(":", x["kind"], x["key"], x["unit"]))), " ").alias("tokens")),
        f"with t as (select doc_id, {_TEXT} as t from documents), k as (select doc_id, {_TOKENS} as k from t) select doc_id, len(k) as n, array_to_string(list_sort(k), ' ') as tokens from k",
    ),
    "figure_other_sources": (
        lambda s, d: figure_sources(_with_figures(s, d).where("doc_id % 7 = 3").select(F.col("doc_id").alias("claim"), F.col("source").alias("cited"), "text"), views.table(s, d, "documents").select("source", "text")),
        f"""with t as (select doc_id, source as cited, {_TEXT} as t from documents where doc_id % 7 = 3), a as (select doc_id as claim, cited, unnest({_TOKENS}) as k from t),
        q as (select distinct claim, cited, string_split(k, ':')[2] as key from a where starts_with(k, 'num:')),
        n as (select source, {_STATED} as n from (select source, text as t from documents)), s as (select source, key, count(*) as n from (select source, unnest(list_distinct({_WIDER})) as key from n) group by all),
        f as (select q.claim, q.key, s.source, s.n from q join s on q.key = s.key where s.source <> q.cited and not exists (select 1 from s o where o.source = q.cited and o.key = q.key))
        select claim, key, source, cast(row_number() over (partition by claim, key order by n desc, source) as int) as place from f qualify place <= 3""",
    ),
    "figure_stats": (lambda s, d: figure_stats(_with_figures(s, d)), None),
    "figure_evidence": (
        lambda s, d: _with_figures(s, d).select("doc_id", evidence_numbers(F.col("text")).alias("n")).select("doc_id", F.size("n").alias("n"), F.array_join(F.array_sort("n"), " ").alias("numbers")),
        f"with n as (select doc_id, {_STATED} as n from (select doc_id, {_TEXT} as t from documents)), w as (select doc_id, list_distinct({_WIDER}) as w from n) select doc_id, len(w) as n, array_to_string(list_sort(w), ' ') as numbers from w",
    ),
    "absence_sentences": (
        lambda s, d: _with_figures(s, d).select("doc_id", states_absence(F.col("text")).alias("with_notice"), states_absence(F.regexp_replace("text", "not yet measured", "done")).alias("without")),
        f"""select doc_id, true as with_notice, regexp_matches(regexp_replace({_TEXT}, 'not yet measured', 'done', 'g'), '{ABSENCE}') as without from documents""",
    ),
}
