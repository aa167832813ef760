"""Operator 10: quality rules as a short-circuit cascade (DataFrame functions only).

Each rule's selectivity and cost (the characters that it reads) are estimated on a sample, and the rules are then tried
in the order of rejections per cost: the first rule that rejects a row ends its cascade. The order changes the time
taken and failed_rule, never the verdict; the sample decides nothing else. The counts of the base rules are results, so
they are taken of every row before the cascade; what it saves are the rules' own readings of the text.

Defined results: a null or empty text has no words and fails the base rules; a null text stays null. Counts are taken
over the whole text. Repeated rows give repeated results. Columns of the input are kept but for those with the names of
results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, without, words_of

#: Rows, about, of the sample on which the cascade's order is estimated; at this many the order is settled well enough.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean SQL expression over the measured columns and ``text``; null counts as no rejection."""

    name: str
    rejects: str


#: The method's rules. Each rejects junk that the base counts show or that a regular expression finds in the text.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    Rule("shouting", "100 * (char_length(text) - char_length(regexp_replace(text, '[A-Z]', ''))) > 30 * word_chars"),
    Rule("exclamations", "10 * (char_length(text) - char_length(replace(text, '!', ''))) > n_words"),
)

def _measured_words(words: Column) -> Column:
    """Evaluates ``words`` once and measures the array: a lambda's variable is bound to the value, not to the expression."""
    return F.transform(
        F.array(words),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeats(w).alias("n_repeat_words"),
        ),
    )[0]


def _repeats(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, exact at any length.

    Windows are hashed above their position in one long each, so that one sort brings equal windows together. The bits
    that are left for the hash shrink as the text grows, so neighbours of equal hash are candidates only: these are
    sorted by their words, and windows count whose words equal a neighbour's.
    """
    equal_neighbour = lambda s, same: F.filter(
        s, lambda x, i: ((i > 0) & same(x, F.get(s, i - 1))) | ((i < F.size(s) - 1) & same(x, F.get(s, i + 1)))
    )

    def exact(w, places):
        spelled = F.transform(places, lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p")))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.sort_array(F.transform(F.transform(F.array(F.sort_array(spelled)), lambda s: equal_neighbour(s, same))[0], lambda x: x["p"].cast("long")))

    def body(bits, w):
        hash_of = lambda x: F.call_function("shiftrightunsigned", x, bits)
        place_of = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
        )
        likely = F.transform(F.array(F.sort_array(windows)), lambda s: F.transform(equal_neighbour(s, lambda x, y: hash_of(x) == hash_of(y)), place_of))[0]
        return F.aggregate(
            F.transform(F.array(likely), lambda places: exact(w, places))[0],
            F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(F.transform(F.array(F.length(F.bin(F.size(w)))), lambda b: body(b, w))[0])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    docs = without(docs, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    word, line = free_name(docs, "_w"), free_name(docs, "_l")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(
        F.array(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )[0]
    return docs.withColumns(
        {
            word: _measured_words(words_of(t)),
            line: lines,
            "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        }
    ).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *(F.col(f"{word}.{c}") for c in ("n_words", "word_chars")),
        "n_symbols",
        *(F.col(f"{line}.{c}") for c in ("n_lines", "n_dup_lines")),
        F.col(f"{word}.n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cascade_order(sample: DataFrame, rules=RULES, text: str = "text") -> list[Rule]:
    """Rules by rejections per cost on ``sample``, from one aggregate; ties stand in the given order.

    A rule's cost on a row is the characters that it reads: the text's length for each time it names ``text``, and 1 for
    its comparison of counts. This is the same in every run, unlike a clock.
    """
    if not rules:
        return []
    size = F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("double")
    rejected = [F.sum(F.coalesce(F.expr(r.rejects), F.lit(False)).cast("int")).alias(f"r{k}") for k, r in enumerate(rules)]
    row = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"), *rejected).first()
    reads = [len(re.findall(rf"\b{re.escape(text)}\b", r.rejects)) for r in rules]
    cost = [(row.n or 0) + k * (row.chars or 0.0) + 1 for k in reads]
    return [r for _, _, r in sorted((-(row[f"r{k}"] or 0) / cost[k], k, r) for k, r in enumerate(rules))]


def apply_rules(measured: DataFrame, order: list[Rule]) -> DataFrame:
    """``measured`` plus base_failed, failed_rule (the first that rejects, else null), kept."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        chain = chain.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(rule.name))
    out = without(measured, "base_failed", "failed_rule", "kept").withColumn("base_failed", F.coalesce(base_failed(), F.lit(True)))
    out = out.withColumn("failed_rule", chain)
    return out.withColumn("kept", F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame, *, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures every whole text and runs the cascade in the order that a sample of about ``sample_rows`` rows suggests.

    The sample is chosen by a hash of the text, so that it and the order are the same in every run.
    """
    n = docs.count()
    order = list(rules)
    if n:
        part = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // max(1, sample_rows)))) == 0)
        order = cascade_order(measure(part), rules)
    if text.lower() == "text":
        return apply_rules(measure(docs, text), order)
    # Rules speak of ``text``: a column of that name stands aside while another one is judged.
    aside = free_name(docs, "_text")
    measured = measure(docs.withColumnRenamed("text", aside), text).withColumn("text", F.col(text))
    judged = apply_rules(measured, order).drop("text")
    return judged.withColumnRenamed(aside, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), tri as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
), many as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from tri) where n >= 2
), rep as (
  select doc_id, count(distinct j) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as j from many) group by doc_id
), m as (
  select d.doc_id, text, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join rep using (doc_id)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines
    or word_chars < 2 * n_words or word_chars > 16 * n_words
    or 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 30 * word_chars
    or 10 * (length(text) - length(replace(text, '!', ''))) > n_words) as kept
from f
"""
