"""Model calls as injected functions over columns, each with a schema, a guard in code and an offline stand-in.

A model is any function of a pandas Series of prompts to one of replies; it runs in Arrow batches on the executors. A
reply is parsed tolerantly, asked for once more if it does not parse, read by the call's schema and held by its guard.
Where no model is given, or no reply can be read, the stand-in's value is taken: a built-in expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import text as tx
from ..functions.citations import citation_ids
from ..sources import views
from .reports import tolerant_json

Model = Callable[[pd.Series], pd.Series]
#: What a second request says to a model whose first reply could not be read.
REPAIR = "\n\nReturn one JSON object and nothing else."


@dataclass(frozen=True)
class Call:
    """``guard`` takes the parsed struct and gives the value that is used; ``offline`` stands in for it."""

    name: str
    schema: str
    guard: Callable[[Column], Column]
    offline: Callable[[], Column]


def replies(prompts: pd.Series, model: Model) -> pd.Series:
    """Readable JSON of each prompt, or None: one repair for those that failed, failures of the model are no replies."""

    def ask(p: pd.Series) -> pd.Series:
        try:
            return model(p).map(lambda r: tolerant_json(None if pd.isna(r) else str(r)))
        except Exception:  # a model that fails degrades its batch, never the job
            return pd.Series([None] * len(p), index=p.index, dtype=object)

    out = ask(prompts)
    bad = out.isna()
    if bad.any():
        out = out.astype(object).where(~bad, ask(prompts[bad] + REPAIR).reindex(out.index))
    return out


def answered(rows: DataFrame, call: Call, prompt: Column, model: Model | None = None) -> DataFrame:
    """``rows`` plus a column of the call's name and ``<name>_by``: who gave the value, model or stand-in."""
    if model is None:
        return rows.withColumns({call.name: call.offline(), f"{call.name}_by": F.lit("stand-in")})

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return replies(p.fillna(""), model)

    read = F.from_json(run(prompt), call.schema)
    made = rows.withColumn("_reply", read)
    value = F.when(F.col("_reply").isNotNull(), call.guard(F.col("_reply")))
    return made.withColumns({call.name: F.coalesce(value, call.offline()), f"{call.name}_by": F.when(value.isNotNull(), "model").otherwise("stand-in")}).drop("_reply")


def relevance(question: Column, text: Column) -> Column:
    """Ten times the share of the question's words that the text holds, rounded half to even."""
    return F.least(F.lit(10), F.bround(10 * tx.overlap(question, text)).cast("int"))


def triage(question: Column, text: Column) -> Call:
    """Whether a candidate is read: without a model, if it shares a word with the question."""
    return Call("read", "keep boolean", lambda r: r["keep"], lambda: tx.overlap(question, text) > 0)


def notes(question: Column, text: Column) -> Call:
    """The relevance of a page: clamped to 0 to 10, percentages rescued."""
    return Call("relevance", "relevance string", lambda r: tx.score_10(r["relevance"]), lambda: relevance(question, text))


def rerank(question: Column, text: Column) -> Call:
    return Call("second", "score double", lambda r: r["score"], lambda: tx.overlap(question, text))


def verdict(claim: Column, evidence: Column, enough: float = 0.8) -> Call:
    """A claim against a passage: without a model supported if the passage holds most of its terms, else unverifiable."""
    held = tx.let(tx.claim_terms(claim), lambda c: F.when(F.size(c) > 0, F.size(F.array_intersect(c, tx.claim_terms(evidence))) / F.size(c)).otherwise(F.lit(0.0)))
    return Call(
        "verdict",
        "verdict string, quote string",
        lambda r: F.when((coerce.enum(r["verdict"], ("supported", "contested", "unsupported", "unverifiable"), "unverifiable") == "unsupported") & ~F.coalesce(tx.quote_is_verbatim(r["quote"], evidence), F.lit(False)), "unverifiable").otherwise(
            coerce.enum(r["verdict"], ("supported", "contested", "unsupported", "unverifiable"), "unverifiable")
        ),
        lambda: F.when(held >= enough, "supported").otherwise("unverifiable"),
    )


def accepted_rewrite(before: Column, after: Column, least: float = 0.95) -> Column:
    """A rewritten report is taken if it loses no citation and not more than a twentieth of its length; else the old one."""
    lost = F.size(F.array_except(citation_ids(before), citation_ids(after)))
    return F.when((lost == 0) & (F.length(after) >= least * F.length(before)), after).otherwise(before)


def kept_items(ids: Column, most: int) -> Column:
    """Drop lists of a filtering model: numbers within 1 to ``most``, once each; null keeps all."""
    return F.coalesce(F.array_distinct(F.filter(coerce.id_list(ids, most), lambda k: k.between(1, most))), F.array().cast("array<int>"))


ASK = "there then thing ation hereth 42 percent"


def _docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text")


def _said(p: pd.Series) -> pd.Series:
    """A model for the registered query: JSON in fences, percentages, junk and no JSON at all, by the prompt's length."""
    return p.str.len().map(lambda n: [f"<think>x</think>```json\n{{\"relevance\": \"{n % 100}\"}}\n```", "no idea", f"{{\"relevance\": {n % 12},}}"][n % 3])


_Q = "list_distinct(list_filter(regexp_extract_all('" + ASK + "', '[a-z0-9]+'), lambda t: length(t) >= 3))"
_SHARE = f"len(list_filter({_Q}, lambda t: list_contains({tx._TOK}, t))) / len({_Q})"
QUERIES = {
    "kept_items": (
        lambda s, d: views.table(s, d, "events").select("event_id", F.array_join(kept_items(F.array(*[F.expr(e).cast("string") for e in ("event_id % 7", "event_id % 11 - 2", "event_id % 7", "event_id % 23", "'x'")]), 9), ",").alias("kept")),
        """with a as (select event_id, list_filter([event_id % 7, abs(event_id % 11 - 2), event_id % 7, event_id % 23], lambda x: x between 1 and 9) as a from events)
        select event_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') as kept from a""",
    ),
    "model_stand_ins": (
        lambda s, d: answered(answered(_docs(s, d), triage(F.lit(ASK), F.col("text")), F.col("text")), notes(F.lit(ASK), F.col("text")), F.col("text")).select("doc_id", "read", "read_by", "relevance"),
        f"with s as (select doc_id, {_SHARE} as s from documents) select doc_id, s > 0 as read, 'stand-in' as read_by, cast(least(10, round_even(10 * s, 0)) as int) as relevance from s",
    ),
    "model_replies": (
        lambda s, d: answered(_docs(s, d), notes(F.lit(ASK), F.col("text")), F.col("text"), _said).select("doc_id", "relevance", "relevance_by"),
        f"""with s as (select doc_id, length(text) as n, length(text) + {len(REPAIR)} as m, {_SHARE} as s from documents), k as (select *, case when n % 3 = 1 then m else n end as l from s)
        select doc_id, cast(case l % 3 when 0 then least(10, case when l % 100 > 10 then floor(l % 100 / 10) else l % 100 end) when 2 then case when l % 12 > 10 then floor(l % 12 / 10) else l % 12 end else least(10, round_even(10 * s, 0)) end as int) as relevance,
          case when l % 3 = 1 then 'stand-in' else 'model' end as relevance_by from k""",
    ),
    "accepted_rewrites": (
        lambda s, d: _docs(s, d).select("doc_id", F.length(accepted_rewrite(F.concat(F.lit("a [1, 2] "), "text"), F.expr("case doc_id % 3 when 0 then concat('b [2] [1] ', text) when 1 then concat('b [1] ', text) else 'b [1,2]' end"))).alias("n")),
        "select doc_id, cast(case when doc_id % 3 = 0 then 10 + length(text) when doc_id % 3 = 2 and 7 >= 0.95 * (9 + length(text)) then 7 else 9 + length(text) end as int) as n from documents",
    ),
}
