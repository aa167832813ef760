"""Citations of a finished report held against what its sources state, and the report with the fixes made.

A model's word on a sentence is one of keep, recite and rewrite; code decides whether it is followed. Sentences cite other
sources only if every figure in them is stated there, and are rewritten only if every figure of the new sentence, with its
unit, is stated by a source it cites. All edits of a report are made in one pass. Names are present if they stand in a
source whatever their punctuation; a longer name is not taken for a shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.citations import citation_ids
from ..functions.markdown import edited, keep_frame, with_citations
from ..functions.text import let
from ..sources import views
from .figures import VERSION, claim_tokens, evidence_numbers, folded

#: A corrected sentence has this share of the old one's length.
SHORTEST, LONGEST = 0.4, 1.6
REPLY = "action string, cite array<string>, revised string, reason string"
_OTHER = r"\d+(?:\.\d+)?"


def evidence(text: Column) -> Column:
    """What a source's text states: numbers with their roundings, versions, the folded text, and the text for units."""
    text = F.coalesce(text, F.lit(""))
    flat = F.replace(F.lower(F.replace(text, F.lit(","), F.lit(""))), F.lit("×"), F.lit("x"))
    return F.struct(evidence_numbers(text).alias("numbers"), F.regexp_extract_all(text, F.lit(VERSION), F.lit(0)).alias("versions"), folded(text).alias("names"), flat.alias("flat"))


def has(source: Column, token: Column) -> Column:
    """Whether ``evidence`` has a claim's token (kind, key, unit), whatever the unit."""
    of = token["kind"]
    return F.when(of == "num", F.array_contains(source["numbers"], token["key"])).when(of == "ver", F.array_contains(source["versions"], token["key"])).otherwise(source["names"].contains(token["key"]))


def states(source: Column, token: Column) -> Column:
    """``has``, and a number that has a unit stands with it, alone or at an end of a range."""
    n = F.concat(F.replace(token["key"], F.lit("."), F.lit("\\.")), F.lit(r"(?:\.0+)?"))
    u = token["unit"]
    alone = F.concat(F.lit(r"(?<![\d.])"), n, F.lit(rf"\s?(?:[-–]\s?{_OTHER}\s?)?"), u, F.lit("(?![a-z])"))
    ranged = F.concat(F.lit(rf"(?<![\d.]){_OTHER}\s?[-–]\s?"), n, F.lit(r"\s?"), u, F.lit("(?![a-z])"))
    with_unit = F.regexp_like(source["flat"], F.concat(alone, F.lit("|"), ranged))
    return has(source, token) & ((token["kind"] != "num") | (u == "") | with_unit)


def unsupported(tokens: Column, ids: Column, sources: Column, question: Column, strict: bool = False) -> Column:
    """Tokens that neither the question nor any of the sources ``ids`` (of a map of ``evidence`` by id) has, or states."""
    own = F.filter(F.transform(ids, lambda i: F.try_element_at(sources, i)), lambda s: s.isNotNull())
    said = states if strict else has
    return let(own, lambda o: F.filter(tokens, lambda t: ~has(question, t) & ~F.exists(o, lambda s: said(s, t))))


def read_reply(reply: Column) -> Column:
    """(action, cite, revised) of a reply of schema REPLY; what it does not say is keep, no ids, no text."""
    action = coerce.enum(reply["action"], ("keep", "recite", "rewrite"), "keep")
    cite = F.coalesce(coerce.id_list(reply["cite"], 8), F.array().cast("array<int>"))
    return F.struct(action.alias("action"), cite.alias("cite"), F.trim(F.regexp_replace(F.substring(F.coalesce(reply["revised"], F.lit("")), 1, 2000), r"\s+", " ")).alias("revised"))


def decision(sentence: Column, reply: Column, allowed: Column, sources: Column, question: Column) -> Column:
    """(outcome, text): kept, recited, rewritten or rejected, and the sentence that stands then.

    ``reply`` is as of ``read_reply``, ``allowed`` the ids that it may cite, ``sources`` a map of ``evidence`` by id and
    ``question`` the evidence of the question itself, whose figures need no source.
    """
    ids, tokens = F.array_distinct(citation_ids(sentence)), claim_tokens(sentence)
    out = lambda name, text=None: F.struct(F.lit(name).alias("outcome"), (sentence if text is None else text).alias("text"))
    named = F.filter(F.array_distinct(reply["cite"]), lambda i: F.array_contains(allowed, i))

    def recited(ids: Column, new: Column) -> Column:
        both = F.concat(new, F.array_except(ids, new))
        fits = lambda k: F.size(unsupported(tokens, k, sources, question)) == 0
        same = (F.size(F.array_except(ids, new)) == 0) & (F.size(F.array_except(new, ids)) == 0)
        return (
            F.when(F.size(new) == 0, out("rejected")).when(same, out("kept")).when(fits(new), out("recited", with_citations(sentence, new)))
            .when(fits(both), out("recited", with_citations(sentence, both))).otherwise(out("rejected"))
        )

    def rewritten(new: Column) -> Column:
        cited = F.array_distinct(citation_ids(new))
        size = F.length(new) / F.greatest(F.lit(1), F.length(sentence))
        bad = (F.size(cited) == 0) | (F.size(F.array_except(cited, allowed)) > 0) | (F.size(unsupported(claim_tokens(new), cited, sources, question, strict=True)) > 0)
        return F.when((new == "") | (new == sentence), out("kept")).when(~size.between(SHORTEST, LONGEST) | bad, out("rejected")).otherwise(out("rewritten", keep_frame(sentence, new)))

    moved = let(ids, lambda i: let(named, lambda new: recited(i, new)))
    return F.when(reply["action"] == "recite", moved).when(reply["action"] == "rewrite", let(reply["revised"], rewritten)).otherwise(out("kept"))


def corrected(reports: DataFrame, decided: DataFrame, key: str, md: str = "md") -> DataFrame:
    """``reports`` with the sentences of ``decided`` (key, start, end, outcome, text) that changed put in their places, and the
    number of each outcome. A report's sentences are a bounded group."""
    new = F.struct("start", "end", F.col("text").alias("new"))
    changes = F.col("outcome").isin("recited", "rewritten")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "recited", "rewritten", "rejected")]
    own = decided.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.when(changes, new)).alias("_edits"), *counts)
    met = reports.join(own, reports[key] == own["_key"], "left")
    text = F.when(F.size("_edits") > 0, edited(F.col(md), F.col("_edits"))).otherwise(F.col(md))
    return met.select(*[text.alias(c) if c == md else F.col(c) for c in reports.columns], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "recited", "rewritten", "rejected")])


_CLAIM = "- **Room:** it has 48213.5GB, says the maker [1]."


def _decided(spark, d):
    """Documents as reports that end with a claim which no source of theirs states, and one reply of each kind."""
    x = views.table(spark, d, "documents").where("text is not null").withColumn("md", F.concat(F.col("text"), F.lit("\n" + _CLAIM + "\ntail")))
    said = lambda more: evidence(F.concat(F.col("text"), F.lit(more)))
    sources = F.create_map(F.lit(1), said(""), F.lit(2), said(" It holds 48,213.5 GB."), F.lit(3), said(" It took 48213.5 days."))
    k = F.col("doc_id") % 7
    reply = F.struct(
        F.when(k == 0, "keep").when(k < 4, "Recite ").when(k < 6, "rewrite").otherwise("junk").alias("action"),
        F.when(k == 1, F.array(F.lit("[2]"))).when(k == 2, F.array(F.lit("9"))).when(k == 3, F.array(F.lit("3"))).alias("cite"),
        F.when(k == 4, "Its room is 48213.5GB or so, says the maker [3].").when(k == 5, "Its room is 48213.5GB,  says the maker [2].").alias("revised"),
    )
    made = x.withColumn("x", decision(F.lit(_CLAIM), read_reply(reply), F.array(F.lit(1), F.lit(2), F.lit(3)), sources, evidence(F.lit("how much?"))))
    at = F.length("text") + 1
    return x.select("doc_id", "md"), made.select("doc_id", at.alias("start"), (at + len(_CLAIM)).alias("end"), "x.outcome", "x.text")


QUERIES = {
    "corrected_reports": (
        lambda s, d: corrected(*_decided(s, d), "doc_id").select("doc_id", F.md5("md").alias("digest"), "kept", "recited", "rewritten", "rejected"),
        """with k as (select doc_id, text, doc_id % 7 as k from documents where text is not null)
        select doc_id, md5(text || chr(10) || '- **Room:** ' || case when k = 5 then 'Its room is 48213.5GB, says the maker [2].' else 'it has 48213.5GB, says the maker [' || case k when 1 then 2 when 3 then 3 else 1 end || '].' end || chr(10) || 'tail') as digest,
          cast(k in (0, 6) as bigint) as kept, cast(k in (1, 3) as bigint) as recited, cast(k = 5 as bigint) as rewritten, cast(k in (2, 4) as bigint) as rejected from k""",
    ),
}
