"""What a round reads and asks: fetch candidates under every cap with what was held back, and the facets of a question.

A round is the results of one set of queries, a few hundred at most, and is decided in arrival order: a result that one cap
refuses must not use up another. Rounds are independent, so they are dealt to tasks by their key.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import facet_words, let
from ..sources import views
from .reports import facet_name

LIMIT, PER_SOURCE, FACETS = 12, 2, 14
TAKEN, HELD, REFUSED = "taken", "held back", "refused"


def fetch_candidates(
    rows: DataFrame, seen: DataFrame | None = None, *, round_: str = "round", limit: int = LIMIT, per_source: int = PER_SOURCE, per_engine: int | None = None, uncapped: tuple[str, ...] = (), trial: tuple[str, ...] = (), trial_slots: int = 0
) -> DataFrame:
    """Every row (round, pos, url, engine) that is not of a ``seen`` url, with its canonical url, source, status and place.

    Optional columns: ``group`` is what counts as one source instead of the url's own, ``cap`` a source's cap instead of
    ``per_source``. Hosts at or below ``uncapped`` ignore the cap of their source. ``trial`` engines get up to
    ``trial_slots`` rows of a round first. A row is taken (with its place from 0), held back by its engine's cap, or refused;
    what comes after a round is full has no status. ``skips`` is how often its engine was held back in the round.
    """
    own = urls.source_key(F.col("url"))
    host = urls.domain_of(F.col("url"))
    ready = rows.select(
        F.col(round_).alias("round"), "pos", "url", F.lower(F.trim(F.coalesce("engine", F.lit("")))).alias("engine"), urls.canonicalize(F.col("url")).alias("canonical"),
        (F.coalesce("group", own) if "group" in rows.columns else own).alias("source"), (F.coalesce("cap", F.lit(per_source)) if "cap" in rows.columns else F.lit(per_source)).cast("int").alias("cap"),
        F.coalesce(urls.under(host, uncapped) if uncapped else F.lit(False), F.lit(False)).alias("free"),
    )
    if seen is not None:
        ready = ready.join(seen.select(urls.canonicalize(F.col("url")).alias("canonical")).distinct(), "canonical", "left_anti").select(*ready.columns)
    names = ready.columns

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "url"]).reset_index(drop=True)
        taken: set[str] = set()
        of_source, of_engine, skips = Counter(), Counter(), Counter()
        status: list[str | None] = [None] * len(pdf)
        place: dict[int, int] = {}

        def admit(k: int, r) -> None:
            if r.canonical in taken or (of_source[r.source] >= r.cap and not r.free):
                status[k] = status[k] or REFUSED
            elif per_engine is not None and r.engine and of_engine[r.engine] >= per_engine:
                skips[r.engine] += 1
                status[k] = HELD
            else:
                taken.add(r.canonical)
                of_source[r.source] += 1
                of_engine[r.engine] += 1
                status[k], place[k] = TAKEN, len(place)

        all_ = list(enumerate(pdf.itertuples(index=False)))
        room = min(trial_slots, per_engine) if per_engine else trial_slots
        for k, r in all_ if trial and room > 0 else ():
            if len(place) < limit and r.engine in trial and of_engine[r.engine] < room:
                admit(k, r)
        for k, r in all_:
            if len(place) < limit and k not in place:
                admit(k, r)
        return pdf[["round", "pos", "url", "engine", "canonical", "source"]].assign(status=status, place=[place.get(k) for k in range(len(pdf))], skips=[skips[e] for e in pdf.engine]).astype({"place": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names if n not in ("cap", "free")) + ", status string, place long, skips long"
    return ready.groupBy("round").applyInPandas(pick, schema)


def clean_facets(names: Column, most: int = FACETS) -> Column:
    """Facets' keys in order, without blanks and repeats, ``most`` of them."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: facet_name(n)), lambda n: n.isNotNull() & (n != ""))), 1, most)


def merged_facets(asked: Column, planned: Column, most: int = FACETS) -> Column:
    """The question's own facets, then the planned ones that are not one of those before them again.

    Two facets are one if they share two content words, or one that fewer than three facets have where either has at most two;
    facets without content words are one if they are equal.
    """
    own, more = clean_facets(asked, most), clean_facets(planned, most)
    row = lambda n: F.struct(n.alias("n"), facet_words(n).alias("w"))

    def same(a: Column, b: Column, common: Column) -> Column:
        few = F.least(F.size(a["w"]), F.size(b["w"]))
        shared = lambda s: (F.size(s) >= 2) | ((few <= 2) & (F.size(F.array_except(s, common)) > 0))
        return F.when(few == 0, a["n"] == b["n"]).otherwise(let(F.array_intersect(a["w"], b["w"]), shared))

    def folded(x: Column) -> Column:
        words = F.flatten(F.transform(F.concat(x["own"], x["more"]), lambda r: r["w"]))
        common = let(words, lambda w: F.filter(F.array_distinct(w), lambda v: F.size(F.filter(w, lambda y: y == v)) >= 3))
        return let(common, lambda c: F.aggregate(x["more"], x["own"], lambda out, m: F.when(F.exists(out, lambda e: same(m, e, c)), out).otherwise(F.concat(out, F.array(m)))))

    both = F.struct(F.transform(own, row).alias("own"), F.transform(more, row).alias("more"))
    return F.slice(F.transform(let(both, folded), lambda r: r["n"]), 1, most)


def _rounds(spark, d):
    """Every page as a result, in rounds of 60 with the query's engines; a third of the sources have earned a higher cap."""
    p = views.table(spark, d, "pages")
    return p.select(F.floor(F.col("page_id") / 60).alias("round"), (F.col("page_id") * 7 % 60).alias("pos"), "url", F.concat(F.lit("E"), F.col("page_id") % 4).alias("engine"), F.when(F.length(urls.domain_of(F.col("url"))) % 3 == 0, 4).alias("cap"))


def _seen(spark, d):
    return views.table(spark, d, "pages").where("page_id % 9 = 4").select("url")


def _facet_lists(spark, d):
    """The first words of a document's lines as facets: those of its first half asked, the others planned."""
    lines = F.transform(F.split("text", "[.\n]"), lambda x: F.array_join(F.slice(F.array_remove(F.split(F.trim(x), " "), ""), 1, 3), " "))
    x = views.table(spark, d, "documents").where("text is not null").select("doc_id", F.slice(lines, 1, 24).alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    return x.select("doc_id", F.slice("l", F.lit(1), half).alias("asked"), F.slice("l", half + 1, F.size("l") - half).alias("planned"))


QUERIES = {
    "fetch_candidates": (lambda s, d: fetch_candidates(_rounds(s, d), _seen(s, d), per_engine=4, uncapped=("example.org",), trial=("e3",), trial_slots=2).select("round", "pos", "source", "status", "place", "skips"), None),
    "merged_facets": (lambda s, d: _facet_lists(s, d).select("doc_id", F.array_join(merged_facets(F.col("asked"), F.col("planned")), "|").alias("facets")), None),
}
