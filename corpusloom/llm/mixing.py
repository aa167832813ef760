"""Operator 9: mixing sources to target weights by soft membership (DataFrame functions only).

A naive-Bayes classifier is fitted on the labelled table: the share of a domain's labelled documents that hold a word,
for the VOCABULARY words whose shares differ most between domains. Every document then gets posteriors over the
domains from the vocabulary words in its whole text. Projected-gradient least squares finds nonnegative document rates
for which the expected tokens of each domain, sum(rate * tokens * posterior), match the targets: each step is one
aggregate over a narrow table, and only one number per domain comes to the driver.

With G the matrix of sum(tokens * posterior_d * posterior_e) and C its row sums, the step is the gradient of
sum((S - T)^2 / C) in sqrt(tokens) * rate; C bounds G's eigenvalues, so steps of up to 2 converge.

The labelled sample is at most SAMPLE rows of each domain (a documented bound); counts, posteriors and rates cover all
rows. Defined results: null and empty texts have no tokens and the prior as posterior. A null domain is no label.
Domains without a target have the target 0, targets without labelled rows are left out and the others rescaled. With
no labels at all every rate is 1. Repeated rows get equal rates. Of tied posteriors the first domain by name is named;
rates use all of them. Other columns are kept; n_tokens, domain, posterior, rate and gap are replaced, whatever their case.
Targets that no rates meet, or that ROUNDS steps do not reach, show in gap.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, table, without, words_of, written

#: Labelled rows of one domain that are used at most, words of the model, and buckets of its weight tables.
SAMPLE, VOCABULARY, BUCKETS = 1024, 256, 4096
#: Target shares of the query's domains, which are the languages of the labelled documents.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
STEP, TOLERANCE, ROUNDS, CUT = 1.5, 1e-6, 100, 10


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def _votes(at: Column, base: float, weights: Column) -> Column:
    return F.aggregate(at, F.lit(base), lambda s, i: s + F.get(weights, i))


def _first_of_each(rows: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """At most ``sample`` rows (_id, domain) of each domain, those of least hash.

    Rows of large domains are thinned by their hash to about twice the sample before any window sees them.
    """
    spark = rows.sparkSession
    span = 1 << 30
    bounds = spark.createDataFrame([(d, min(span, -(-2 * sample * span // n) + span // 1000)) for d, n in sizes.items()], "_of string, _bound long")
    place = F.pmod(F.xxhash64("_id"), F.lit(span))
    thin = rows.join(F.broadcast(bounds), F.col("domain") == F.col("_of")).where(place < F.col("_bound"))
    order = W.partitionBy("domain").orderBy(place, "_id")
    return thin.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample).select("_id", "domain")


def fit(docs: DataFrame, labelled: DataFrame, *, key: str, text: str, domain: str, sample: int = SAMPLE) -> dict:
    """Domains, their logarithmic priors, and per domain the weight of each vocabulary word.

    The model's size is the number of domains times VOCABULARY, whatever the number of rows.
    """
    rows = labelled.select(F.col(key).alias("_id"), F.col(domain).cast("string").alias("domain")).where("_id is not null and domain is not null").distinct()
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return {"domains": [], "prior": [], "base": [], "words": {}}
    chosen = _first_of_each(rows, sizes, sample)
    held = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    held = held.select("domain", F.array_distinct(words_of(F.col("_text"))).alias("words"))
    held = written(held, "labelled-words")
    n = {r[0]: r[1] for r in held.groupBy("domain").count().collect()}
    seen = held.select("domain", F.explode("words").alias("word")).groupBy("word", "domain").count()
    seen = seen.withColumn("share", F.col("count") / F.get(_literal({d: float(max(1, n.get(d, 0))) for d in domains}.values()), F.array_position(_literal(domains, "string"), F.col("domain")).cast("int") - 1))
    spread = seen.groupBy("word").agg(F.max("share").alias("most"), F.min("share").alias("least"), F.count(F.lit(1)).alias("in_domains"), F.map_from_entries(F.collect_list(F.struct("domain", "count"))).alias("counts"))
    spread = spread.withColumn("gap", F.col("most") - F.when(F.col("in_domains") < len(domains), F.lit(0.0)).otherwise(F.col("least")))
    top = spread.orderBy(F.desc("gap"), "word").limit(VOCABULARY).withColumn("bucket", _bucket(F.col("word"))).collect()
    words: dict[str, list[float]] = {}
    buckets: dict[int, str] = {}
    base = [0.0] * len(domains)
    for r in top:
        if r.bucket in buckets:  # the more telling word has the bucket
            continue
        buckets[r.bucket] = r.word
        p = [(r.counts.get(d, 0) + 1) / (n.get(d, 0) + 2) for d in domains]
        words[r.word] = [math.log(x / (1 - x)) for x in p] + [r.bucket]
        base = [b + math.log(1 - x) for b, x in zip(base, p, strict=True)]
    total = sum(sizes.values())
    prior = [math.log(sizes[d] / total) for d in domains]
    return {"domains": domains, "prior": prior, "base": base, "words": words}


def _literal(values, kind: str = "double") -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def posteriors(docs: DataFrame, model: dict, *, text: str) -> DataFrame:
    """``docs`` plus n_tokens (words) and posterior (array of a share per domain); columns of these names are replaced."""
    docs = without(docs, *({"n_tokens", "posterior"} - {text.lower()}))
    found = free_name(docs, "_found")
    vocabulary = _literal(model["words"], "string")
    number = [-1] * BUCKETS
    for k, w in enumerate(model["words"].values()):
        number[w[-1]] = k
    at = lambda w: F.transform(F.array_intersect(w, vocabulary), lambda x: F.get(_literal(number, "int"), _bucket(x).cast("int")))
    weights = [_literal(w[k] for w in model["words"].values()) for k in range(len(model["domains"]))]

    def scores(m):
        return F.array(
            *[
                F.lit(prior) + F.when(m["n"] > 0, _votes(m["at"], base, w)).otherwise(F.lit(0.0))
                for prior, base, w in zip(model["prior"], model["base"], weights, strict=True)
            ]
        )

    # Each step binds its value to a lambda's variable, so that it is computed once and no column needs a name.
    whole = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    shares = lambda s: F.transform(F.array(F.transform(s, lambda x: F.exp(x - F.array_max(s)))), whole)[0]
    measured = F.transform(F.array(words_of(F.col(text))), lambda w: F.struct(F.size(w).cast("long").alias("n"), at(w).alias("at")))[0]
    made = F.transform(F.array(measured), lambda m: F.struct(m["n"].alias("n"), F.transform(F.array(scores(m)), shares)[0].alias("p")))[0]
    return docs.withColumn(found, made).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{found}.n").alias("n_tokens"), F.col(f"{found}.p").alias("posterior"))


def rates(scored: DataFrame, domains: list[str], targets: dict[str, float]) -> DataFrame:
    """``scored`` (a written table) plus rate, so that expected tokens per domain match the targets' shares of all tokens, and
    gap, the same in every row: the most by which a domain's expected total misses its target, as a share of the target (of a
    thousandth of all tokens, if that is more). It is at most TOLERANCE unless ROUNDS steps did not reach the targets or no
    rates can, as for a target without documents; rates have no upper bound.
    """
    p = [F.get(F.col("posterior"), F.lit(k)) for k in range(len(domains))]
    t = F.col("n_tokens").cast("double")
    mass = [x or 0.0 for x in scored.agg(*[F.sum(t * x) for x in p]).first()]
    known = {d: targets.get(d, 0.0) for d in domains}
    whole = sum(known.values())
    if whole <= 0 or not sum(mass):
        return scored.select("*", F.lit(1.0).alias("rate"), F.lit(None).cast("double").alias("gap"))
    wanted = [sum(mass) * known[d] / whole for d in domains]
    rate, now, held = F.lit(1.0), scored, free_name(scored, "_rate")
    total = mass
    missed = lambda: max(abs(s - w) / max(w, 1e-3 * sum(mass)) for s, w in zip(total, wanted, strict=True))
    for k in range(ROUNDS):
        gap = [(s - w) / c if c > 0 else 0.0 for s, w, c in zip(total, wanted, mass, strict=True)]
        if missed() <= TOLERANCE:
            break
        slope = F.lit(0.0)
        for x, g in zip(p, gap, strict=True):
            slope = slope + x * F.lit(STEP * g)
        rate = F.greatest(F.lit(0.0), rate - slope)
        if k % CUT == CUT - 1:  # keeps the expression short
            now = written(now.withColumn(held, rate), "rates")
            rate = F.col(held)
        total = [x or 0.0 for x in now.agg(*[F.sum(rate * t * x) for x in p]).first()]
    return now.select(*[F.col(f"`{c}`") for c in scored.columns], rate.alias("rate"), F.lit(missed()).alias("gap"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, key: str = "doc_id", text: str = "text", domain: str = "lang") -> DataFrame:
    """Every column of ``docs`` but the text, plus n_tokens, domain (the likeliest), posterior of it, rate and gap as of ``rates``."""
    model = fit(docs, labelled, key=key, text=text, domain=domain)
    kept = [F.col(f"`{c}`") for c in without(docs, text, "n_tokens", "posterior", "rate", "gap", "domain").columns]
    if not model["domains"]:
        n = F.size(words_of(F.col(text))).cast("long")
        none = F.lit(None)
        return docs.select(*kept, n.alias("n_tokens"), none.cast("string").alias("domain"), none.cast("double").alias("posterior"), F.lit(1.0).alias("rate"), none.cast("double").alias("gap"))
    scored = written(posteriors(docs.select(*kept, text), model, text=text).drop(text), "posteriors")
    out = rates(scored, model["domains"], targets)
    best = F.array_max("posterior")
    likeliest = F.get(_literal(model["domains"], "string"), F.array_position("posterior", best).cast("int") - 1)
    return out.select(*kept, "n_tokens", likeliest.alias("domain"), best.alias("posterior"), "rate", "gap")


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query: documents that carry labels, with their language as domain."""
    return docs.select("doc_id", "lang").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels"))
    return mix(docs.drop("lang"), labelled, TARGETS)


SQL = None  # the rates are the limit of an iteration; tests hold expected totals and posteriors against numpy
