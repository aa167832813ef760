"""Operator 13: phrase collocations.

All n-grams of 1 to ``max_n`` words become rows (language, phrase, occurrences) and are aggregated by hash per language.
An n-gram cannot reach ``min_count`` if a part of it does not, so rows are made in three rounds: words, then pairs of words
that are frequent, then the longer n-grams whose every pair is. Frequent phrases are handed to the next round as a bit
filter of bounded size, built by OR in an aggregation: it may let a rare phrase pass, which its count then removes, and
never holds back a frequent one. Occurrences within about SLICE_BYTES of text are summed before a row is made, and again in
each task, so that a phrase of any frequency brings few rows to its group.

Candidates are cut at every word, the counts of both parts are joined, and scores are taken in Decimal; a phrase goes if a
one-word extension of it has enough of its occurrences (a longer phrase that has them has such an extension); ranks are taken
in two steps, so that no task holds more than the first ``top`` of every part of a language.

Defined results: a null text is empty, a null language is ``und`` and counts together with rows that say so. Texts and pieces
without words count nothing. Repeated rows count again. A language without candidates has no rows, an empty table none at
all. Ties of score and count are ordered by the phrase's bytes. Only the two columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import FILTER_BITS, Scratch, bit_filter, holds, slices, table, written
from .wordhash import _LOWER, SLICE_BYTES, grams, mix, span_hashes

MAX_N, MIN_COUNT, TOP = 4, 30, 2000
#: A phrase goes if a longer one has this share of its occurrences, in percent.
CONTAINED = 80

_SIDE = np.zeros(256, np.uint8)  # 0 in words, 1 between words, 2 between pieces
_SIDE[[9, 32]] = 1
_SIDE[[10, 11, 12, 13, *b".,;:!?"]] = 2

_COUNTS = "lang string, size int, phrase string, f long"


class Pieces:
    """The words of some texts: their spans in ``bytes`` with one space after each word, and the piece each stands in."""

    def __init__(self, texts: list[bytes]):
        low = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        side = _SIDE[low]
        edge = np.diff(np.r_[False, side == 0].view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.words = span_hashes(low, starts, ends)
        self.piece = np.cumsum(side == 2)[starts]
        first = np.cumsum(np.r_[0, [len(t) + 1 for t in texts]])
        self.text = np.searchsorted(first, starts, side="right") - 1
        low[ends] = 32
        keep = side == 0
        keep[ends] = True
        place = np.r_[0, np.cumsum(keep)]
        self.bytes, self.start, self.end = low[keep], place[starts], place[ends]

    def keys(self, n: int, lang: np.ndarray) -> np.ndarray:
        """Hash of language and n words from each word on."""
        g = grams(self.words, n)
        return mix(g ^ lang[self.text[: len(g)]])

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each word on stand in one piece."""
        return self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :]

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        begin, size = self.start[at], self.end[at + n - 1] - self.start[at]
        offsets = np.r_[0, np.cumsum(size)]
        data = self.bytes[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _language_hash(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def _sliced(b: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts) of a batch of (lang, text) in slices of about SLICE_BYTES."""
    langs = ["und" if x is None else x for x in b.column(0).to_pylist()]
    texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
    for i, j in slices([len(t) for t in texts], SLICE_BYTES):
        yield langs[i:j], texts[i:j]


def _counted(docs: DataFrame, sizes: tuple[int, ...], filters: dict) -> DataFrame:
    """(lang, size, phrase, f) of the n-grams of ``sizes`` whose parts of each size in ``filters`` all pass its filter.
    With single words comes a row of size 0 for each language that counts them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, texts in _sliced(b):
                p, names = Pieces(texts), sorted(set(langs))
                code = {x: k for k, x in enumerate(names)}
                codes = np.array([code[x] for x in langs])
                lang = np.array([_language_hash(x) for x in names], np.uint64)[codes]
                passes = {k: holds(bits.value, p.keys(k, lang)) for k, bits in filters.items() if len(p.words) >= k}
                for n in sizes:
                    if len(p.words) < n:
                        continue
                    good = p.whole(n)
                    for k, ok in passes.items():
                        for j in range(n - k + 1):
                            good &= ok[j : j + len(good)]
                    at = np.flatnonzero(good)
                    _, one, f = np.unique(p.keys(n, lang)[at], return_index=True, return_counts=True)
                    at = at[one]
                    yield _rows([names[c] for c in codes[p.text[at]]], n, p.phrases(at, n), f)
                if 1 in sizes:
                    f = np.bincount(codes[p.text], minlength=len(names))
                    yield _rows(names, 0, pa.array([""] * len(names)), f)

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _rows(langs: list[str], n: int, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.full(len(f), n, np.int32)), phrases, pa.array(f.astype(np.int64))], names=["lang", "size", "phrase", "f"])


def _filter(frequent: DataFrame, size: int):
    """A broadcast bit filter of the phrases of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, texts in _sliced(b):
                p = Pieces(texts)
                at = np.flatnonzero(np.r_[True, p.text[1:] != p.text[:-1]]) if len(p.text) else np.zeros(0, np.int64)
                key = p.keys(size, np.array([_language_hash(x) for x in langs], np.uint64))[at]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return bit_filter(frequent.where(F.col("size") == size).select("lang", "phrase").mapInArrow(run, "key long"), "key", FILTER_BITS)


def frequent_phrases(docs: DataFrame, scratch: Scratch, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of 1 to ``max_n`` words with ``min_count`` occurrences, and rows of size 0."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    enough = lambda df: df.where((F.col("f") >= min_count) | (F.col("size") == 0))
    found = scratch.written(enough(_counted(rows, (1,), {})), "words")
    for size, longer in ((1, (2,)), (2, tuple(range(3, max_n + 1)))):
        if not longer or longer[0] > max_n:
            break
        kept = _filter(found, size)
        found = found.unionByName(scratch.written(enough(_counted(rows, longer, {size: kept})), "phrases"))
    return found


def _part(words: Column, first, count) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase of two words or more, by its lowest cut."""
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), _part(F.col("w"), 1, k).alias("left"), _part(F.col("w"), k + 1, F.size("w") - k).alias("right")))
    cuts = frequent.where("size >= 2").withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(parts).alias("c")).select("lang", "phrase", "size", "a", "c.*")
    known = frequent.where("size >= 1")
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def without_contained(found: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """``found`` without the phrases of which a one-word extension has ``contained`` percent of the occurrences."""
    longer = found.where("size >= 3").withColumn("w", F.split("phrase", " "))
    inner = F.array(_part(F.col("w"), 1, F.size("w") - 1), _part(F.col("w"), 2, F.size("w") - 1))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    held = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * contained
    x, y = found.alias("x"), most.alias("y")
    return x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.phrase") == F.col("y.phrase")) & held, "left_anti")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases, as a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    frequent = frequent_phrases(docs, scratch, text=text, lang=lang, max_n=max_n, min_count=min_count)
    found = without_contained(scratch.written(scored(frequent), "scored"), contained)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = found.withColumn("part", F.pmod(F.hash("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    out = written(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with p as (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) as piece from documents)
), f as (
  select lang, size, phrase, count(*) as f from (
    select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase
    from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from p, (select unnest([1, 2, 3, 4]) as size) where len(w) >= size)
  ) group by all
), t as (
  select lang, cast(sum(f) as bigint) as n from f where size = 1 group by lang
), c as (
  select *, string_split(phrase, ' ') as w from f where size >= 2 and f >= 30
), k as (
  select lang, phrase, size, f as a, k, array_to_string(w[1:k], ' ') as lp, array_to_string(w[k + 1:size], ' ') as rp
  from (select *, unnest(range(1, size)) as k from c)
), s as (
  select k.*, x.f as l, y.f as r, cast((cast(a as hugeint) * 2000000) // (cast(x.f as hugeint) + y.f) as bigint) as score
  from k join f x on x.lang = k.lang and x.phrase = k.lp join f y on y.lang = k.lang and y.phrase = k.rp
), m as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1
), e as (
  select lang, phrase, max(f) as most from (
    select lang, f, unnest(list_distinct(flatten(list_transform(range(2, size), lambda n: list_transform(range(1, size - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))))) as phrase
    from c where size >= 3) group by all
), kept as (
  select m.* from m left join e using (lang, phrase) where most is null or cast(most as hugeint) * 100 < cast(a as hugeint) * 80
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join t using (lang) qualify rank <= 2000
"""
