"""Operator 12: grouping of spelling variants by an even-partition pigeonhole join.

Words of at least MIN_CHARS letters that occur MIN_COUNT times or more are counted over all documents. A word of length L is
cut into two even segments, its first L div 2 letters and the rest. One edit leaves a segment whole, so a word of the same
length that differs in one letter has one of the two at its own place, and a word with one letter more has the first at its
start or the second at its end, which is one place further right. Words are indexed by (length, segment's number, segment);
every word probes with its own two segments and with the two substrings that a word shorter by one could have. A pair that
both segments find is taken with the first of them, and every candidate is verified to be one edit apart before it leaves
the join: by the letters that it has, then in full. A word's form is its most frequent near word, if that is at least twice
as frequent; roots follow forms by doubling, in at most six rounds, since every step doubles the count.

Defined results: null texts, and texts without letters, have no words. Rows without a key count whole words: nothing is
deleted from their runs. Repeated rows count again. Among near words of equal count the smallest in code-point order is the
form. A word without near words has n_near 0, no form and itself as root. An empty table gives no rows. Keys may have any
type; their text is what is hashed. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, written

MIN_CHARS, MIN_COUNT = 5, 3
#: One of so many (document, run) pairs has a letter deleted.
DELETED = 97
_NO_LETTERS = "[^A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z as a-z."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_LETTERS)


def with_deletions(key: Column, run: Column) -> Column:
    """The run, less one letter if the crc32 of ``<key>:<run>`` is a multiple of DELETED."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DELETED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    runs = docs.select(F.col(key).alias("key"), F.explode(letter_runs(F.col(text))).alias("run")).where(F.char_length("run") >= min_chars)
    words = runs.select(with_deletions(F.col("key"), F.col("run")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _cuts(length: Column, word: Column, size: Column) -> list[Column]:
    """The segments of words of ``length`` at the start and the end of ``word``, which has ``size`` letters."""
    first = F.floor(length / 2).cast("int")
    return [
        F.struct(length.alias("length"), F.lit(1).alias("which"), F.substring(word, F.lit(1), first).alias("segment")),
        F.struct(length.alias("length"), F.lit(2).alias("which"), F.substring(word, size - length + first + 1, length).alias("segment")),
    ]


def _letters(word: str) -> Column:
    """The letters of a column's word as bits of a long. One edit changes two of them at most, which is cheaper to see than an edit."""
    return F.expr(f"aggregate(split({word}, ''), 0L, (m, x) -> m | shiftleft(1L, ascii(x) % 64))")


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words that are one edit apart, once; the longer word, else the larger, is b."""
    size, word = F.char_length("word"), F.col("word")
    words = words.withColumn("m", _letters("word"))
    index = words.select(F.col("word").alias("a"), F.col("n").alias("na"), "m", F.explode(F.array(*_cuts(size, word, size))).alias("s")).select("a", "na", "m", "s.*")
    probes = words.select(F.col("word").alias("b"), F.col("n").alias("nb"), "m", F.explode(F.array(*_cuts(size, word, size), *_cuts(size - 1, word, size))).alias("s")).select("b", "nb", "m", "s.*")
    i, p = index.alias("i"), probes.alias("p")
    same = (F.col("i.length") == F.col("p.length")) & (F.col("i.which") == F.col("p.which")) & (F.col("i.segment") == F.col("p.segment"))
    once = (F.char_length("p.b") > F.col("i.length")) | (F.col("i.a") < F.col("p.b"))
    half = F.floor(F.col("i.length") / 2).cast("int")
    newly = (F.col("i.which") == 1) | (F.substring("i.a", F.lit(1), half) != F.substring("p.b", F.lit(1), half))
    alike = F.bit_count(F.col("i.m").bitwiseXOR(F.col("p.m"))) <= 2
    return i.join(p, same & once & alike & newly & (F.levenshtein("i.a", "p.b", 1) == 1)).select("a", "na", "b", "nb")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"n{y}").alias("m")) for x, y in ("ab", "ba")])).alias("s")).select("s.*")
    # A word has few hundred letters' worth of near words at most, and they are combined before they move.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    met = words.join(best, "word", "left").withColumn("enough", F.coalesce(-F.col("best.m") >= 2 * F.col("n"), F.lit(False)))
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("enough"), F.col("best.other")).alias("form"), F.when(F.col("enough"), -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word that has a form."""
    hops = scratch.written(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = scratch.written(hops.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def spelling_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``, as a written table."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.written(vocabulary(docs, key=key, text=text, min_chars=min_chars, min_count=min_count), "words")
    found = scratch.written(forms(words, near_words(words)), "found")
    out = found.join(roots(found, scratch), "word", "left").withColumn("root", F.coalesce("root", "word"))
    out = written(out, "spelling-groups")
    scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), r as (
  select doc_id, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)
  group by all
), h as (
  select run, n, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: case when ord(c) < 128 then [cast(ord(c) as bigint)] else [cast(195 as bigint), cast(ord(c) - 64 as bigint)] end))),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) as h
  from r, t
), w as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n) as n from h group by 1
), v as (
  select word, cast(n as bigint) as n from w where length(word) >= 5 and n >= 3
), d as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as x from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), p as (
  select a.word as word, b.word as other, b.n as m from d a join d b on a.i = b.i and a.x = b.x and a.word <> b.word
  union select d.word, v.word, v.n from d join v on d.x = v.word
  union select v.word, d.word, d.n from d join v on d.x = v.word
), best as (
  select word, count(*) as n_near, arg_min(other, struct_pack(a := -m, b := other)) as other, max(m) as m from p group by word
), f as (
  select v.word, case when m >= 2 * n then other end as form, n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then m end as form_n from v left join best using (word)
), g(word, root) as (
  select word, word from f where form is null
  union all select f.word, g.root from g join f on f.form = g.word
)
select word, form, root, n, n_near, form_n from f join g using (word)
"""
