"""Operator 6: benchmark decontamination by winnowing.

The k-grams of words are hashed, and of every ``w`` consecutive ones the least (the rightmost of equals) is a
fingerprint. With k + w - 1 = WINDOW, two texts that share WINDOW words share a fingerprint at the same place of the
shared span. Fingerprints of the documents are joined to those of the benchmark, and a hit is extended: every window of
WINDOW words around it is held against the benchmark's windows, and the words of equal ones are marked. Items of fewer
than WINDOW words are one window each, looked up at every position.

A benchmark of at most BLOCK_BYTES of text is broadcast, and documents never move. A larger one is joined: documents emit
those of their fingerprints that pass a bit filter of the benchmark's, which has a bounded size and holds no fingerprint
back that the benchmark has; these meet the benchmark's in an equi-join; documents with a fingerprint in common are read
again, emit the windows around those places, and these meet the benchmark's windows.

Defined results: null and empty texts, and texts without words, have no words and no hits. Items without words are in
no window; several items may share a window and each counts; an item_id of several rows counts once. A benchmark row with
a null item_id marks words like any other, and has no name in ``items``; one with a null text marks nothing. Repeated rows
give repeated results. An empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, free_name, holds, table, written
from .wordhash import ALNUM, byte_slices, grams, grams_at, hash_words

WINDOW = 10
#: Words of a k-gram; WINDOW - K + 1 consecutive k-grams make a winnowing window.
K = 5
#: UTF-8 bytes of a benchmark that is broadcast: its arrays take about twice that, on the driver and in each worker.
BLOCK_BYTES = 16 << 20

_FOUND = "n_words bigint, hits array<struct<a:bigint,b:bigint>>, items array<string>"
_TYPES = (pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string()))


def winnow(h: np.ndarray, doc: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of every run of words with the same ``doc``."""
    g = grams(h, k)
    n, w = len(h) - window + 1, window - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        x = g[j : j + n]
        at = np.where(x <= least, np.arange(j, j + n), at)
        np.minimum(least, x, out=least)
    at = np.unique(at[doc[:n] == doc[window - 1 :]])
    return at, g[at]


class Windows:
    """The windows of a block of items: sorted hashes, the items of each, and the fingerprints."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.names = [name for name, _ in items]
        long_h, long_i, prints = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            h, _ = hash_words([text], ALNUM)
            if len(h) >= WINDOW:
                g = np.unique(grams(h, WINDOW))
                long_h.append(g)
                long_i.append(np.full(len(g), i))
                prints.append(winnow(h, np.zeros(len(h), np.int64))[1])
            elif len(h):
                short.setdefault(len(h), []).append((int(grams(h, len(h))[0]), i))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.sizes = {}
        if long_h:
            self.sizes[WINDOW] = self._sorted(np.concatenate(long_h), np.concatenate(long_i))
        for n, found in sorted(short.items()):
            self.sizes[n] = self._sorted(np.array([x for x, _ in found], np.uint64), np.array([i for _, i in found]))

    @staticmethod
    def _sorted(h: np.ndarray, i: np.ndarray):
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        return keys, np.r_[first, len(h)], i[order]

    def occurrences(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words of the window, positions, number of the window) for every size of window."""
        for n, (keys, _, _) in self.sizes.items():
            if len(h) < n:
                continue
            if n == WINDOW:
                at, prints = winnow(h, doc)
                at = at[_member(self.prints, prints)[0]]
                at = np.unique((at[:, None] - np.arange(WINDOW - K + 1)).ravel())
                at = at[(at >= 0) & (at <= len(h) - WINDOW)]
                at = at[doc[at] == doc[at + WINDOW - 1]]
                found, which = _member(keys, grams_at(h, at, WINDOW))
                yield n, at[found], which[found]
            else:
                found, which = _member(keys, grams(h, n))
                found &= doc[: len(found)] == doc[n - 1 :]
                at = np.flatnonzero(found)
                yield n, at, which[at]


def _member(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _marks(windows: Windows, texts: list[bytes]) -> list[tuple[int, list, list]]:
    """(words, hit intervals, items) of each text."""
    h, doc = hash_words(texts, ALNUM)
    sizes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    step = np.zeros(len(h) + 1, np.int64)
    pairs = []
    for n, at, which in windows.occurrences(h, doc):
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
        pairs += [(d, n, k) for d, k in set(zip(doc[at].tolist(), which.tolist(), strict=True))]
    hit = np.cumsum(step[:-1]) > 0
    first = np.cumsum(np.r_[0, sizes])
    opens = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (doc[1:] != doc[:-1])]) if len(h) else []
    closes = np.flatnonzero(hit & np.r_[~hit[1:] | (doc[1:] != doc[:-1]), True]) if len(h) else []
    hits: dict[int, list] = {}
    for a, b in zip(opens, closes, strict=True):
        d = int(doc[a])
        hits.setdefault(d, []).append({"a": int(a - first[d]), "b": int(b + 1 - first[d])})
    items: dict[int, set] = {}
    for d, n, k in pairs:
        _, cut, owners = windows.sizes[n]
        items.setdefault(d, set()).update(owners[cut[k] : cut[k + 1]].tolist())
    return [(int(sizes[d]), hits.get(d, []), sorted({windows.names[i] for i in items.get(d, ())} - {None})) for d in range(len(texts))]


def _small(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Windows | None:
    """The windows of a benchmark of at most ``block_bytes``; None for a larger one."""
    rows = _items(benchmark, item, text)
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    return Windows([(r.item, r.text.encode()) for r in rows.toLocalIterator()])


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs``: key, n_words, hits (disjoint intervals of words, b exclusive), items (sorted strings)."""
    windows = _small(benchmark, item, item_text, block_bytes)
    if windows is None:
        return _joined(docs, _items(benchmark, item, item_text), key, text)
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [m for _, texts in byte_slices(b.column(1)) for m in _marks(sent.value, texts)]
            arrays = [b.column(0), *(pa.array([m[i] for m in made], t) for i, t in enumerate(_TYPES))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_words", "hits", "items"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {_FOUND}")
    return found.withColumnRenamed("key", key)


def _hashes(texts: list[bytes], short: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(text, first word, hash, words) of every fingerprint (words 0) and of every gram of a short size."""
    h, doc = hash_words(texts, ALNUM)
    first = np.searchsorted(doc, np.arange(len(texts)))
    at, prints = winnow(h, doc)
    yield doc[at], at - first[doc[at]], prints, 0
    for n in short:
        g = grams(h, n)
        at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        yield doc[at], at - first[doc[at]], g[at], n


def _columns(parts, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=list(names))


def _item_rows(windows_of_items: bool):
    """(item, words, hash) of each item's windows, or of its fingerprints (words 0) and short windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            for start, texts in byte_slices(b.column(1)):
                for k, t in enumerate(texts):
                    h, _ = hash_words([t], ALNUM)
                    n = min(WINDOW, len(h))
                    if not n:
                        continue
                    full = n == WINDOW and not windows_of_items
                    found = winnow(h, np.zeros(len(h), np.int64))[1] if full else np.unique(grams(h, n))
                    size = np.full(len(found), 0 if full else n)
                    yield _columns((pa.array([names[start + k]] * len(found), pa.string()), size, found.view(np.int64)), ("item", "words", "hash"))

    return run


def _joined(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """``find_contamination`` by equi-joins. Rows are known by a digest of their key and text: equal ones have equal
    results, and a repeated task gives the same digests."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    own = F.xxhash64(F.lit(7), F.col(key).cast("string"), F.col(text)).alias("own")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(own, F.xxhash64(F.lit(8), F.col(key).cast("string"), F.col(text)).alias("also"), F.col(key).alias("key"), F.col(text).alias("text"))

    windows = scratch.written(items.mapInArrow(_item_rows(True), "item string, words bigint, hash bigint").distinct(), "windows")
    wanted = items.mapInArrow(_item_rows(False), "item string, words bigint, hash bigint").select("words", "hash").distinct()
    wanted = scratch.written(wanted, "prints")
    # At most WINDOW - 1 sizes of short items, whatever the benchmark.
    short = tuple(sorted(r[0] for r in wanted.where("words > 0").select("words").distinct().collect()))
    sent = bit_filter(wanted, "hash")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, a = (b.column(k).to_numpy() for k in range(2))
            for start, texts in byte_slices(b.column(2)):
                for doc, at, h, n in _hashes(texts, short):
                    ok = holds(sent.value, h)
                    doc, at, h = doc[ok], at[ok], h[ok]
                    yield _columns((o[start + doc], a[start + doc], at, np.full(len(at), n), h.view(np.int64)), ("own", "also", "at", "words", "hash"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = b.column(2)[k].as_py() or ""
                h, _ = hash_words([t.encode()], ALNUM)
                at = np.array(b.column(3)[k].as_py(), np.int64)
                at = np.unique((at[:, None] - np.arange(WINDOW - K + 1)).ravel())
                at = at[(at >= 0) & (at <= len(h) - WINDOW)]
                same = [np.full(len(at), b.column(i)[k].as_py(), np.int64) for i in range(2)]
                yield _columns((*same, at, np.full(len(at), WINDOW), grams_at(h, at, WINDOW).view(np.int64)), ("own", "also", "at", "words", "hash"))

    hashes = "own bigint, also bigint, at bigint, words bigint, hash bigint"
    met = rows.select("own", "also", "text").mapInArrow(emit, hashes).join(wanted, ["words", "hash"], "left_semi").distinct()
    met = scratch.written(met, "met")
    places = met.where("words = 0").groupBy("own", "also").agg(F.collect_set("at").alias("places"))
    full = rows.join(places, ["own", "also"]).select("own", "also", "text", "places").mapInArrow(around, hashes).distinct()
    hits = full.unionByName(met.where("words > 0").select("own", "also", "at", "words", "hash")).join(windows, ["words", "hash"])
    hits = scratch.written(hits.select("own", "also", "at", "words", "item"), "hits")
    spans = hits.select("own", "also", F.struct(F.col("at").alias("a"), (F.col("at") + F.col("words")).alias("b")).alias("x")).distinct()
    spans = spans.groupBy("own", "also").agg(F.sort_array(F.collect_list("x")).alias("hits"))
    names = hits.select("own", "also", "item").where("item is not null").distinct().groupBy("own", "also").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [x for _, texts in byte_slices(b.column(3)) for x in np.bincount(hash_words(texts, ALNUM)[1], minlength=len(texts)).tolist()]
            yield _columns((b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())), ("own", "also", "key", "n_words"))

    out = rows.mapInArrow(
        lambda batches: counted(b.select(["own", "also", "key", "text"]) for b in batches), f"own bigint, also bigint, key {kind}, n_words bigint"
    )
    out = out.join(spans, ["own", "also"], "left").join(names, ["own", "also"], "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    out = out.select(F.col("key").alias(key), "n_words", F.coalesce(_disjoint(F.col("hits")), none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = written(out, "contamination")
    scratch.drop()
    return out


def _disjoint(hits: Column) -> Column:
    """Sorted intervals without their overlaps: each starts where the ones before it have ended, and empty ones go."""
    back = WINDOW * WINDOW

    def upto(i):
        before = F.slice(hits, F.greatest(F.lit(1), i - back + 1), F.least(i, F.lit(back)))
        return F.coalesce(F.array_max(F.transform(before, lambda x: x["b"])), F.lit(0).cast("long"))

    # Intervals have at most WINDOW words and WINDOW sizes, so those that reach past a start are among the last WINDOW^2.
    cut = F.transform(hits, lambda x, i: F.struct(F.greatest(x["a"], upto(i)).alias("a"), x["b"].alias("b")))
    return F.filter(cut, lambda x: x["a"] < x["b"])


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark: one pass, or an anti-join if the benchmark is large."""
    windows = _small(benchmark, item, item_text, block_bytes)
    if windows is not None:
        return _clean(docs, text, docs.sparkSession.sparkContext.broadcast(windows))
    own = free_name(docs, "_own")
    marked = docs.withColumn(own, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = _joined(marked.select(own, text), _items(benchmark, item, item_text), own, text)
    hit = found.where(F.size("hits") > 0).select(own).distinct()
    return marked.join(hit, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _clean(docs: DataFrame, text: str, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            yield b.filter(pa.array([not hits for _, texts in byte_slices(column) for _, hits, _ in _marks(sent.value, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select *, least(len(w), 10) as n from b where len(w) > 0))
), sizes as (
  select distinct n from bw
), dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), m as (
  select dw.doc_id, dw.n, dw.i, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g
), hit as (
  select doc_id, count(distinct j) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from m) group by doc_id
), it as (
  select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as xs from (select distinct doc_id, item_id::varchar as x from m) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(xs, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
