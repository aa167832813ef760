"""Near-duplicates by MinHash signatures in bands: the approximate way, for corpora whose whole sets are too much to join.

``dedup.near_pairs`` is exact and joins shingles; here a document is a signature of BANDS * ROWS minima. Two documents with
Jaccard similarity j meet in a band with probability 1 - (1 - j ** ROWS) ** BANDS: more bands find more, more rows bring
fewer strangers together. Copies are one class before anything is joined. Of a band's bucket the least document is compared
with all others by signature. Whom that connects has one label; where a bucket has several labels left, its documents of
different labels are compared with each other in blocks, until each two that meet in a band are compared or connected. So
work grows with the rows of the buckets where they hold one family, and with the square of a bucket of unlike documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views
from ..sources.scratch import bounded, written
from .dedup import CONTAINED, shingles

BANDS, ROWS = 64, 2
#: Shingles whose minima are taken at once.
SLICE = 200_000
#: Documents on each side of a block, whose signatures a task holds at once.
BLOCK = 2000

_U = np.uint64


def _factors(k: int) -> np.ndarray:
    """``k`` odd multipliers out of one start value, the same on every machine."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(k):
        x = (x * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64
        out.append(x | 1)
    return np.array(out, _U)


def _minima(values: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Per group of values that begins at ``starts`` the least of each of the mixed products."""
    out = np.empty((len(starts), len(factors)), _U)
    for k, f in enumerate(factors):
        h = values * f
        h ^= h >> _U(29)
        h *= f
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, sig, digest) of every document with words: its number of shingles, the low halves of its minima, and a digest of
    both."""
    sets = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), shingles(F.col(text)).alias("s")).where(F.size("s") > 0)
    factors = _factors(bands * rows)
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values).view(_U)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
                n = np.diff(offsets[i : j + 1]).astype(np.int64)
                made = _minima(values[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], factors).astype(np.uint32).view(np.int32)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16, salt=int(k).to_bytes(8, "little")).digest() for x, k in zip(made, n, strict=True)]
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1]), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), sig, pa.array(digests, pa.binary())], names=["id", "n", "sig", "digest"])
                i = j

    return sets.mapInArrow(run, f"id {kind}, n long, sig array<int>, digest binary")


def _contained(sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """The share of the smaller set that both have, as their signatures tell."""
    same = F.aggregate(F.zip_with(sa, sb, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    j = same / F.size(sa)
    return F.least(F.lit(1.0), j / (1 + j) * (na + nb) / F.least(na, nb))


def _labels(links: DataFrame) -> DataFrame:
    """(id, label) of those in ``links`` (a, b): equal labels are connected. Not all connected ones have equal labels, which
    costs comparisons and no link."""
    named = written(links.select(F.col("b").alias("id"), F.col("a").alias("label")).union(links.select("a", "a")).groupBy("id").agg(F.min("label").alias("label")), "labels")
    for _ in range(2):
        of = lambda c: named.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))  # noqa: E731, B023
        across = links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("up"))
        across = written(across, "label-links")
        ups = across.join(across.select(F.col("label").alias("up"), F.col("up").alias("top")), "up", "left").select("label", F.coalesce("top", "up").alias("up"))
        named = written(named.join(ups, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
    return named


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (block, id, label) with the places i, j where their block is compared, and their side there (2: with all).

    A block of more than BLOCK documents is cut: parts of its commonest label meet those of the others, and these each other.
    """
    counts = members.groupBy("block", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("block").agg(F.sum("k").alias("all"), F.max(F.struct("k", "label")).alias("top"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    cuts = F.broadcast(counts.where(F.col("all") > BLOCK).select("block", F.col("top.label").alias("top"), parts(F.col("top.k")).alias("tops"), parts(F.col("all") - F.col("top.k")).alias("others")))  # few
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    two = lambda k: F.when(k == part("others"), 2).otherwise((k < part("others")).cast("int"))
    top = F.transform(upto("others"), lambda k: place(part("tops"), k, F.lit(0)))
    other = F.concat(F.transform(upto("tops"), lambda k: place(k, part("others"), F.lit(1))), F.transform(upto("others"), lambda k: place(-1 - F.least(k, part("others")), F.greatest(k, part("others")), two(k))))
    places = F.when(F.col("top").isNull(), F.array(place(F.lit(0), F.lit(0), F.lit(2)))).when(F.col("label") == F.col("top"), top).otherwise(other)
    return members.join(cuts, "block", "left").select("block", "id", "label", F.explode(places).alias("p")).select("block", "p.i", "p.j", "p.side", "id", "label")


def _forest(block: list[pa.RecordBatch], at_least: float, rows: int) -> tuple[list, list, list]:
    """Links (a, b, containment) that connect those of different labels who share a band and are near, one of each two groups.

    The commonest label comes last: then its documents, connected already, are not gone through one by one.
    """
    t = pa.Table.from_batches(block).combine_chunks()
    labels, sides, n = t["label"].to_pylist(), t["side"].to_numpy(), t["n"].to_numpy()
    code = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    root = np.array([code[x] for x in labels])
    if len(code) == 1:
        return [], [], []
    ids, left = t["id"].to_pylist(), len(code)
    sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((root, np.bincount(root)[root]))
    sig, root, sides, n = sig[order], root[order], sides[order], n[order]
    out: tuple[list, list, list] = ([], [], [])
    for x in range(len(order) - 1):
        y = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & ((sides[x + 1 :] != sides[x]) | (sides[x] == 2)))
        if not len(y):
            continue
        same = sig[y] == sig[x]
        band = same[:, ::rows].copy()
        for k in range(1, rows):
            band &= same[:, k::rows]
        share = band.any(axis=1)
        y, j = y[share], np.count_nonzero(same[share], axis=1) / sig.shape[1]
        c = np.minimum(1.0, j / (1 + j) * (n[x] + n[y]) / np.minimum(n[x], n[y]))
        for k in np.flatnonzero(c >= at_least):
            if root[y[k]] != root[x]:
                for made, value in zip(out, (ids[order[x]], ids[order[y[k]]], float(c[k])), strict=True):
                    made.append(value)
                root[root == root[y[k]]] = root[x]
                left -= 1
        if left == 1:
            break
    return out


def _compared(rest: DataFrame, at_least: float, rows: int) -> DataFrame:
    """(a, b, c): ``_forest`` of each (block, i, j) of ``rest``."""
    kind = rest.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("block", "i", "j")], strict=True))
            found, at = ([], [], []), 0
            for k, key in enumerate(keys):
                if key != now:
                    if k > at:
                        held.append(b.slice(at, k - at))
                    if held:
                        for made, more in zip(found, _forest(held, at_least, rows), strict=True):
                            made += more
                    now, held, at = key, [], k
            held.append(b.slice(at))
            of = b.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(found[0], of), pa.array(found[1], of), pa.array(found[2], pa.float64())], names=["a", "b", "c"])
        if held:
            of, found = held[0].schema.field("id").type, _forest(held, at_least, rows)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], of), pa.array(found[1], of), pa.array(found[2], pa.float64())], names=["a", "b", "c"])

    return rest.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "id").mapInArrow(run, f"a {kind}, b {kind}, c double")


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = CONTAINED, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, containment): links between documents whose estimated containment reaches ``at_least``, a < b, and 1.0 from
    the first of equal signatures to the others. Groups are the connected ones: whoever shares a band and is near is in one
    group, but not every pair of a group is a link."""
    sigs = written(signatures(docs, key, text, bands, rows), "signatures")
    named = sigs.select("id", "digest").join(sigs.groupBy("digest").agg(F.min("id").alias("first")), "digest")
    copies = written(named.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("containment")), "copies")
    own = sigs.join(bounded(copies.select(F.col("b").alias("id"))), "id", "left_anti").select("id", "n", "sig")
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * rows + 1, rows)))
    met = own.select("id", F.explode(cut).alias("bucket"))
    asked = written(met.withColumn("a", F.min("id").over(W.partitionBy("bucket"))).where("id > a").select("bucket", "a", F.col("id").alias("b")), "asked")
    some = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct()  # who is alone in all buckets is asked for no more
    own = written(own.join(bounded(written(some, "met")), "id", "left_semi"), "met-signatures")
    side = lambda p: own.select(F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("sig").alias(f"s{p}"))
    pairs = asked.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    scored = written(pairs.select("a", "b", _contained(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")).alias("c")), "scored")
    stars = scored.where(F.col("c") >= at_least)
    asked = asked.join(_labels(stars.select("a", "b")).withColumnRenamed("id", "b"), "b", "left").select("bucket", "a", "b", F.coalesce("label", "b").alias("label"))
    several = asked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    members = written(asked.join(several, "bucket", "left_semi").select(F.col("a").alias("block"), F.col("b").alias("id"), "label").distinct(), "members")
    rest = _compared(_dealt(members).join(own, "id"), at_least, rows).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c")
    return copies.unionByName(stars.unionByName(rest).select("a", "b", F.round("c", 4).alias("containment"))).distinct()


QUERIES = {"approximate_near_dups": (lambda s, d: near_links(views.table(s, d, "documents").select("doc_id", "text")), None)}
