"""Operator 1: n-gram Jaccard join with parity sketches.

A document's set is its distinct 5-word shingles as 64-bit hashes. Two sets with Jaccard similarity of at least 3/4 and
sizes a, b differ in at most D = (a + b) // 7 members. Each set is XOR-hashed twice:

* into sketch words: every member is XORed into one of m words, m fixed per band of sizes (factor 4). The number of
  differing words is at most the symmetric difference, so of any D + 1 words of either set one is equal in both. Words
  have one global order, and each set emits its first D + 1: the least common word is then emitted by both. Sets near a
  band's lower end also emit in the band below. Under 256 members a word is one member. The order is by hash, with hot
  words last: those that many documents of a sample hold. Any list of hot words gives the same links; a good one keeps
  common passages from bringing together documents that have other words to offer.
* into a bit sketch of 2n bits or more, whose Hamming distance is a lower bound of the symmetric difference, and which
  folds to any smaller power of two. It rejects most candidates before the exact check.

Candidates share an emitted word. Every word's group is represented by its first document, its centre, so a group costs
rows in proportion to its size, and a document meets a centre once, however many words they share. Documents of one
group have the same centre, so all candidates lie within the clusters of a centre. First every document is checked
against the centre with which it shares most words, and components are formed. Then clusters that still hold several
components are compared by their sketches, in blocks of bounded size; each block returns a spanning forest of its likely
links. When these have been checked and components merged, clusters in which a link of the forest failed are compared
once more: blocks return the members that still have a likely partner in another component, and among these the sets
themselves decide: a block counts what its members share and returns a spanning forest of true links. So no step returns more than a forest of its block, however many pairs are just below the threshold. Copies are
one component by then and are not compared. Checks recompute the sets of the candidates' whole texts and are exact.

Hot groups: the first document of a hot word comes from a partial minimum; a centre's partners are dealt to parts of
PARTNERS; clusters are cut into blocks of BLOCK members and BLOCK_BYTES of data.

Defined results: null texts and texts without words have an empty set (n_shingles 0), link with nothing and are their
own component. Copies within a task emit words once; equal sets are linked through their digest. Rows with one doc_id
are one document that links where any of its rows does. A null doc_id links with nothing and has a null component. Keys
may have any type that sorts; those that are no integers are numbered in their order first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, few, free_name, table, written
from .components import components
from .wordhash import SPACED, byte_slices, grams, hash_words, mix

SHINGLE = 5
#: Sets under this size emit single members; from here on bands [4^j, 4^(j+1)) have m = 4^(j+1) / LOAD words.
SMALL, LOAD = 256, 1.8
#: Members of a cluster and bytes of their data on each side of a block, partners of a centre that are checked in one
#: part, and ids of candidates that are broadcast at most.
BLOCK, BLOCK_BYTES, PARTNERS, BROADCAST_IDS = 1500, 8 << 20, 100, 1_000_000
#: Hot words are sought in every HOT_SHARE-th document, or in about HOT_DOCS of them if that is less; words in HOT_ROWS
#: of these are hot, at most HOT_WORDS. The sample decides the order of words alone, and no link depends on it.
HOT_SHARE, HOT_DOCS, HOT_ROWS, HOT_WORDS = 20, 1_000_000, 20, 1_000_000


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    h, doc = hash_words(texts, SPACED)
    g = grams(h, size)
    whole = doc[: len(g)] == doc[size - 1 :] if len(g) else np.zeros(0, bool)
    g, owner = g[whole], doc[: len(whole)][whole]
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        fresh = np.r_[True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])]
        g, owner = g[fresh], owner[fresh]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        n = first[i + 1] - first[i]
        out.append(grams(h[first[i] : first[i + 1]], int(n)) if 0 < n < size else g[cut[i] : cut[i + 1]])
    return out


def _band(n: int) -> int:
    return (int(n).bit_length() - 1) // 2


def _words(s: np.ndarray, band: int) -> np.ndarray:
    """Hashes of the sketch words of a band."""
    m = int(4 ** (band + 1) / LOAD)
    place = (s % np.uint64(m)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, s = place[order], s[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    word = np.bitwise_xor.reduceat(s, starts)
    return mix(word ^ mix(place[starts].astype(np.uint64) * np.uint64(128) + np.uint64(band + 1)))


def _parts(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The words of a set and how many of them it emits, for each way to find it; see the module's text for the numbers."""
    n = len(s)
    if n and 3 * n < 4 * SMALL:  # it, or a smaller partner of it, is small
        yield s, n // 4 + 1
    if n >= SMALL:
        band = _band(n)
        yield np.sort(_words(s, band)), n // 3 + 1
        if 3 * n < 4 * 4**band and 4**band > SMALL:
            yield np.sort(_words(s, band - 1)), 2 * n // 7 + 1


def emitted(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (other, hot) words by which a set can be found; ``hot`` is sorted and stands last in the order."""
    cold, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for words, n in _parts(s):
        known = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words if len(hot) else np.zeros(len(words), bool)
        rare = words[~known][:n]
        cold.append(rare)
        often.append(words[known][: n - len(rare)])
    return np.concatenate(cold), np.concatenate(often)


def bit_sketch(s: np.ndarray) -> bytes:
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch that ``size`` bytes would have had."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


_SIGNED = "n bigint, digest binary, sketch binary, words array<bigint>, hot array<bigint>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum(np.r_[0, [len(r) for r in rows]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def hot_words(docs: DataFrame, key: str, text: str, scratch: Scratch, size: int = SHINGLE, share: int = HOT_SHARE, rows: int = HOT_ROWS) -> np.ndarray:
    """Sorted words that many documents hold, by a sample of documents; at most HOT_WORDS of them."""
    every = max(share, docs.count() // HOT_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in byte_slices(b.column(0)):
                words = [w for s in shingle_sets(texts, size) for w, _ in _parts(s)]
                if words:
                    yield _rows(np.concatenate(words).view(np.int64), names=("word",))

    some = docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(text)
    counts = some.mapInArrow(run, "word bigint").groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= rows)
    counts = scratch.written(counts, "hot")
    while counts.where(F.col("k") >= rows).count() > HOT_WORDS:
        rows *= 2
    found = counts.where(F.col("k") >= rows).select("word").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def signatures(docs: DataFrame, key: str, text: str, hot: np.ndarray, size: int = SHINGLE) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = set(), (np.zeros(0, np.uint64),) * 2
        for b in batches:
            n, digests, sketches, words = [], [], [], []
            named = b.column(0).is_valid().to_pylist()
            for _, texts in byte_slices(b.column(1)):
                for s in shingle_sets(texts, size):
                    known = named[len(n)]
                    n.append(len(s))
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    digests.append(digest)
                    sketches.append(bit_sketch(s) if len(s) else b"")
                    # Rows without an id are in no link, and must not stand for equal texts that have one.
                    words.append(emitted(s, sent.value) if known and digest not in seen else none)
                    if known:
                        seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), *(_lists([w[k] for w in words]) for k in range(2))],
                names=["id", "n", "digest", "sketch", "words", "hot"],
            )

    return docs.select(key, text).mapInArrow(run, f"id {kind}, {_SIGNED}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, id) sorted by both -> (word, id, first id of the word) of words that several ids have; a constant state."""
    held = None  # the last row so far: its word, id, the word's first id, and whether the word has several ids
    for b in batches:
        word, ids = (c.to_numpy() for c in b.columns)
        if not len(word):
            continue
        if held:
            word, ids = np.r_[held[0], word], np.r_[held[1], ids]
        new = np.r_[True, word[1:] != word[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
        first = ids[start]
        if held:
            first[start == 0] = held[2]
        many = first != ids
        if held:
            many[0] |= held[3]
        # A word's first row belongs to a group if a later row of it does; the last row waits for the next batch.
        grouped = many.copy()
        any_later = np.zeros(len(word), bool)
        np.logical_or.at(any_later, start, many)
        grouped |= any_later[start]
        yield _rows(word[:-1][grouped[:-1]], ids[:-1][grouped[:-1]], first[:-1][grouped[:-1]])
        held = (word[-1], ids[-1], first[-1], bool(grouped[-1]))
    if held and held[3]:
        yield _rows(*(np.array([x], np.int64) for x in held[:3]))


def _rows(*columns: np.ndarray, names=("word", "id", "first")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches allow a similarity of 3/4; sketches of like lengths are compared as matrices."""
    for b in batches:
        na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
        sa, sb = (b.column(k).to_pylist() for k in ("sa", "sb"))
        keep = np.zeros(b.num_rows, bool)
        sizes = np.array([(len(x), len(y)) for x, y in zip(sa, sb, strict=True)], np.int64).reshape(-1, 2)
        for lx, ly in np.unique(sizes, axis=0).tolist():
            rows, size = np.flatnonzero((sizes == (lx, ly)).all(axis=1)), min(lx, ly)
            x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(s[r] for r in rows), np.uint8).reshape(len(rows), -1, size), axis=1) for s in (sa, sb))
            keep[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (na[rows] + nb[rows]) // 7
        yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in ("a", "b")], names=["a", "b"])


def _by_block(compare):
    """Runs ``compare`` on the members (side, id, component, n, data) of each run of (centre, i, j); pairs are its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, now = [], None
        for b in batches:
            found = []
            cols = [b.column(k).to_pylist() for k in ("centre", "i", "j", "side", "id", "component", "n", "data")]
            for row in zip(*cols, strict=True):
                if row[:3] != now:
                    if len(members) > 1:
                        found.append((now[0], compare(now[1] != now[2], members)))
                    members, now = [], row[:3]
                members.append(row[3:])
            yield _pairs(found)
        if len(members) > 1:
            yield _pairs([(now[0], compare(now[1] != now[2], members))])

    return run


def _pairs(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    centre = np.repeat(np.array([c for c, _ in found], np.int64), [len(p) for _, p in found])
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(p for _, p in found)])
    return _rows(centre, pairs[:, 0].copy(), pairs[:, 1].copy(), names=("centre", "a", "b"))


def _likely(two_sides: bool, members: list, forest: bool = True) -> np.ndarray:
    """A forest of pairs (larger id, smaller id) of different components whose sizes and sketches allow a similarity of
    3/4; or, without ``forest``, (id, id) of every member that is in such a pair."""
    members.sort(key=lambda m: m[3])
    side, ids, comp, n = (np.array([m[k] for m in members], np.int64) for k in range(4))
    sizes = np.array([len(m[4]) for m in members])
    ends = np.searchsorted(n, 4 * n // 3, side="right")
    left, right, far, paired = [], [], [], np.zeros(len(n), bool)
    for size in np.unique(sizes):  # sketches grow with n: those of this size are neighbours, and partners have it or twice it
        own = np.flatnonzero(sizes == size)
        top = ends[own[-1]]
        rows = np.stack([folded(np.frombuffer(m[4], np.uint8), size) for m in members[own[0] : top]]).view(np.uint64)
        for p in own:
            q = np.arange(p + 1, ends[p])
            q = q[comp[q] != comp[p]]
            if two_sides:
                q = q[side[q] != side[p]]
            if not len(q):
                continue
            d = np.bitwise_count(rows[q - own[0]] ^ rows[p - own[0]]).sum(axis=1, dtype=np.int64)
            near = d <= (n[p] + n[q]) // 7
            if not near.any():
                continue
            q = q[near]
            if forest:
                left.append(np.full(len(q), p))
                right.append(q)
                far.append(d[near] / (n[p] + n[q]))
            else:
                paired[p] = paired[q] = True
        if left and sum(map(len, left)) > BLOCK:  # keeps what is held in proportion to the block
            left, right, far = ([x] for x in _spanning(comp, *map(np.concatenate, (left, right, far))))
    if not forest:
        return np.stack([ids[paired], ids[paired]], axis=1)
    if not left:
        return np.zeros((0, 2), np.int64)
    left, right, far = _spanning(comp, *map(np.concatenate, (left, right, far)))
    return np.stack([np.maximum(ids[left], ids[right]), np.minimum(ids[left], ids[right])], axis=1)


def _spanning(comp: np.ndarray, left: np.ndarray, right: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that a minimum spanning forest of the components keeps, nearest first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    order = np.argsort(far, kind="stable")
    kept = []
    for k, a, b in zip(order.tolist(), comp[left[order]].tolist(), comp[right[order]].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return left[kept], right[kept], far[kept]


def _linked(two_sides: bool, members: list) -> np.ndarray:
    """A forest of the links (larger id, smaller id) between different components, by the sets themselves.

    Of every member's shingles the lists of holders are laid end to end and counted: one pass gives what it shares with
    all others.
    """
    members.sort(key=lambda m: m[3])
    side, ids, comp, n = (np.array([m[k] for m in members], np.int64) for k in range(4))
    _, root = np.unique(comp, return_inverse=True)
    s = np.frombuffer(b"".join(m[4] for m in members), np.uint64)
    first, holder = np.r_[0, np.cumsum(n)], np.repeat(np.arange(len(n)), n)
    order = np.argsort(s, kind="stable")
    new = np.r_[True, s[order][1:] != s[order][:-1]]
    start = np.flatnonzero(new)
    held, number = np.diff(np.r_[start, len(s)]), np.empty(len(s), np.int64)
    number[order], holder = np.cumsum(new) - 1, holder[order]
    ends = np.searchsorted(n, 4 * n // 3, side="right")
    found = []
    for p in range(len(n)):
        q = np.arange(p + 1, ends[p])
        q = q[(root[q] != root[p]) & (side[q] != side[p])] if two_sides else q[root[q] != root[p]]
        if not len(q):
            continue
        own = number[first[p] : first[p + 1]]
        own = own[held[own] > 1]
        k = held[own]
        at = np.repeat(start[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        shared = np.bincount(holder[at], minlength=len(n))
        for x in q[7 * shared[q] >= 3 * (n[p] + n[q])].tolist():
            if root[x] != root[p]:
                root[root == root[x]] = root[p]
                found.append((max(ids[p], ids[x]), min(ids[p], ids[x])))
    return np.array(found, np.int64).reshape(-1, 2)


def _sets(docs: DataFrame, key: str, text: str, ids: DataFrame, size: int) -> DataFrame:
    """(id, data) of the rows of ``docs`` whose key is in ``ids`` (wanted): each set once, before it is dealt to anything."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [s.tobytes() for _, texts in byte_slices(b.column(1)) for s in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, F.col("id") == F.col("wanted"), "left_semi")
    return rows.mapInArrow(sets, "id bigint, data binary")


def verified(docs: DataFrame, key: str, text: str, pairs: DataFrame, scratch: Scratch, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose sets have an intersection of at least 3/4 of their union.

    Sets are recomputed from whole texts and gathered by b: b's set is held while those of its partners pass by, in parts
    of about PARTNERS.
    """
    pairs = scratch.written(pairs.select("a", "b").distinct(), "pairs")
    hubs = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PARTNERS).select(F.col("b").alias("hub"), F.ceil(F.col("k") / PARTNERS).cast("int").alias("parts"))
    hubs = scratch.written(hubs, "hubs")
    few_pairs = pairs.count() <= BROADCAST_IDS
    if hubs.count() <= BROADCAST_IDS:
        hubs = F.broadcast(hubs)
    parts = F.coalesce("parts", F.lit(1))
    partners = pairs.join(hubs, F.col("b") == F.col("hub"), "left").select(F.col("b").alias("at"), F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"), F.col("a").alias("asked"))
    centres = pairs.select("b").distinct().join(hubs, F.col("b") == F.col("hub"), "left")
    centres = centres.select(F.col("b").alias("at"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("b").alias("asked"))
    asked = partners.unionByName(centres)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for b in batches:
            out = []
            for here, part, i, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(data, np.uint64)
                if (here, part) != at:
                    at, centres = (here, part), []
                if i == here:
                    centres.append(s)
                elif any(7 * len(np.intersect1d(s, c, assume_unique=True)) >= 3 * (len(s) + len(c)) for c in centres):
                    out.append((i, here))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    got = _sets(docs, key, text, asked.select(F.col("asked").alias("wanted")).distinct(), size)
    got = got.join(F.broadcast(asked) if few_pairs else asked, F.col("id") == F.col("asked")).select("at", "part", "id", "data")
    got = got.repartition("at", "part").sortWithinPartitions("at", "part", F.col("id") != F.col("at"))
    return got.mapInArrow(compare, "a bigint, b bigint")


def _first_checks(stars: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b): for each document the centre of fitting size with which it shares most words, if their sketches are near.

    One pair per document is left before sketches are attached.
    """
    n = lambda x: marks.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"))
    sketch = lambda x: marks.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    rows = stars.count()
    fit = few(few(stars.join(n("a"), "a"), rows).join(n("b"), "b"), rows).where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    one = fit.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("minus"), "na", "nb")).alias("x")).select("a", (-F.col("x.minus")).alias("b"), "x.na", "x.nb")
    sketched = few(few(few(one, rows).join(sketch("a"), "a"), 8 * rows).join(sketch("b"), "b"), 8 * rows)
    return sketched.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a bigint, b bigint")


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``docs`` (_id, _text) with numbers in the order of their keys for the keys, and the table (number, known) of both.

    The sorted keys are written before they are read again, so a number stays with its key.
    """
    keys = docs.select(F.col("_id").alias("known")).where("known is not null").distinct().orderBy("known").withColumn("number", F.monotonically_increasing_id())
    keys = scratch.written(keys, "keys")
    return docs.join(keys, F.col("_id") == F.col("known"), "left").select(F.col("number").alias("_id"), "_text"), keys


def ngram_join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, hot_share: int = HOT_SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """key, n_shingles, component_id per row of ``docs``; a component is what links of similarity 3/4 connect."""
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    scratch, keys = Scratch(docs.sparkSession, "ngram-join"), None
    if isinstance(kind, T.IntegralType):
        docs = docs.withColumn("_id", F.col("_id").cast("bigint"))
    else:
        docs, keys = _numbered(docs, scratch)
    hot = hot_words(docs, "_id", "_text", scratch, size, hot_share, hot_rows)
    signed = scratch.written(signatures(docs, "_id", "_text", hot, size), "signatures")
    marks = signed.select("id", "n", "sketch").where("id is not null and n > 0")
    words = signed.where("id is not null").select(F.explode("words").alias("word"), "id").repartition("word").sortWithinPartitions("word", "id")
    groups = words.mapInArrow(_groups, "word bigint, id bigint, first bigint").where("id <> first").select("id", "first")
    if len(hot):  # rows of hot words stay where they are: their first ids, at most HOT_WORDS, come to them
        often = signed.where("id is not null").select(F.explode("hot").alias("word"), "id")
        firsts = often.groupBy(F.col("word").alias("w")).agg(F.min("id").alias("first"))
        groups = groups.unionByName(often.join(F.broadcast(firsts), F.col("word") == F.col("w")).where("id <> first").select("id", "first"))
    stars = scratch.written(groups.groupBy(F.col("id").alias("a"), F.col("first").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "stars")

    named = signed.where("id is not null and n > 0").select("digest", F.col("id").alias("a"))
    copied = named.groupBy("digest").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "b")
    copied = scratch.written(copied, "copied")
    if copied.count() <= BROADCAST_IDS:  # then a text that a third of all rows hold does not meet in one task
        copied = F.broadcast(copied)
    equal = named.join(copied, "digest").where("a <> b").select("a", "b")

    links = scratch.written(verified(docs, "_id", "_text", _first_checks(stars, marks), scratch, size).unionByName(equal), "linked")
    known = components(links, scratch)
    sketches = marks.withColumnRenamed("sketch", "data")
    likely = scratch.written(_between(_members(stars), marks, sketches, known, _likely), "likely")
    known = _merged(known, scratch.written(verified(docs, "_id", "_text", likely, scratch, size), "linked"), scratch)
    # Where a block's forest held, nothing likely is left between its components; elsewhere sets are compared.
    name = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rows = likely.count()
    broken = few(few(likely.join(name("a"), "a", "left"), rows).join(name("b"), "b", "left"), rows).where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    broken = scratch.written(stars.join(broken.select(F.col("centre").alias("b")).distinct(), "b", "left_semi"), "broken")
    if broken.count():
        paired = _between(_members(broken), marks, sketches, known, lambda two_sides, members: _likely(two_sides, members, forest=False))
        paired = scratch.written(paired.select("centre", F.col("a").alias("id")).distinct(), "paired")
        sets = scratch.written(_sets(docs, "_id", "_text", paired.select(F.col("id").alias("wanted")).distinct(), size), "sets")
        rest = _between(paired, marks, sets.withColumn("n", (F.octet_length("data") / 8).cast("long")), known, _linked)
        known = _merged(known, scratch.written(rest.select("a", "b"), "linked"), scratch)
    out = signed.select("id", "n").join(known, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if keys is not None:
        own = lambda c: keys.select(F.col("number").alias(c), F.col("known").alias(f"k{c}"))
        out = out.join(own("id"), "id", "left").join(own("component"), "component", "left").select(F.col("kid").alias("id"), "n", F.col("kcomponent").alias("component"))
    out = out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"))
    out = written(out, "ngram-components")
    scratch.drop()
    return out


def _members(stars: DataFrame) -> DataFrame:
    """(centre, id) of the members of every cluster, centres among them."""
    return stars.select(F.col("b").alias("centre"), F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("centre"), F.col("b").alias("id")).distinct())


def _between(members: DataFrame, marks: DataFrame, data: DataFrame, known: DataFrame, compare) -> DataFrame:
    """What ``compare`` finds (centre, a, b) between components within the clusters of one centre, by ``data`` (id, n, data),
    in blocks of about BLOCK members and BLOCK_BYTES on each side."""
    rows = members.count()
    named = few(members, rows).join(known.withColumnRenamed("node", "id"), "id", "left").select("centre", "id", F.coalesce("component", "id").alias("component"))
    named = few(few(named, rows).join(marks.groupBy("id").agg(F.max("n").alias("most")), "id"), rows)
    # A set has 8 bytes a member, and its sketch less than that.
    sizes = named.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("most") * 8 / BLOCK_BYTES).alias("k"))
    cut = named.join(sizes.where("lo <> hi").select("centre", F.ceil("k").cast("int").alias("blocks")), "centre")
    cut = few(cut, rows).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.select("centre", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("centre", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    ready = few(cut.join(data, "id"), 8 * rows).repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    return ready.select("centre", "i", "j", "side", "id", "component", "n", "data").mapInArrow(_by_block(compare), "centre bigint, a bigint, b bigint").distinct()


def _merged(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after further links."""
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rows = known.count() + links.count()
    lifted = few(few(links.join(side("a"), "a", "left"), rows).join(side("b"), "b", "left"), rows).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(lifted, scratch)
    # The nodes of these links are the components so far, none of which is a node of ``known``.
    moved = known.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = few(moved.select("node", F.coalesce("to", "component").alias("component")), rows)
    return scratch.written(moved.unionByName(few(more, rows)), "components")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are not the first of their component; rows without a key stay."""
    found = ngram_join(docs, key=key, text=text)
    gone = free_name(docs, "_gone")
    copies = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone)).distinct()
    if copies.count() <= BROADCAST_IDS:  # then the texts stay where they are; else both sides are shuffled
        copies = F.broadcast(copies)
    return docs.join(copies, docs[key] == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*)::bigint as n from s group by doc_id
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), e as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)
), both_ as (
  select x, y from e union all select y, x from e
), reach(x, y) as (
  select doc_id, doc_id from d union select r.x, b.y from reach r join both_ b on r.y = b.x
)
select doc_id, coalesce(n, 0) as n_shingles, c as component_id
from (select x as doc_id, min(y) as c from reach group by x) left join n using (doc_id)
"""
