"""Operator 11: line deduplication by sorted hashes.

Every line of at least MIN_CHARS characters becomes a row of 128 bits of hash, document and place. Rows are dealt to
ranges of (hash, document) and sorted by hash, document (the largest first) and place, and each range is read once as a
stream: the document that comes first keeps its lines, and those of the documents after it are dropped as soon as
MIN_DOCS documents are seen. A hash that ends one range and begins the next, such as a line that a third of all documents
hold, is settled by a summary of at most two rows for each range, so no hash meets in one task. What is returned is no
text but one bitmap of kept lines for each row that loses any, deflated; ``deduplicated`` applies them.

Defined results: a null or empty text is one empty line. A row without a key counts for no line and keeps all of its own.
Rows of one key are one document: its lines stay in all its rows if it is the largest that has them, and go in all if not;
rows are told apart by key and a 32-bit hash of the text. Equal lines within the document that stays all stay. A text that
loses every line becomes empty. An empty table gives no rows. Keys may have any type that sorts; columns of any other names
pass through ``deduplicated``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, free_name, table, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes of bitmaps that are broadcast to the texts; more of them meet the texts in a join.
BROADCAST_BYTES = 32 << 20

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A row's kind: it goes; its hash began in an earlier range or may go on in a later one; a summary of such a hash.
GOES, OPEN, SUMMARY = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _row(text: Column) -> Column:
    return F.hash(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, spot) of every line that counts; a spot is the row's hash and the line's number in one long."""
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), _row(F.col(text)).alias("row"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
    keys = lines.select("doc", "row", "at", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    spot = F.shiftleft(F.col("row").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return keys.select(F.xxhash64(F.lit(11), "k").alias("h1"), F.xxhash64(F.lit(12), "k").alias("h2"), "doc", spot.alias("spot"))


class _Range:
    """The stream of one range. ``order`` is the number of the present document among those of the present hash."""

    def __init__(self, min_docs: int, kind: pa.DataType):
        self.min_docs, self.kind = min_docs, kind
        self.last = None  # (h1, h2, doc) of the row before
        self.order, self.head = 0, None
        self.first_run = True
        self.held: list[pa.RecordBatch] = []  # rows of the second to the last document below min_docs

    def _out(self, kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *rows.columns, pa.nulls(n, pa.int64())], names=["kind", "h1", "h2", "doc", "spot", "docs"])

    def _summary(self) -> pa.RecordBatch:
        h1, h2, _ = self.last
        values = [pa.array([SUMMARY], pa.int32()), pa.array([h1], pa.int64()), pa.array([h2], pa.int64()), pa.array([self.head], self.kind), pa.nulls(1, pa.int64()), pa.array([self.order], pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=["kind", "h1", "h2", "doc", "spot", "docs"])

    def read(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        h1, h2, doc = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        started = self.last is not None
        run = np.r_[not started or (h1[0], h2[0]) != self.last[:2], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        other = pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)
        fresh = run | np.r_[not started or doc[0].as_py() != self.last[2], other]
        starts = np.flatnonzero(run)
        docs = np.cumsum(fresh)
        # The number of documents before each row's hash began, so that the first of a hash has order 1.
        before = np.r_[-self.order, docs[starts] - 1]
        order = docs - before[np.cumsum(run)]
        ends = np.r_[starts, len(run)] - 1  # of the hash that goes on from before, if any, and of each that begins here
        total = np.r_[order[ends[0]] if ends[0] >= 0 else self.order, order[ends[1:]]]

        if started and len(starts):  # the hash from before ends here
            self.order = int(total[0])
            if self.first_run:
                yield self._summary()
        if total[0] >= self.min_docs:
            for x in self.held:
                yield self._out(GOES, x)
        if total[0] >= self.min_docs or len(starts):
            self.held = []

        number = np.cumsum(run)
        opening = self.first_run & (number == (0 if started else 1))
        if opening.any():
            yield self._out(OPEN, b.filter(pa.array(opening)))
        later = ~opening & (order >= 2)
        goes = later & (total[number] >= self.min_docs)
        if goes.any():
            yield self._out(GOES, b.filter(pa.array(goes)))
        held = later & ~goes & (number == len(starts))
        if held.any():
            self.held.append(b.filter(pa.array(held)))

        if len(starts):
            if started or len(starts) > 1:
                if not started and self.first_run:  # the first hash of the range ends within its first batch
                    self.last, self.order, self.head = (int(h1[0]), int(h2[0]), None), int(total[1]), doc[0].as_py()
                    yield self._summary()
                self.first_run = False
            self.head = doc[int(starts[-1])].as_py()
        self.order = int(total[-1])
        self.last = (int(h1[-1]), int(h2[-1]), doc[len(h1) - 1].as_py())

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.last is not None:
            yield self._summary()
            for x in self.held:
                yield self._out(OPEN, x)


def dropped_lines(docs: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, spot) of every line that goes."""
    # Written first: the ranges are cut at a sample of these rows, and the texts are read once for both.
    rows = scratch.written(line_rows(docs, key, text, min_chars), "lines")
    kind = rows.schema["doc"].dataType
    of = to_arrow_type(kind)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Range(min_docs, of)
        for b in batches:
            yield from state.read(b)
        yield from state.end()

    dealt = rows.repartitionByRange("h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "spot")
    made = scratch.written(dealt.mapInArrow(stream, f"kind int, h1 long, h2 long, doc {kind.simpleString()}, spot long, docs long"), "decided")
    # At most two rows for each range.
    whole = made.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.max("doc").alias("head"))
    late = made.where(F.col("kind") == OPEN).select("h1", "h2", "doc", "spot").join(F.broadcast(whole), ["h1", "h2"]).where((F.col("all") >= min_docs) & (F.col("doc") != F.col("head")))
    return made.where(F.col("kind") == GOES).select("doc", "spot").unionByName(late.select("doc", "spot"))


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for at in b.column(2):
            at = np.asarray(at.values)
            keep = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)  # what fills the last byte is kept
            keep[at] = 0
            made.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in b.column(2)], pa.int64()), pa.array(made, pa.binary())], names=["doc", "row", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, n_dropped, keep) for every row of ``docs`` that loses a line, as a written table.

    ``keep`` is a deflated bitmap, the first line in the highest bit of the first byte; lines after its end, and rows that
    have no bitmap, are kept. ``row`` is a hash of the text.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = dropped_lines(docs, scratch, key=key, text=text, min_chars=min_chars, min_docs=min_docs)
    row, at = F.shiftright("spot", 32).cast("int"), F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    found = lines.select("doc", row.alias("row"), at.alias("at")).groupBy("doc", "row").agg(F.collect_set("at").alias("at"))
    kind = found.schema["doc"].dataType.simpleString()
    out = written(found.mapInArrow(_deflated, f"doc {kind}, row int, n_dropped long, keep binary"), "keep-bitmaps")
    scratch.drop()
    return out


def _kept(text: str, keep: bytes | None) -> tuple[str, int]:
    """(text of the kept lines, lines before)."""
    if keep is None:
        return text, text.count("\n") + 1
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    return "\n".join([x for x, k in zip(lines, bits, strict=False) if k] + lines[len(bits) :]), len(lines)


def deduplicated(docs: DataFrame, bitmaps: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the texts of kept lines, and n_lines and n_dropped of each row (under free names where these are
    taken). A few bitmaps are broadcast; more meet the texts in a join."""
    size = bitmaps.agg(F.sum(F.octet_length("keep") + 64)).first()[0] or 0
    names = {}
    for base in ("_row", "_keep", "n_dropped", "n_lines"):
        names[base] = free_name(docs, base)
    side = bitmaps.select(F.col("doc").alias("_doc"), F.col("row").alias("_at"), F.col("keep").alias("_bits"), F.col("n_dropped").alias("_n"))
    own = docs.withColumn(names["_row"], _row(F.col(text))).alias("own")
    met = own.join(F.broadcast(side) if size <= broadcast_bytes else side, (F.col(f"own.`{key}`") == F.col("_doc")) & (F.col(f"own.`{names['_row']}`") == F.col("_at")), "left")
    met = met.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns], F.col("_bits").alias(names["_keep"]), F.coalesce("_n", F.lit(0)).cast("long").alias(names["n_dropped"]))
    schema = met.drop(names["_keep"]).withColumn(names["n_lines"], F.lit(0).cast("long")).schema
    place, wide, given = docs.columns.index(text), len(docs.columns), schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_kept(t or "", k) for t, k in zip(b.column(place).to_pylist(), b.column(wide).to_pylist(), strict=True)]
            arrays = [*b.columns[:wide], b.column(wide + 1), pa.array([n for _, n in made], pa.int64())]
            arrays[place] = pa.array([t for t, _ in made], b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, names=given)

    return met.mapInArrow(apply, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = deduplicated(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents
), l as (
  select doc_id, i, w[i] as line, translate(trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)
), k as (
  select k, max(doc_id) as head from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), m as (
  select doc_id, i, line, coalesce(doc_id <> head, false) as gone from l left join k using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
