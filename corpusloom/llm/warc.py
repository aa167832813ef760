"""Operator 7: WARC archives, index first.

Writing: payloads are digested; of records with equal payloads of at least ``MIN_DEDUP_BYTES`` the one with the
smallest page_id is the response and the others are revisits of it. Each task writes one gzip member per record into
files of its own of about ``ARCHIVE`` bytes in the shared folder and returns an index row (file, offset, length, url, digest, ...) for each. A
repeated task writes another file under another name, and only the rows of the attempt that Spark keeps name a file, so
lost executors leave unreferenced files at worst.

Reading: the selected index rows are dealt by file and byte region, sorted by offset, and neighbouring ranges are
coalesced into single reads of bounded size.

Defined results: a null html is an empty payload; a null url is an empty target. Rows that repeat the smallest page_id
of a payload are responses too; a null page_id is never the smallest unless all are null (then each is a response).
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, written

MIN_DEDUP_BYTES = 100
#: Neighbouring ranges are read together across gaps of up to GAP bytes, in reads of up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of a file that a reading task takes at a time, and at which a writing task begins another file.
REGION, ARCHIVE = 8 << 20, 256 << 20
#: Bytes of repeated digests that are broadcast to the payloads at most.
BROADCAST_BYTES = 32 << 20

INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string, refers_to bigint, payload_bytes bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, digest string, payload_bytes bigint, payload binary"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(value: str) -> str:
    """A header's value stays on one line: control characters and the escape itself are percent-encoded."""
    return "".join(c if c >= " " and c not in "%\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def parse(data: bytes) -> dict:
    from urllib.parse import unquote

    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v.strip(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {
        "page_id": number("page-id"),
        "url": unquote(fields["warc-target-uri"]),
        "record_type": fields["warc-type"],
        "refers_to": number("refers-to-page-id"),
        "digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "payload_bytes": number("payload-length"),
        "payload": block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None,
    }


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _referred(pages: DataFrame, ready: DataFrame, html, broadcast_bytes: int) -> DataFrame:
    """``ready`` (page_id, url, payload, digest) plus first_id, the response of its payload if several rows have it.

    Few repeated digests are broadcast, and payloads stay where they are. Else narrow rows find their response first, and
    payloads are moved once by page_id and digest, which deals a payload that a third of all rows hold to all tasks.
    """
    digests = pages.select("page_id", F.when(F.octet_length(html) >= MIN_DEDUP_BYTES, F.sha2(html, 256)).alias("digest")).where("digest is not null")
    # A partial minimum combines such a payload's rows before the shuffle.
    same = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    same = written(same.select("digest", "first_id"), "warc-repeated")
    if 100 * same.count() <= broadcast_bytes:
        return ready.join(F.broadcast(same), "digest", "left")
    named = digests.distinct().join(same, "digest").select("page_id", "digest", "first_id")
    met = (ready["digest"] == named["digest"]) & ready["page_id"].eqNullSafe(named["page_id"])
    return ready.join(named, met, "left").select(ready["*"], named["first_id"])


def write_archives(pages: DataFrame, folder: str, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``folder``, a URI that all executors share; returns the index."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ready = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id")).alias("refers_to")
    ready = _referred(pages, ready, html, broadcast_bytes).select("page_id", "url", "payload", "digest", refers)
    archive = ARCHIVE
    schema = _arrow(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, path, at = None, None, "", 0
        try:
            for b in batches:
                rows = []
                for row in zip(*(c for c in b.columns), strict=True):
                    page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                    if out is not None and at >= archive:
                        out.close()
                        out = None
                    if out is None:
                        store, root = _open(folder)
                        store.create_dir(root, recursive=True)
                        path, at = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    member = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((path.rsplit("/", 1)[1], at, len(member), page_id, url, digest, kind, refers_to, len(payload)))
                    at += len(member)
                yield _batch(rows, schema)
        finally:
            if out is not None:
                out.close()

    return written(ready.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the (selected) index rows, by coalesced ranged reads.

    Index rows are narrow, so their own size says nothing of the reads: the number of tasks follows from the bytes that
    they name, and a numbered repartition keeps it.
    """
    region = REGION
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // region))
    dealt = index.select("file", "offset", "length").repartition(tasks, F.col("file"), F.floor(F.col("offset") / region))
    dealt = dealt.sortWithinPartitions("file", "offset")
    schema = _arrow(RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = None, ""
        opened, name = None, None
        try:
            for b in batches:
                if store is None:
                    store, root = _open(folder)
                for file, ranges in _coalesced(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                    if file != name:
                        if opened:
                            opened.close()
                        opened, name = store.open_input_file(f"{root}/{file}"), file
                    start = ranges[0][0]
                    data = opened.read_at(ranges[-1][0] + ranges[-1][1] - start, start)
                    rows = [tuple(parse(gzip.decompress(data[o - start : o - start + n])).values()) for o, n in ranges]
                    yield _batch(rows, schema)
        finally:
            if opened:
                opened.close()

    return dealt.mapInArrow(read, RECORD)


def _coalesced(rows) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(file, ranges that one read covers) of rows in order of file and offset; repeated ranges stay repeated."""
    file, ranges = None, []
    for f, offset, length in rows:
        if ranges and (f != file or offset > ranges[-1][0] + ranges[-1][1] + GAP or offset + length - ranges[0][0] > READ):
            yield file, ranges
            ranges = []
        file = f
        ranges.append((offset, length))
    if ranges:
        yield file, ranges


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_records(index, folder)
    here = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(here, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(here, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = f"""
with p as (
  select page_id, encode(coalesce(html, '')) as b from pages
), d as (
  select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p
), m as (
  select *, case when payload_bytes >= {MIN_DEDUP_BYTES} then min(page_id) over (partition by payload_digest) else page_id end as f from d
)
select page_id, payload_bytes, payload_digest, case when page_id = f then 'response' else 'revisit' end as record_type,
  case when page_id <> f then f end as refers_to
from m
"""
