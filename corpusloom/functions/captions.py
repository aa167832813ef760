"""Captions of videos: three payload formats to one list of timed lines, and the track to ask for.

JSON payloads are read natively; XML ones, whose lines hold text between and inside elements, by a parser in Arrow batches.
A payload that is torn, or neither, has no lines; a line without words is none.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import views

LINE = "struct<start:double,length:double,text:string>"
_EVENTS = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"
_LINES = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("length", T.DoubleType()), T.StructField("text", T.StringType())]))


@F.udf(_LINES, useArrow=True)
def _of_xml(body):
    if body is None:
        return None
    try:
        root = ET.fromstring(body)
    except (ET.ParseError, ValueError):
        return []
    out = []
    for node in root.iter():
        if node.tag in ("text", "p"):
            # Seconds in the older format, milliseconds in the newer one.
            scale, names = (1.0, ("start", "dur")) if node.tag == "text" else (1000.0, ("t", "d"))
            at = []
            for name in names:
                try:
                    at.append(float(node.get(name)) / scale)
                except (TypeError, ValueError):
                    at.append(None)
            text = " ".join("".join(node.itertext()).split())
            if text:
                out.append({"start": at[0], "length": at[1], "text": text})
    return out


def caption_lines(body: Column) -> Column:
    """(start, length, text) in seconds of a payload (text); null where there is none."""
    head = F.substring(F.ltrim(body, F.lit(" \t\r\n\x0b\x0c")), 1, 1)
    events = F.from_json(body, _EVENTS)["events"]
    said = lambda e: F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    lines = F.transform(events, lambda e: F.struct((e["tStartMs"] / 1000).alias("start"), (e["dDurationMs"] / 1000).alias("length"), F.trim(F.regexp_replace(said(e), r"(?U)\s+", " ")).alias("text")))
    plain = F.filter(F.coalesce(lines, F.array().cast(f"array<{LINE}>")), lambda x: x["text"] != "")
    return F.when(body.isNull(), None).when(head == "{", plain).when(head == "<", _of_xml(F.when(head == "<", body))).otherwise(F.array().cast(f"array<{LINE}>"))


def caption_text(body: Column) -> Column:
    return F.array_join(F.transform(caption_lines(body), lambda x: x["text"]), "\n")


def picked_track(tracks: Column) -> Column:
    """Of tracks (languageCode, kind, ...) the one to read: English ones first, authored before recognised, then the first."""
    rank = lambda t, i: F.struct((~F.lower(F.coalesce(t["languageCode"], F.lit(""))).startswith("en")).alias("a"), F.coalesce(t["kind"] == "asr", F.lit(False)).alias("b"), i.alias("i"), t.alias("t"))
    return F.array_min(F.transform(tracks, rank))["t"]


def _payloads(spark, d):
    """Documents' lines as captions: in each format by turns, every fourth payload torn."""
    docs = views.table(spark, d, "documents").where("text is not null").select("doc_id", F.split(F.regexp_replace("text", "[\\x{0}-\\x{9}\\x{b}-\\x{1f}\\\\\"&<>  ]", " "), "\n").alias("l"))
    each = lambda f, sep: F.array_join(F.transform("l", f), sep)
    json = F.concat(F.lit('{"events":[{"id":1},'), each(lambda x, i: F.concat(F.lit('{"tStartMs":'), i * 1500, F.lit(',"segs":[{"utf8":"'), x, F.lit('"},{"utf8":" !"}]}')), ","), F.lit("]}"))
    old = F.concat(F.lit("<?xml version='1.0'?><transcript>"), each(lambda x, i: F.concat(F.lit('<text start="'), i * 1.5, F.lit('">'), x, F.lit(" !</text>")), ""), F.lit("</transcript>"))
    new = F.concat(F.lit(" <timedtext><body>"), each(lambda x, i: F.concat(F.lit('<p t="'), i * 1500, F.lit('"><s>'), x, F.lit("</s> !</p>")), ""), F.lit("</body></timedtext>"))
    k = F.col("doc_id") % 4
    return docs.select("doc_id", F.when(k == 0, json).when(k == 1, old).when(k == 2, new).otherwise(F.concat(F.lit("<transcript><text>"), F.col("doc_id"))).alias("body"))


QUERIES = {
    "caption_texts": (
        lambda s, d: _payloads(s, d).select("doc_id", caption_lines(F.col("body")).alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join(F.transform("x", lambda y: y["text"]), "\n")).alias("digest"), F.round(F.coalesce(F.array_max(F.transform("x", lambda y: y["start"])), F.lit(-1.0)), 1).alias("last")),
        r"""with l as (select doc_id, list_transform(string_split(regexp_replace(text, '[\x{0}-\x{9}\x{b}-\x{1f}\\"&<>' || chr(8232) || chr(8233) || ']', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x || ' !', '\s+', ' ', 'g'))) as l from documents where text is not null)
        select doc_id, case when doc_id % 4 = 3 then 0 else cast(len(l) as int) end as n, md5(case when doc_id % 4 = 3 then '' else array_to_string(l, chr(10)) end) as digest, case when doc_id % 4 = 3 then -1.0 else round((len(l) - 1) * 1.5, 1) end::double as last from l""",
    ),
}
