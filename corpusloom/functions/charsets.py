"""Bytes of pages as text, in the encoding they were written in.

The rungs, in order: UTF-8 without a fault; UTF-8 cut within its last character; the charset that the server named; the one
that the page names in a meta tag; Windows-1252; UTF-8 with faults replaced. The single-byte rung is native: Latin-1 with
its control range put in the places that Windows-1252 has for it. Only rows whose named charset is another one go to Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import views

# Labels that browsers read as windows-1252.
AS_CP1252 = ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "l1", "us-ascii", "ascii", "windows-1252")
_META = r"(?i)<meta[^>]{0,200}?charset\s*=\s*[\"']?([A-Za-z0-9._-]+)"
_UTF8 = ("utf-8", "utf8", "")
#: The bytes 0x80 to 0x9F that Windows-1252 has characters for, as Latin-1 reads them, and those characters.
_HIGH = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_NONE = "[\x81\x8d\x8f\x90\x9d]"


def _label(name: Column) -> Column:
    return F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit("-"))


def _utf8(body: Column) -> Column:
    """The body if it is UTF-8, up to three bytes of a last character that was cut off; else null."""
    text, n = body.cast("string"), F.octet_length(body)
    cut = [F.when(n >= k, F.substring(body, F.lit(1), n - k)).cast("string") for k in (1, 2, 3)]
    return F.coalesce(*[F.when(F.is_valid_utf8(t), t) for t in (text, *cut)])


def _cp1252(body: Column) -> Column:
    text = F.decode(body, "ISO-8859-1")
    return F.when(~text.rlike(_NONE), F.translate(text, "".join(a for a, _ in _HIGH), "".join(b for _, b in _HIGH)))


@F.pandas_udf(T.StringType())
def _named(body: pd.Series, label: pd.Series) -> pd.Series:
    """The body in a named charset; null where the name or the bytes are none of it, or no name is given."""

    def one(b, name):
        try:
            return None if b is None or not name else bytes(b).decode(name)
        except (LookupError, ValueError, TypeError):
            return None

    return pd.Series([one(b, n) for b, n in zip(body, label, strict=True)], dtype=object)


def decoded(body: Column, charset: Column) -> Column:
    """The text of ``body`` (binary); ``charset`` is the server's word for it, or null. A null body is null."""
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")

    def rung(label: Column) -> Column:
        single = (label == "cp1252") | label.isin(*AS_CP1252)
        other = ~single & ~label.isin(*_UTF8) & _utf8(body).isNull()
        return F.coalesce(F.when(single, _cp1252(body)), _named(F.when(other, body), F.when(other, label)))

    # cp1252 reads any bytes but five; what no rung reads is UTF-8 with replaced faults.
    return F.coalesce(_utf8(body), rung(_label(charset)), rung(_label(F.regexp_extract(head, _META, 1))), _cp1252(body), F.make_valid_utf8(body.cast("string")))


def _encoded(spark, d):
    """Pages as bytes: UTF-8, Latin-1 that says so, Latin-1 that names itself in a meta tag, UTF-16 and Latin-1 without a word."""
    p = views.table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    k = F.col("page_id") % 5
    plain = F.regexp_replace("html", "[^\\x{01}-\\x{7f}\\x{a0}-\\x{ff}]", "?")
    meta = F.concat(F.lit("<meta charset='ISO_8859-1'>"), plain)
    html = F.when(k.isin(0, 3), F.col("html")).when(k == 2, meta).otherwise(plain)
    body = F.when(k == 0, F.encode(html, "UTF-8")).when(k == 3, F.encode(html, "UTF-16")).otherwise(F.encode(html, "ISO-8859-1"))
    return p.select("page_id", body.alias("body"), F.when(k == 1, "Latin1").when(k == 3, "utf-16").alias("charset"))


_PLAIN = "regexp_replace(coalesce(html, ''), '[^\\x{01}-\\x{7f}\\x{a0}-\\x{ff}]', '?', 'g')"
QUERIES = {
    "decoded_pages": (
        lambda s, d: _encoded(s, d).select("page_id", decoded(F.col("body"), F.col("charset")).alias("text")).select("page_id", F.length("text").alias("n"), F.md5("text").alias("digest")),
        f"""with t as (select page_id, case page_id % 5 when 0 then coalesce(html, '') when 3 then coalesce(html, '') when 2 then '<meta charset=''ISO_8859-1''>' || {_PLAIN} else {_PLAIN} end as text from pages)
        select page_id, cast(length(text) as int) as n, md5(text) as digest from t""",
    ),
}
