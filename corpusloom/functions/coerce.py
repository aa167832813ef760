"""Forgiving coercion of model output, labels and dates: clip, clamp, drop bad elements, never fail a row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views

# Fixed values.
RECENCY_DAYS = {"week": 8, "month": 32, "3months": 93, "6months": 186, "year": 370, "3years": 1100}
SOURCE_TYPES = ("standard", "paper", "vendor", "news", "forum", "blog", "aggregator")


def enum(value: Column, allowed, default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def depth(value: Column) -> Column:
    v = value.try_cast("int")  # least and greatest skip nulls
    return F.when(v.isNull(), 3).otherwise(F.least(F.greatest(v, F.lit(1)), F.lit(10)))


def id_list(values: Column, most: int = 8) -> Column:
    """Numbers out of strings such as "[33]"; what has no digit goes."""
    digits = F.filter(F.transform(values, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: x != "")
    return F.slice(F.transform(digits, lambda x: x.try_cast("int")), 1, most)


def clean_list(values: Column, most: int, chars: int = 200) -> Column:
    """Trimmed, without blanks and repeats, lower case, at most ``most``."""
    kept = F.filter(F.transform(values, lambda x: F.substring(F.lower(F.trim(x)), 1, chars)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(kept), 1, most)


def aligned(first: Column, second: Column) -> Column:
    """Pairs by position, the second list padded with blanks; pairs with a blank first go."""
    zipped = F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda x: F.struct(x["a"].alias("a"), F.coalesce(x["b"], F.lit("")).alias("b")))
    return F.filter(zipped, lambda x: x["a"].isNotNull() & (F.trim(x["a"]) != ""))


def recency_cutoff(now: Column, recency: str) -> Column:
    return F.date_sub(now, RECENCY_DAYS[recency])


def within_recency(published: Column, cutoff: Column, living: Column | None = None) -> Column:
    """Undated pages stay; a living page counts as undated."""
    dated = published if living is None else F.when(~living, published)
    return dated.isNull() | (dated >= cutoff)


def published(text: Column) -> Column:
    """A date out of ISO or feed notation, else null; the offset is dropped."""
    iso = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    feed = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy"))
    return F.to_date(F.coalesce(iso, feed))


def duration_label(seconds: Column) -> Column:
    m = seconds / 60
    return F.when(m < 1.5, "about a minute").when(m < 60, F.concat(F.lit("about "), F.bround(m).cast("int"), F.lit(" min"))).otherwise(F.concat(F.lit("about "), F.format_string("%.1f", m / 60), F.lit(" h")))


def sources_label(low: Column, high: Column) -> Column:
    return F.when(low == high, F.concat(F.lit("~"), low, F.lit(" sources"))).otherwise(F.concat(low, F.lit("–"), high, F.lit(" sources")))


def _ascii(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slug(text: Column, most: int = 40) -> Column:
    """Letters and digits joined by dashes; accents and other marks are taken off by the compatibility decomposition, for
    which there is no built-in function."""
    plain = F.lower(F.regexp_replace(F.pandas_udf(_ascii, "string")(text), r"[^a-zA-Z0-9]+", "-"))
    cut = F.regexp_replace(F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, most), r"-+$", "")
    return F.when(cut == "", F.lit("research")).otherwise(cut)


def merged_stats(rows: DataFrame, key: str, stats: str) -> DataFrame:
    """JSON statistics summed per key; what does not parse is left out."""
    parsed = rows.select(key, F.from_json(stats, "map<string,double>").alias("m")).where(F.col("m").isNotNull())
    return parsed.select(key, F.explode("m").alias("name", "value")).groupBy(key, "name").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


def _events(spark, d):
    return views.table(spark, d, "events")


def _coerced(spark, d):
    raw = F.array(F.concat(F.lit("["), F.col("event_id") % 50, F.lit("]")), F.lit("none"), F.concat(F.lit(" "), F.col("user_id"), F.lit(" ")), F.lit(""))
    e = _events(spark, d)
    return e.select(
        "event_id",
        enum(F.initcap("event_type"), ("click", "view"), "other").alias("action"),
        depth(F.when(F.col("event_id") % 7 == 0, "junk").otherwise((F.col("event_id") % 30 - 5).cast("string"))).alias("depth"),
        F.array_join(id_list(raw).cast("array<string>"), ",").alias("ids"),
        F.array_join(clean_list(F.array("event_type", F.upper("event_type"), F.lit("  "), F.lit("X")), 2), ",").alias("names"),
        F.size(aligned(F.array("event_type", F.lit(" "), F.lit("z")), F.array(F.lit("b")))).alias("pairs"),
    )


def _recent(spark, d):
    e = _events(spark, d)
    seen = F.when(F.col("event_id") % 5 != 0, F.to_date("ts"))
    ok = within_recency(seen, recency_cutoff(F.lit("2024-01-28").cast("date"), "week"), F.col("event_type") == "view")
    return e.where(ok).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


QUERIES = {
    "coerced_fields": (
        _coerced,
        """select event_id, case when event_type in ('click', 'view') then event_type else 'other' end as action,
        cast(case when event_id % 7 = 0 then 3 else least(greatest(event_id % 30 - 5, 1), 10) end as int) as depth,
        (event_id % 50) || ',' || user_id as ids, event_type || ',x' as names, cast(2 as int) as pairs from events""",
    ),
    "recency_filter": (
        _recent,
        "select event_type, count(*) as kept from events where event_id % 5 = 0 or event_type = 'view' or cast(ts as date) >= date '2024-01-28' - 8 group by event_type",
    ),
    "json_stats": (
        lambda s, d: merged_stats(_events(s, d).withColumn("props", F.when(F.col("event_id") % 11 == 0, "{torn").otherwise(F.col("props"))), "user_id", "props"),
        """select user_id, 'k' as name, sum(cast(json_extract(props, '$.k') as double)) as value, count(*) as n from events where event_id % 11 <> 0 group by user_id""",
    ),
    "labels_and_slugs": (
        lambda s, d: views.table(s, d, "documents").select(
            "doc_id", slug(F.substring("text", 1, 60)).alias("slug"), duration_label(F.col("n_chars") * 2).alias("duration"), sources_label(F.col("doc_id") % 4, F.col("doc_id") % 3).alias("sources")
        ),
        None,
    ),
}
