"""Stored tables and their versions; captions in three formats."""

import os

import pytest
from corpusloom.functions import captions
from corpusloom.operators import store
from pyspark.sql import functions as F

RUN = "id long, status string"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("version", range(len(store.RUN_STEPS) + 1))
def test_every_version_comes_to_the_last_one(spark, version):
    first = spark.createDataFrame([(1, "a"), (2, "b")], RUN)
    there = store.migrated(first, 0, store.RUN_STEPS[:version])
    got = store.migrated(there, version)
    assert got.columns == store.migrated(first, 0).columns and sorted(map(str, got.collect())) == sorted(map(str, store.migrated(first, 0).collect()))
    assert sorted(map(str, store.migrated(got, version).collect())) == sorted(map(str, got.collect()))  # a step may be taken again
    assert got.first().kind == "research" and got.first().use_prior is True and got.first().has_matrix is None


def test_a_stored_table_migrates_once(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/runs", "id", store.RUN_STEPS)
    assert t.version() is None
    t.create(spark.createDataFrame([(k, "x", 0) for k in range(50)], f"{RUN}, has_matrix int"), 6)
    (tmp_path / "runs" / "v0008").mkdir()  # an attempt that was cut short
    (tmp_path / "runs" / "v0008" / "part-torn.parquet").write_bytes(b"torn")
    assert t.version() == 6 and t.migrate() == 2 and t.version() == 8 and t.migrate() == 0
    assert rows(t.read(), "id", "has_matrix") == [(k, None) for k in range(50)]


def files(path):
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_touch_only_the_buckets_of_their_keys(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/runs", "id")
    t.create(spark.createDataFrame([(k, f"s{k}") for k in range(200)], RUN))
    before = files(tmp_path)
    keys = spark.createDataFrame([(7,), (7,), (9999,)], "id long")
    t.update(keys, {"status": F.concat(F.col("status"), F.lit("!"))})
    assert dict(rows(t.read(), "id", "status")) == {k: f"s{k}!" if k == 7 else f"s{k}" for k in range(200)}
    gone = before - files(tmp_path)
    assert 1 <= len(gone) <= 2 and len(before) == store.BUCKETS
    t.upsert(spark.createDataFrame([(7, "a"), (7, "c"), (500, "new")], RUN), "status")
    t.insert(spark.createDataFrame([(600, "more")], RUN))
    want = {k: f"s{k}" for k in range(200)} | {7: "c", 500: "new", 600: "more"}
    assert dict(rows(t.read(), "id", "status")) == want
    t.delete(spark.createDataFrame([(3,), (600,), (9999,)], "id long"))
    assert dict(rows(t.read(), "id", "status")) == {k: v for k, v in want.items() if k not in (3, 600)}
    t.delete(spark.range(1000).select("id"))
    assert t.read().count() == 0 if files(tmp_path) else True


def test_a_bucket_that_is_left_empty_is_dropped(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", "id")
    t.create(spark.createDataFrame([(1, "a"), (2, "b")], RUN))
    t.delete(spark.createDataFrame([(1,)], "id long"))
    assert rows(t.read(), "id", "status") == [(2, "b")]


# ----------------------------------------------------------------------------------------------------------------------
JSON3 = '{"wireMagic":"pb3","events":[{"tStartMs":0,"id":1},{"tStartMs":1200,"dDurationMs":900,"segs":[{"utf8":"Hello "},{"utf8":"there\\n  you"}]},{"tStartMs":3000,"segs":[{"utf8":"\\n"}]},{"segs":[{"x":1},{"utf8":"end"}]}]}'
SRV1 = '<?xml version="1.0" encoding="utf-8" ?><transcript><text start="1.2" dur="0.9">Hello &amp;amp; you</text><text start="2"> </text><text>no\ntime</text></transcript>'
SRV3 = '\n<timedtext format="3"><head><pen id="1"/></head><body><p t="1200" d="900"><s>Hello</s><s t="300"> there</s></p><p t="1800" a="1">\n</p><p t="x">tail</p></body></timedtext>'


def test_three_formats_and_none(spark):
    bodies = [JSON3, SRV1, SRV3, "", None, "{torn", "<torn", "plain", "{}", '{"events":null}', "<a/>"]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r.k: (None if r.x is None else [tuple(x) for x in r.x], r.t) for r in df.select("k", captions.caption_lines(F.col("body")).alias("x"), captions.caption_text(F.col("body")).alias("t")).collect()}
    assert got[0] == ([(1.2, 0.9, "Hello there you"), (None, None, "end")], "Hello there you\nend")
    assert got[1] == ([(1.2, 0.9, "Hello &amp; you"), (None, None, "no time")], "Hello &amp; you\nno time")
    assert got[2] == ([(1.2, 0.9, "Hello there"), (None, None, "tail")], "Hello there\ntail")
    assert got[4] == (None, None) and all(got[k] == ([], "") for k in (3, 5, 6, 7, 8, 9, 10))


def test_authored_english_tracks_come_first(spark):
    track = "array<struct<languageCode:string,kind:string,url:string>>"
    cases = [([("de", None, "a"), ("en", "asr", "b"), ("en-GB", None, "c"), ("en", None, "d")], "c"), ([("de", "asr", "a"), ("EN", "asr", "b")], "b"), ([("fr", "asr", "a"), (None, None, "b"), ("de", None, "c")], "b"), ([("fr", "asr", "a")], "a"), ([], None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], f"k int, tracks {track}")
    assert {r.k: r.url for r in df.select("k", captions.picked_track(F.col("tracks"))["url"].alias("url")).collect()} == {k: u for k, (_, u) in enumerate(cases)}
