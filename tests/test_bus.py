import json
from datetime import datetime, timedelta

from corpusloom.streaming import bus
from pyspark.sql import functions as F


def _events(spark, sf):
    return bus.of_events(spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").limit(400))


def _line(seq, kind="finding", run="r", at=datetime(2024, 1, 1)):
    return json.dumps({"run_id": run, "seq": seq, "type": kind, "at": (at + timedelta(seconds=seq)).isoformat(), "url": f"u{seq}", "engine": "e", "message": "m"})


def test_appended_then_followed_once(spark, sf, tmp_path):
    events = _events(spark, sf)
    events.coalesce(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    bus.append(source, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    # A folder of the sink lists its own files alone, so the log is read from a copy to which another writer adds lines.
    (tmp_path / "copy").mkdir()
    for f in (tmp_path / "log").glob("part-*.json"):
        (tmp_path / "copy" / f.name).write_bytes(f.read_bytes())
    (tmp_path / "copy" / "torn.json").write_text(_line(7, run="x") + "\n" + _line(7, run="x") + "\n" + _line(8, run="x")[:30] + "\n")
    live = bus.followed(spark, str(tmp_path / "copy"), after=5)
    q = live.writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.run_id, r.seq) for r in spark.table("followed").collect())
    want = sorted((r.run_id, r.seq) for r in bus.logged(events).where("seq > 5").collect()) + [("x", 7)]
    assert got == sorted(want) and not [r for r in spark.table("followed").collect() if r.type == "stream"]


def test_counters_and_memory_of_a_stream_equal_the_batch(spark, sf, tmp_path):
    events = _events(spark, sf)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    reported = events.where("type = 'finding' and seq % 2 = 0").select("url")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bus.counters(stream).writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, bus.counters(events).collect()))
    q = bus.unreported(stream, reported).select("seq").writeStream.format("memory").queryName("unreported").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("unreported").collect()) == sorted(r.seq for r in bus.unreported(events, reported).collect())


def test_schedule_takes_what_is_due(spark, tmp_path):
    rows = [("never", True, None), ("old", True, datetime(2024, 1, 1)), ("new", True, datetime(2024, 1, 2, 12)), ("off", False, None)]
    tasks = spark.createDataFrame(rows, "id string, daily boolean, last_run timestamp")
    spark.createDataFrame([(datetime(2024, 1, 3),)], "at timestamp").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("at timestamp").parquet(str(tmp_path / "ticks"))
    got = []
    bus.schedule(ticks, lambda: tasks, lambda df: got.extend(r.id for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(got) == ["never", "old"]
    assert bus.due(tasks, F.lit(datetime(2024, 1, 2))).count() == 2
