import json
from datetime import datetime, timedelta

from corpusloom.streaming import bench
from pyspark.sql import functions as F


def log(n, minutes=5, start=datetime(2024, 1, 1), reason="Too many requests"):
    return [("e", start + timedelta(minutes=minutes * k), k, False, reason) for k in range(n)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "engine string, at timestamp, seq long, answered boolean, reason string")
    return [(r.action, r.hours, r.strikes) for r in bench.bench_batch(df).orderBy("at").collect()]


def test_benched_after_a_streak(spark):
    assert run(spark, log(9)) == [] and run(spark, log(10)) == [("benched", 6, 1)]
    assert run(spark, log(20, minutes=1)) == [] and run(spark, log(30, reason="timeout")) == []


def test_extended_and_cleared(spark):
    start = datetime(2024, 1, 1)
    rows = log(10)
    at = start + timedelta(hours=7)
    rows.append(("e", at, 100, False, "captcha"))
    rows.append(("e", at + timedelta(hours=1), 101, False, "captcha"))
    rows.append(("e", at + timedelta(hours=7), 102, False, "captcha"))
    rows.append(("e", at + timedelta(hours=8), 103, True, None))
    assert run(spark, rows) == [("benched", 6, 1), ("extended", 12, 2), ("cleared", 0, 0)]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = sorted(map(tuple, bench.bench_batch(bench.engine_log(events)).collect()))
    events.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = bench.bench_stream(bench.engine_log(stream)).writeStream.format("memory").queryName("bench").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bench").collect())) == want


def test_watermarked_windows_close(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = bench.tumbling(stream, late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    whole = {(r.start, r.event_type): r.n for r in bench.tumbling(events).collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_replay_skips_torn_lines(spark, tmp_path):
    good = [{"run_id": "r", "seq": k, "type": "log", "at": "2024-01-01T00:00:00", "message": "m"} for k in (1, 2, 3, 3)]
    (tmp_path / "events.jsonl").write_text("\n".join(map(json.dumps, good)) + '\n{"run_id": "r", "se')
    assert sorted(r.seq for r in bench.replay(spark, str(tmp_path), after=1).collect()) == [2, 3]
