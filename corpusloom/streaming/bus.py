"""The event bus as files and streams: append, replay then live, counters, memory across runs, and what is due.

Every function takes a DataFrame that may be a batch or a stream, so the batch result is the stream's in the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import views

EVENT = "run_id string, seq bigint, type string, at timestamp, url string, engine string, message string"
#: Events that are shown and never logged (a fixed value).
EPHEMERAL = ("stream",)


def logged(events: DataFrame) -> DataFrame:
    return events.where(~F.col("type").isin(*EPHEMERAL))


def append(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of events as JSON lines; a finished run of the query continues where it stopped."""
    return logged(events).writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)


def followed(spark: SparkSession, folder: str, after: int = 0, late: str = "10 minutes") -> DataFrame:
    """A log as a stream: what is there first, then what comes, each event once; torn lines are skipped."""
    log = spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(folder)
    return log.where((F.col("seq") > after) & F.col("type").isNotNull()).withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def counters(events: DataFrame) -> DataFrame:
    """Per run and engine the pages read and kept so far and the cap that follows; a stream of it is in update mode."""
    made = events.where(F.col("type").isin("finding", "skipped")).groupBy("run_id", "engine")
    made = made.agg(F.count(F.lit(1)).alias("read"), F.count(F.when(F.col("type") == "finding", 1)).alias("kept"))
    return made.withColumn("cap", F.least(F.lit(6), 2 + F.col("kept")).cast("int"))


def unreported(events: DataFrame, reported: DataFrame) -> DataFrame:
    """Events whose page no earlier run has reported: a stream against a table. Events without a page stay."""
    known = reported.select(F.col("url").alias("_known")).where("_known is not null").distinct().withColumn("_seen", F.lit(True))
    return events.join(known, F.col("url") == F.col("_known"), "left").where("_seen is null").drop("_known", "_seen")


def refusals_since(events: DataFrame, before: DataFrame) -> DataFrame:
    """Per run the engines that refused after the run's last round began, with their latest reason."""
    rows = events.where("type = 'refused'").join(before.select("run_id", F.col("seq").alias("_from")), "run_id").where(F.col("seq") > F.col("_from"))
    return rows.groupBy("run_id", "engine").agg(F.max_by("message", "seq").alias("message"))


def due(tasks: DataFrame, now, every_hours: int = 24) -> DataFrame:
    """Daily tasks that never ran or ran ``every_hours`` ago or more."""
    age = (now.cast("timestamp").cast("double") - F.col("last_run").cast("timestamp").cast("double")) / 3600
    return tasks.where(F.col("daily") & (F.col("last_run").isNull() | (age >= every_hours)))


def schedule(ticks: DataFrame, tasks, enqueue, checkpoint: str) -> StreamingQuery:
    """On each batch of ``ticks`` (at) takes the due ones of ``tasks()`` as of its latest time and hands them to ``enqueue``."""

    def step(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max("at")).first()[0]
        if now is not None:
            enqueue(due(tasks(), F.lit(now)).withColumn("last_run", F.lit(now)))

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def of_events(events: DataFrame) -> DataFrame:
    """The driver's event table as a bus."""
    kind = F.when(F.col("event_type") == "purchase", "finding").when(F.col("event_type") == "error", "refused").when(F.col("event_id") % 4 == 0, "stream").otherwise("skipped")
    return events.select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 200)).alias("run_id"),
        F.col("event_id").alias("seq"),
        kind.alias("type"),
        F.col("ts").alias("at"),
        F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".org/"), F.col("event_id") % 9)).alias("url"),
        F.concat(F.lit("e"), F.col("user_id") % 6).alias("engine"),
        F.concat(F.lit("m"), F.col("event_id") % 5).alias("message"),
    )


def _bus(spark, d):
    return of_events(views.table(spark, d, "events"))


_B = """b as (select 'r' || (event_id // 200) as run_id, event_id as seq, case when event_type = 'purchase' then 'finding' when event_type = 'error' then 'refused' when event_id % 4 = 0 then 'stream' else 'skipped' end as type,
  ts as at, case when event_id % 7 > 0 then 'https://u' || user_id || '.org/' || (event_id % 9) end as url, 'e' || (user_id % 6) as engine, 'm' || (event_id % 5) as message from events)"""
QUERIES = {
    "logged_events": (
        lambda s, d: logged(_bus(s, d)).where("seq > 50").groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")),
        f"with {_B} select run_id, type, count(*) as n, max(seq) as last from b where type <> 'stream' and seq > 50 group by all",
    ),
    "run_counters": (
        lambda s, d: counters(_bus(s, d)),
        f"with {_B} select run_id, engine, count(*) as read, count(*) filter (type = 'finding') as kept, cast(least(6, 2 + count(*) filter (type = 'finding')) as int) as cap from b where type in ('finding', 'skipped') group by all",
    ),
    "unreported_events": (
        lambda s, d: unreported(_bus(s, d).where("seq % 3 = 0"), _bus(s, d).where("type = 'finding' and seq % 3 > 0")).select("seq", "run_id"),
        f"with {_B} select seq, run_id from b where seq % 3 = 0 and (url is null or url not in (select url from b where type = 'finding' and seq % 3 > 0 and url is not null))",
    ),
    "round_refusals": (
        lambda s, d: refusals_since(_bus(s, d), _bus(s, d).groupBy("run_id").agg(F.floor(F.avg("seq")).alias("seq"))),
        f"with {_B}, f as (select run_id, floor(avg(seq)) as f from b group by run_id) select run_id, engine, max_by(message, seq) as message from b join f using (run_id) where type = 'refused' and seq > f group by all",
    ),
    "due_tasks": (
        lambda s, d: due(views.runs(s, d).select("id", (F.col("id") % 2 == 0).alias("daily"), F.when(F.col("id") % 3 > 0, F.col("created_at")).alias("last_run")), F.lit("1996-06-01"), 24 * 500).select("id"),
        f"with {views.RUNS_SQL} select id from runs where id % 2 = 0 and (id % 3 = 0 or epoch(timestamp '1996-06-01') - epoch(cast(created_at as timestamp)) >= 24 * 500 * 3600)",
    ),
}
