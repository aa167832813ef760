"""The engine bench: a state machine per engine over its log of answers and refusals, as a batch and as a stream.

An engine that refuses LIMIT times over MINUTES or more is benched for BASE hours. When it refuses again after that, the
bench doubles, up to MOST hours; an answer clears everything. Refusals while benched and for other reasons do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, MINUTES, BASE, MOST = 10, 30, 6, 48
#: Fixed values.
REASON = re.compile("too many requests|captcha|access denied|unusual traffic", re.I)

OUT = "engine string, at timestamp, action string, hours int, strikes int"
STATE = "refusals int, first timestamp, until timestamp, strikes int"
_CLEAR = (0, None, None, 0)


def step(state: tuple, at: datetime, answered: bool, reason: str | None) -> tuple[tuple, tuple | None]:
    """The state after one event, and what it emits: (action, hours, strikes)."""
    refusals, first, until, strikes = state
    if answered:
        return _CLEAR, (("cleared", 0, 0) if until else None)
    if not REASON.search(reason or "") or (until and until > at):
        return state, None
    if until:
        hours = min(BASE * 2**strikes, MOST)
        return (refusals + 1, first, at + timedelta(hours=hours), strikes + 1), ("extended", hours, strikes + 1)
    first = first or at
    if refusals + 1 >= LIMIT and (at - first).total_seconds() // 60 >= MINUTES:
        return (refusals + 1, first, at + timedelta(hours=BASE), 1), ("benched", BASE, 1)
    return (refusals + 1, first, None, strikes), None


def _fold(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, list]:
    out = []
    for r in pdf.sort_values(["at", "seq"]).itertuples(index=False):
        state, emitted = step(state, r.at.to_pydatetime(), bool(r.answered), r.reason)
        if emitted:
            out.append((r.engine, r.at, *emitted))
    return state, out


_COLUMNS = ["engine", "at", "action", "hours", "strikes"]


def bench_batch(log: DataFrame) -> DataFrame:
    """log: engine, at, seq, answered, reason. Emits what the stream would."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(_CLEAR, pdf)[1], columns=_COLUMNS)

    return log.groupBy("engine").applyInPandas(run, OUT)


def bench_stream(log: DataFrame) -> DataFrame:
    """The same on a stream; each engine's state is four values."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else _CLEAR
        now = (now[0], *(None if x is None or pd.isna(x) else pd.Timestamp(x).to_pydatetime() for x in now[1:3]), now[3])
        rows = pd.concat(list(batches))
        now, out = _fold(now, rows)
        state.update(now)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return log.groupBy("engine").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def engine_log(events: DataFrame) -> DataFrame:
    """Answers and refusals of engines out of the event table."""
    refused = F.col("event_type").isin("error", "view", "click", "signup")
    reason = F.when(F.col("event_type") == "error", "HTTP 429 Too many requests").when(F.col("event_type") == "view", "CAPTCHA").when(F.col("event_type") == "click", "access denied").otherwise("timeout")
    return events.select(F.concat(F.lit("e"), F.col("user_id")).alias("engine"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (~refused).alias("answered"), F.when(refused, reason).alias("reason"))


def tumbling(events: DataFrame, width: str = "6 hours", late: str | None = None) -> DataFrame:
    """Counts per type and window; on a stream with a watermark."""
    if late:
        events = events.withWatermark("ts", late)
    made = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "4 hours", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    made = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def replay(spark, folder: str, after: int = 0) -> DataFrame:
    """Events of a JSON-lines log after a sequence number, once each; lines that are torn or no events are skipped."""
    schema = "run_id string, seq bigint, type string, at timestamp, message string"
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    return log.where((F.col("seq") > after) & F.col("type").isNotNull()).dropDuplicates(["run_id", "seq"])


def _events(spark, d):
    from ..sources import views

    return views.table(spark, d, "events")


QUERIES = {
    "bench_state_batch": (lambda s, d: bench_batch(engine_log(_events(s, d))), None),
    "window_counts_tumbling": (
        lambda s, d: tumbling(_events(s, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total"),
        "select strftime(time_bucket(interval '6 hours', ts, timestamp '2024-01-01'), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
    ),
    "sessions": (
        lambda s, d: sessions(_events(s, d)).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"),
        """with l as (select *, case when ts <= lag(ts) over w + interval '4 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
        i as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from l)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from i group by user_id, k""",
    ),
}
