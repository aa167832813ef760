"""When a model has sat idle: no call for so many seconds and none in flight. Once per spell of use.

``idle_spells`` reads finished calls as a batch; ``idle_stream`` follows their starts and ends with a state of three values
per model and a timer on event time, which fires when the watermark has passed it, with or without further calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECONDS = 900
OUT = "model string, since timestamp, at timestamp"
_STATE = "flying long, last timestamp, used boolean"


def idle_spells(calls: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """(model, since, at) out of calls (model, start, end): ``since`` the last call ended, and ``seconds`` later, ``at``, none
    had begun. The last spell of every model counts. A call that ends before it starts lasts no time; one without a start
    is none, and one without an end is in flight for good."""
    calls = calls.where("start is not null").select("model", "start", F.when(F.col("end").isNotNull(), F.greatest("start", "end")).alias("end"))
    far = F.to_timestamp(F.lit("9999-12-31 00:00:00"))
    ends = F.coalesce("end", far)
    before = F.max(ends).over(W.partitionBy("model").orderBy("start", ends).rowsBetween(W.unboundedPreceding, -1))
    gaps = calls.select("model", F.col("start").alias("next"), before.alias("since")).where("since is not null")
    gaps = gaps.unionByName(calls.groupBy("model").agg(F.lit(None).cast("timestamp").alias("next"), F.max(ends).alias("since")))
    at = F.timestamp_add("SECOND", F.lit(seconds), "since")
    return gaps.where(F.col("since") < far).withColumn("at", at).where(F.col("next").isNull() | (F.col("next") >= F.col("at"))).select("model", "since", "at")


def call_events(calls: DataFrame) -> DataFrame:
    """(model, at, step) of calls (model, start, end): 1 where one begins, -1 where it ends."""
    rows = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.greatest("start", "end").alias("at"), F.lit(-1).alias("step")))
    return calls.select("model", F.explode(rows).alias("e")).select("model", "e.at", "e.step").where("at is not null")


def idle_stream(events: DataFrame, seconds: int = SECONDS, late: str = "1 minute") -> DataFrame:
    """The same from a stream of ``call_events``. Events later than the watermark are ignored."""
    wait = pd.Timedelta(seconds=seconds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flying, last, used = state.get if state.exists else (0, None, False)
        last = None if last is None or pd.isna(last) else pd.Timestamp(last)
        out = []

        def idle() -> None:
            nonlocal used
            out.append((key[0], last, last + wait))
            used = False

        if state.hasTimedOut:
            if used and not flying:
                idle()
        else:
            # Of events at one moment starts come first, so that a call that follows at once leaves no gap.
            for at, step in pd.concat(list(batches)).sort_values(["at", "step"], ascending=[True, False])[["at", "step"]].itertuples(index=False):
                if used and not flying and at - last >= wait:
                    idle()
                flying += int(step)
                used, last = True, at if last is None else max(last, at)
            due = used and not flying
            if due and (last + wait).timestamp() * 1000 <= state.getCurrentWatermarkMs():
                idle()
            elif due:
                state.setTimeoutTimestamp(int((last + wait).timestamp() * 1000))
        state.update((flying, last, used))
        yield pd.DataFrame(out, columns=["model", "since", "at"])

    watched = events.withWatermark("at", late)
    return watched.groupBy("model").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _calls(spark, d):
    """Every event as a call of its user's model that lasts as many seconds as its value says."""
    from ..sources import views

    e = views.table(spark, d, "events")
    return e.select(F.concat(F.lit("m"), F.col("user_id")).alias("model"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.floor(F.col("value")).cast("int"), "ts").alias("end"))


QUERIES = {
    "idle_spells": (
        lambda s, d: idle_spells(_calls(s, d), 3600).select("model", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")),
        """with c as (select 'm' || user_id as model, ts as s, ts + to_seconds(cast(greatest(floor(value), 0) as bigint)) as e from events),
        g as (select model, s as next, max(e) over (partition by model order by s, e rows between unbounded preceding and 1 preceding) as since from c union all select model, null, max(e) from c group by model)
        select model, strftime(since, '%Y-%m-%d %H:%M:%S') as since, strftime(since + interval 1 hour, '%Y-%m-%d %H:%M:%S') as at from g where since is not null and (next is null or next >= since + interval 1 hour)""",
    ),
}
