"""Keyed state on streams: admission under a rolling budget, and the state of knowledge components.

Rows of one key and micro-batch are taken in the order of their time. Admission needs a
user's charges in order, so its key is the user; what is kept is the window's admitted
charges only, and a timer forgets a user after an idle window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_admission(charges: DataFrame, seconds: int, limit: float, lateness: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, admitted) of a stream of (event_id, user_id, us, cost): refused while the admitted cost of the window is at the limit."""
    width = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, costs = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        ok = []
        for t, c in zip(rows["us"].tolist(), rows["cost"].fillna(0.0).tolist()):
            while times and times[0] <= t - width:
                times.pop(0)
                costs.pop(0)
            ok.append(sum(costs) < limit)
            if ok[-1]:
                times.append(t)
                costs.append(c)
        state.update((times, costs))
        state.setTimeoutTimestamp(max(int(rows["us"].max()) + width, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "admitted": ok})

    timed = charges.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, admitted boolean", "times array<bigint>, costs array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_components(attempts: DataFrame) -> DataFrame:
    """(user, domain, topic, subtopic, attempted, correct, status, updated) for update or complete mode: the last attempt decides the status."""
    last = F.max_by(F.when(F.col("ok"), "known").otherwise("unknown"), F.struct("at", "attempt_id"))
    return attempts.groupBy("user", "domain", "topic", "subtopic").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("correct"), last.alias("status"), F.max("at").alias("updated"))


def append_events(stream: DataFrame, path: str, checkpoint: str, every: str = "30 seconds"):  # noqa: ANN201
    """Start writing a stream of events to a table, appended each interval; the query is returned."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
