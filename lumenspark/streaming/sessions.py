"""The session operator on a stream: state and an event-time timer for each user.

An entry opens the user's session or lengthens it and resets the timer; when the
watermark passes the last entry by the gap, the session is emitted and forgotten.
Entries that come later than the watermark allows are dropped by Spark. Within the
allowed lateness entries may be unordered and delivered again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_name string, start_ms bigint, end_ms bigint, n_events bigint"
_STATE = "starts array<bigint>, ends array<bigint>, counts array<bigint>"


def _step(gap_us: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, counts = (list(x) for x in state.get) if state.exists else ([], [], [])
        open_ = list(zip(starts, ends, counts))
        if not state.hasTimedOut:
            for rows in batches:
                for us in rows["us"].tolist():
                    # An entry may bridge sessions that were apart until now.
                    near = [s for s in open_ if s[0] - gap_us <= us <= s[1] + gap_us]
                    open_ = [s for s in open_ if s not in near]
                    open_.append((min([us, *(s[0] for s in near)]), max([us, *(s[1] for s in near)]), 1 + sum(s[2] for s in near)))
        now = state.getCurrentWatermarkMs() * 1000
        done = [s for s in open_ if s[1] + gap_us < now]
        open_ = sorted(s for s in open_ if s[1] + gap_us >= now)
        if open_:
            state.update(tuple(map(list, zip(*open_))))
            state.setTimeoutTimestamp(max(open_[0][1] + gap_us, now + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_name": [key[0]] * len(done), "start_ms": [s[0] // 1000 for s in done], "end_ms": [s[1] // 1000 for s in done], "n_events": [s[2] for s in done]})

    return step


def stream_sessions(entries: DataFrame, gap_ms: int = 900_000, lateness: str = "1 hour") -> DataFrame:
    """Sessions of a stream of (user_name, us, list, name, question_id), as activity_entries gives them."""
    timed = entries.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    once = timed.dropDuplicatesWithinWatermark(["user_name", "us", "list", "name", "question_id"])
    return once.groupBy("user_name").applyInPandasWithState(_step(gap_ms * 1000), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
