"""Sessions of user activity, found by keyed inactivity timers.

Entries are routed by (user, hour) and arrive ordered; a timer per open session
is reset by each entry and, when it expires, the session is emitted. A session
never needs more state than its own start, end and count, and no user is ever
gathered into one task: a user's hours are separate keys. Only fragments that
lie within the inactivity gap of an hour's edge can continue in the next hour;
these, at most two a user and hour, are joined up afterwards.

Defined cases: null users and entries whose time is null, unreadable or lacks
date or time of day do not count; null and empty arrays give nothing; the same
entry delivered again (user, instant, list, name, question) counts once; equal
instants belong to one session; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 900_000
HOUR_US = 3_600_000_000

_USUAL = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)?$"
_LOOSE = r"^\s*\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?([Zz]|[+-]\d\d(:?\d\d)?)?\s*$"


def iso_micros(text: Column) -> Column:
    """Epoch microseconds of a date and time in ISO form; null for all else. No offset means UTC."""

    def parsed(t: Column) -> Column:
        zoned = t.endswith("Z") | F.substring(t, -6, 1).isin("+", "-")
        return F.unix_micros(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))

    bare = F.upper(F.trim(F.translate(text, ",\t\r\n", ".   ")))
    bare = F.regexp_replace(bare, r"^(.{10}[T ]\d\d:\d\d)(?!:)", "$1:00")
    # +hh and +hhmm become +hh:mm; before the sixteenth character a sign belongs to the date.
    n = F.length(bare)
    rare = F.when(F.substring(bare, -3, 1).isin("+", "-") & (n > 16), F.concat(bare, F.lit(":00"))).when(
        F.substring(bare, -5, 1).isin("+", "-") & (n > 20), F.concat(bare.substr(F.lit(1), n - 2), F.lit(":"), F.substring(bare, -2, 2))
    ).otherwise(bare)
    return F.when(text.rlike(_USUAL), parsed(text)).when(text.rlike(_LOOSE), parsed(rare))


def activity_entries(logs: DataFrame) -> DataFrame:
    """(user_name, us, list, name, question_id): one row for each readable entry of either list."""
    none = F.lit(None).cast("bigint")
    empty = F.expr("cast(array() as array<struct<list:string,name:string,us:bigint,question_id:bigint>>)")

    def shape(kind: str, x: Column, name: str, question: Column) -> Column:
        return F.struct(F.lit(kind).alias("list"), x[name].alias("name"), iso_micros(x["timestamp"]).alias("us"), question.alias("question_id"))

    events = F.coalesce(F.transform("events", lambda x: shape("event", x, "event", none)), empty)
    clicks = F.coalesce(F.transform("button_clicks", lambda x: shape("button", x, "button", x["question_id"].cast("bigint"))), empty)
    return (
        logs.filter(F.col("user_name").isNotNull())
        .select("user_name", F.explode(F.concat(events, clicks)).alias("e"))
        .filter(F.col("e.us").isNotNull())
        .select("user_name", "e.us", "e.list", "e.name", "e.question_id")
    )


class SessionTimer:
    """The open session of the current key: entries reset its timer, expiry closes it."""

    def __init__(self, gap: int):
        self.gap, self.key, self.start, self.end, self.count = gap, None, 0, 0, 0

    def advance(self, keys: list, runs: np.ndarray, us: np.ndarray) -> list[tuple]:
        """Feed ordered distinct entries of one batch; runs holds where key or timer breaks inside the batch."""
        closed = []
        bounds = np.append(runs, len(us))
        for i, j in zip(bounds[:-1], bounds[1:]):
            key, first, last = keys[i], int(us[i]), int(us[j - 1])
            if self.key is not None and (key != self.key or first - self.end > self.gap):
                closed.append((*self.key, self.start, self.end, self.count))
                self.key = None
            if self.key is None:
                self.key, self.start, self.count = key, first, 0
            self.end, self.count = last, self.count + int(j - i)
        return closed

    def expire(self) -> list[tuple]:
        closed = [] if self.key is None else [(*self.key, self.start, self.end, self.count)]
        self.key = None
        return closed


_FRAGMENT = pa.schema([("user_name", pa.string()), ("hour", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n_events", pa.int64())])


def _timers(gap_us: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timer, before = SessionTimer(gap_us), None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_FRAGMENT.names, r)) for r in rows], schema=_FRAGMENT)

        for b in batches:
            if not b.num_rows:
                continue
            us = b.column("us").to_numpy(zero_copy_only=False)
            hour = b.column("hour").to_numpy(zero_copy_only=False)
            user, n = b.column("user_name"), b.num_rows

            def changed(c: pa.Array) -> np.ndarray:
                """Where a value differs from the one before it, nulls being equal."""
                if n == 1:
                    return np.zeros(0, bool)
                same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                null = pc.is_null(c).to_numpy(zero_copy_only=False)
                return ~(same | (null[1:] & null[:-1]))

            key = changed(user) | (hour[1:] != hour[:-1])
            fresh = np.ones(n, bool)
            fresh[1:] = key | (us[1:] != us[:-1]) | changed(b.column("list")) | changed(b.column("name")) | changed(b.column("question_id"))
            first = (user[0].as_py(), int(us[0]), b.column("list")[0].as_py(), b.column("name")[0].as_py(), b.column("question_id")[0].as_py())
            fresh[0] = first != before
            before = (user[n - 1].as_py(), int(us[n - 1]), b.column("list")[n - 1].as_py(), b.column("name")[n - 1].as_py(), b.column("question_id")[n - 1].as_py())
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            kept = us[at]
            group = np.zeros(n, np.int64)
            group[1:] = np.cumsum(key)
            breaks = np.ones(len(at), bool)
            breaks[1:] = (group[at][1:] != group[at][:-1]) | (kept[1:] - kept[:-1] > gap_us)
            runs = np.flatnonzero(breaks)
            names, hours = user.take(pa.array(at[runs])).to_pylist(), hour[at[runs]].tolist()
            keys = dict(zip(runs.tolist(), zip(names, hours)))
            if rows := timer.advance(keys, runs, kept):
                yield emit(rows)
        if rows := timer.expire():
            yield emit(rows)

    return run


def sessions_us(entries: DataFrame, gap: int) -> DataFrame:
    """(user_name, start_us, end_us, n_events) of the sessions of entries, the gap in microseconds."""
    width = max(HOUR_US, gap)  # a gap never spans more than one whole bucket
    order = ["user_name", "hour", "us", "list", "name", "question_id"]
    routed = entries.withColumn("hour", F.floor(F.col("us") / F.lit(width)).cast("bigint")).select(*order)
    parts = routed.repartition("user_name", "hour").sortWithinPartitions(*order).mapInArrow(_timers(gap), "user_name string, hour bigint, start_us bigint, end_us bigint, n_events bigint")
    edge = (F.col("start_us") - F.col("hour") * width <= gap) | ((F.col("hour") + 1) * width - F.col("end_us") <= gap)
    # Edge fragments of a user meet in one group, bounded by the hours; the others stay with their hour, where each is a session.
    parts = parts.withColumn("part", F.when(edge, F.lit(None).cast("bigint")).otherwise(F.col("hour")))
    by = Window.partitionBy("user_name", "part").orderBy("start_us")
    opens = F.coalesce((F.col("start_us") - F.lag("end_us").over(by) > gap).cast("int"), F.lit(1))
    joined = (
        parts.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("user_name", "part", "island")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
    )
    return joined.select("user_name", "start_us", "end_us", "n_events")


def sessionize(entries: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(user_name, start_ms, end_ms, duration_ms, n_events) of the sessions of entries."""
    joined = sessions_us(entries, gap_ms * 1000)
    ms = lambda c: F.floor(F.col(c) / 1000).cast("bigint")
    return joined.select(
        "user_name", ms("start_us").alias("start_ms"), ms("end_us").alias("end_ms"),
        (ms("end_us") - ms("start_us")).alias("duration_ms"), F.col("n_events").cast("bigint").alias("n_events"),
    )


def user_sessions(logs: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    return sessionize(activity_entries(logs), gap_ms)
