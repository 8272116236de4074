"""Usage charges: totals, rolling sums, admission under a rolling budget."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_cost(charges: DataFrame, seconds: int = 180) -> DataFrame:
    """Each charge with the user's cost in the seconds before it, itself included; a charge exactly that old is out.

    A user's time is cut into spans of the window's width; a charge counts in its own span and, as a
    copy, in the next one, so that no span needs another and a busy user is many groups.
    """
    width = seconds * 1_000_000
    span = F.floor(F.col("us") / F.lit(width)).cast("bigint")
    twice = charges.withColumn("__s", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))))
    by = Window.partitionBy("user_id", "__s.span").orderBy("us").rangeBetween(-(width - 1), 0)
    return twice.withColumn("window_cost", F.round(F.sum("cost").over(by), 6)).filter("__s.own").drop("__s")


#: Parts of the window in which the charges of one user are ordered.
SLICES = 64


def retry_after(charges: DataFrame, now_us: DataFrame, seconds: int, limit: float) -> DataFrame:
    """(user_id, window_cost, retry_s): seconds until the user's cost in the window falls below the limit; 0 if it isn't reached.

    What was charged later than a charge is what follows in its slice of the window and the sums of later slices,
    so only a slice is ordered in one group.
    """
    recent = charges.crossJoin(F.broadcast(now_us)).filter(F.col("us") > F.col("now_us") - seconds * 1_000_000)  # now_us is one row
    recent = recent.withColumn("slice", F.floor((F.col("us") - F.col("now_us") + seconds * 1_000_000) * F.lit(SLICES) / F.lit(seconds * 1_000_000)).cast("int"))
    later = Window.partitionBy("user_id", "slice").orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    after = Window.partitionBy("user_id").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)  # at most SLICES rows a user
    sums = recent.groupBy("user_id", "slice").agg(F.sum("cost").alias("cost")).withColumn("after", F.coalesce(F.sum("cost").over(after), F.lit(0.0))).drop("cost")
    seen = recent.withColumn("later", F.coalesce(F.sum("cost").over(later), F.lit(0.0))).join(sums, ["user_id", "slice"]).withColumn("later", F.col("later") + F.col("after"))
    wait = F.greatest(F.lit(0), F.floor((F.col("us") + seconds * 1_000_000 - F.col("now_us")) / 1e6)).cast("bigint")
    totals = seen.groupBy("user_id").agg(F.round(F.sum("cost"), 6).alias("window_cost"), F.min(F.when(F.col("later") < limit, wait)).alias("first"))
    return totals.select("user_id", "window_cost", F.when(F.col("window_cost") >= limit, F.col("first")).otherwise(F.lit(0)).cast("bigint").alias("retry_s"))


def admission(charges: DataFrame, seconds: int, limit: float) -> DataFrame:
    """(event_id, user_id, admitted): a charge is refused while the user's admitted cost in the window is at the limit.

    A refusal adds no cost, so each decision hangs on those before it: a fold over the
    user's ordered charges that holds the window's admitted charges only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held, total = None, deque(), 0.0
        for b in batches:
            ids, users, us, cost = (b.column(c).to_pylist() for c in ("event_id", "user_id", "us", "cost"))
            ok = []
            for u, t, c in zip(users, us, cost):
                if u != user:
                    user, held, total = u, deque(), 0.0
                while held and held[0][0] <= t - seconds * 1_000_000:
                    total -= held.popleft()[1]
                ok.append(total < limit)
                if ok[-1]:
                    held.append((t, c))
                    total += c
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(users, pa.int64()), pa.array(ok)], names=["event_id", "user_id", "admitted"])

    ordered = charges.select("event_id", "user_id", "us", F.coalesce("cost", F.lit(0.0)).alias("cost")).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return ordered.mapInArrow(run, "event_id bigint, user_id bigint, admitted boolean")
