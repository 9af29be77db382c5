"""A sliding limit on the requests of a key, where refused requests don't count."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = {"x": 60, "o": 40, "c": 25, "a": 40}
WINDOW_S = 600.0


def admit(times: deque, now: float, limit: int, window: float) -> bool:
    """Whether a request at `now` is let in; times holds those let in before and is brought up to date."""
    while times and now - times[0] > window:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def decide(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: float = WINDOW_S) -> DataFrame:
    """(order, key, allowed) of every event, in the order of time and then of the column `order`.

    A decision depends on all before it of its key, so a key is read in order by one task; what that task
    holds is one key's last `limit` times, however many events the key has. Null keys are one key; events
    without a time come first and are let in without counting.
    """
    rows = events.select(F.col(order).cast("long").alias("o"), F.col(key).cast("string").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    rows = rows.repartition(F.col("k")).sortWithinPartitions("k", F.col("t").asc_nulls_first(), "o")

    def run(batches):
        times, last = deque(), object()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if k != last:
                    times, last = deque(), k
                out.append(t is None or admit(times, t, limit, window_s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["o", "k", "allowed"])

    return rows.mapInArrow(run, "o long, k string, allowed boolean").select(F.col("o").alias(order), F.col("k").alias(key), "allowed")
