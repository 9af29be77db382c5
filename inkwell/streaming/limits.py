"""The rate limiter and the overlap check over streams."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from inkwell.operators import overlap
from inkwell.operators.ratelimit import WINDOW_S, admit


def limited(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: float = WINDOW_S, forget: bool = True) -> DataFrame:
    """(order, key, allowed) of a stream of events; a key's state is its last `limit` admitted times.

    Events of a micro-batch are decided in the order of time, and batches as they arrive. With forget, a key's
    state goes once nothing has come for it for twice the window; such a query runs until it is stopped, as
    time-outs need batches without data.
    """
    rows = events.select(F.col(order).cast("long").alias("o"), F.col(key).cast("string").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(frames)).sort_values(["t", "o"])
        allowed = [admit(times, t, limit, window_s) for t in pdf["t"]]
        state.update((list(times),))
        if forget:
            state.setTimeoutDuration(int(2000 * window_s))
        yield pd.DataFrame({order: pdf["o"], key: pdf["k"], "allowed": allowed})

    return rows.groupBy("k").applyInPandasWithState(step, f"{order} long, {key} string, allowed boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def overlap_batches(queries: DataFrame, index: DataFrame, id_col: str, text_col: str, sink):
    """A writer that scores each micro-batch of texts against a static index and hands the result to sink(df, batch)."""
    return queries.writeStream.foreachBatch(lambda df, batch: sink(overlap.overlap(index, df, id_col, text_col), batch))
