"""Attempts as a stream: counts of a session in windows, and the budget gate as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, kind, n): events of a watermarked stream in tumbling windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def gated(stream: DataFrame, key: str, order: str, confirmed: str, budget: int = 20, confirm_every: int = 5, ttl_seconds: int | None = None) -> DataFrame:
    """(key, order, n, decision) as operators.history.gate_exact has it: each session's count of
    allowed attempts is the state; attempts are ordered within a micro-batch. With ttl_seconds a session
    that has no attempt for so long, by the clock, begins anew, and its state goes; a run by availableNow
    then needs spark.sql.streaming.noDataMicroBatches.enabled off, or it waits for all to expire."""
    kinds = dict(stream.dtypes)
    names = [key, order, "n", "decision"]

    def run(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs() if ttl_seconds else 0
        n, last = state.get if state.exists else (0, now)
        if ttl_seconds and now - last >= 1000 * ttl_seconds:  # it is too late, though no batch has come to tell
            n = 0
        rows = pd.concat(list(batches)).sort_values("o")
        out = []
        for o, ok in zip(rows["o"], rows["ok"]):
            what = "blocked" if n >= budget else "allowed" if ok or n == 0 or n % confirm_every else "checkpoint"
            out.append((who[0], o, n, what))
            n += what == "allowed"
        state.update((int(n), now))
        if ttl_seconds:
            state.setTimeoutDuration(1000 * ttl_seconds)
        yield pd.DataFrame(out, columns=names)

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, n long, decision string"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_seconds else GroupStateTimeout.NoTimeout
    rows = stream.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(confirmed), F.lit(False)).alias("ok"))
    return rows.groupBy("k").applyInPandasWithState(run, schema, "n long, last long", "append", timeout)
