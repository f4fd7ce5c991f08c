"""The log-driven operators on streams; each gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import first_hit_window


def rate_limit_stream(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Breaches of first-hit windows; state is the open window's start and hits, dropped once the window is over.

    Rows of a user must come in time order between micro-batches; within one they are sorted.
    """

    def walk(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = pd.concat(list(parts)).sort_values(["ts", "event_id"], ignore_index=True)
        start, hits = state.get if state.exists else (None, 0)
        found, start, hits = first_hit_window([t.timestamp() for t in log.ts], seconds, most, start, hits)
        state.update((start, hits))
        state.setTimeoutTimestamp(max(int((start + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(int(key[0]), int(log.event_id[i]), hit, wait) for i, hit, wait in found], columns=["user_id", "event_id", "hit", "retry_after"])

    rows = events.select("user_id", "event_id", "ts").withWatermark("ts", f"{seconds} seconds")
    return rows.groupBy("user_id").applyInPandasWithState(walk, "user_id bigint, event_id bigint, hit int, retry_after double", "start double, hits int", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Attempts by kind and hour, late rows up to `late` counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
