"""Session and security logs: token reuse, expiry by gaps, retention, first-hit windows and progressive lockout."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import HEAVY, PARTS, parts_of

# Strikes before a lock, its first and longest seconds, seconds until strikes are forgotten.
LOCK_AFTER, LOCK_FIRST, LOCK_MOST, FORGET = 5, 30, 900, 24 * 3600


def token_reuse(events: DataFrame) -> DataFrame:
    """The second use of a token revokes: (token_id, user_id, revoked_at, uses)."""
    nth = Window.partitionBy("token_id").orderBy("ts", "event_id")
    out = events.withColumn("nth", F.row_number().over(nth))
    return out.where("nth = 2").select("token_id", "user_id", F.col("ts").alias("revoked_at"))


def session_expiry(events: DataFrame, idle_seconds: int) -> DataFrame:
    """A session lives until its first gap over the limit; rotations after it fail."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(by)
    dead = F.max(F.when(gap > idle_seconds * 1_000_000, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = events.withColumn("dead", dead)
    return out.groupBy("user_id").agg(F.max(F.when(F.col("dead") == 0, F.col("ts"))).alias("last_valid"), F.count_if(F.col("dead") == 0).alias("rotations"), F.count_if(F.col("dead") == 1).alias("failed"))


def keep_last(events: DataFrame, n: int = 5) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n).select("user_id", "nth", "event_id")


def retention(events: DataFrame, expires_after: int, as_of) -> DataFrame:
    """Users to drop: the last sign of life plus the lifetime is over a day ago."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.where(F.unix_timestamp("last_seen") + expires_after + 86400 < F.unix_timestamp(F.lit(as_of)))


def first_hit_window(times: list[float], seconds: float, most: int, start: float | None = None, hits: int = 0) -> tuple[list[tuple[int, int, float]], float | None, int]:
    """(place, hit, retry after) of breaches, and the state to go on with; a window begins at its first hit."""
    out = []
    for i, t in enumerate(times):
        if start is None or t >= start + seconds:
            start, hits = t, 0
        hits += 1
        if hits > most:
            out.append((i, hits, start + seconds - t))
    return out, start, hits


def sorted_logs(events: DataFrame, *columns: str) -> DataFrame:
    """Users' logs one after the other, each in order, to be walked in bounded batches. Times are in seconds."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    return events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "event_id", seconds, *columns)


def walk_logs(batches: Iterator[pa.RecordBatch], step: Callable, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """step(state or None, time, *columns) -> (state, row or None); only the open state of one user is carried on. Rows
    without a user are one log."""
    user, state = object(), None  # no user is this one
    for batch in batches:
        out: list[tuple] = []
        for u, event, *rest in zip(*[c.to_pylist() for c in batch.columns]):
            if u != user:
                user, state = u, None
            state, row = step(state, *rest)
            if row is not None:
                out.append((u, event, *row))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names)


def chunk_steps(t: np.ndarray, seconds: float) -> list[tuple[float, float, int]]:
    """What a sorted chunk of a log does to an open window, as steps (up to, start, hits): if the first hit at or after
    the window's end is at a time of at most `up to`, the chunk ends in a window with that start and so many hits.

    A window that was open before ends within `seconds` of the first hit, so only the hits up to there can come first.
    Each hit points to the one that starts the window after its own; doubling the pointers finds the last start.
    """
    n = len(t)
    last, after = np.arange(n), np.searchsorted(t, t + seconds)
    while (more := after < n).any():
        last = np.where(more, last[np.minimum(after, n - 1)], last)
        after = np.where(more, after[np.minimum(after, n - 1)], after)
    reach = min(n, int(np.searchsorted(t, t[0] + seconds)) + 1)
    ends = np.append(np.flatnonzero(np.diff(last[:reach])), reach - 1)
    return [(float(t[i]), float(t[last[i]]), int(n - last[i])) for i in ends]


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows sorted by (user_id, part) -> each chunk whole, by column."""
    key, held = None, None
    for batch in batches:
        columns, i = batch.to_pydict(), 0
        keys = list(zip(columns["user_id"], columns["part"]))
        while i < len(keys):
            j = bisect_right(range(i, len(keys)), False, key=lambda x: keys[x] != keys[i]) + i
            if held is None or keys[i] != key:
                if held is not None:
                    yield key, held
                key, held = keys[i], {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[i:j]
            i = j
    if held is not None:
        yield key, held


def entries(chunks: DataFrame, seconds: float) -> DataFrame:
    """(user_id, part, start, hits): the window that is open when a chunk of a log begins, null where none was."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (user, part), rows in chunks_of(batches):
            up_to, start, hits = zip(*chunk_steps(np.array(rows["t"]), seconds))
            yield pa.RecordBatch.from_pydict({"user_id": pa.array([user], pa.int64()), "part": pa.array([part], pa.int32()), "n": pa.array([len(rows["t"])], pa.int64()), "up_to": [list(up_to)], "start": [list(start)], "hits": pa.array([list(hits)], pa.list_(pa.int64()))})

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        start, hits, out = None, 0, []
        for user, part, n, up_to, starts, counts in log.sort_values("part")[["user_id", "part", "n", "up_to", "start", "hits"]].itertuples(index=False):
            out.append((user, part, start, hits))
            at = 0 if start is None else int(np.searchsorted(up_to, start + seconds))
            start, hits = (starts[at], int(counts[at])) if at < len(up_to) else (start, hits + n)
        return pd.DataFrame(out, columns=["user_id", "part", "start", "hits"]).astype({"user_id": "Int64", "start": "float64"})

    steps = chunks.mapInArrow(sums, "user_id bigint, part int, n bigint, up_to array<double>, start array<double>, hits array<bigint>")
    return steps.groupBy("user_id").applyInPandas(fold, "user_id bigint, part int, start double, hits bigint")  # a row for each chunk


def rate_limit(events: DataFrame, seconds: int, most: int, heavy: int = HEAVY, parts: int = PARTS) -> DataFrame:
    """Breaches by user. Order matters, so a user's log is walked once, sorted; no log is held whole.

    The log of a user with over `heavy` rows is cut into chunks by time. Each chunk is summed up by what it does to the
    window that is open when it begins; the sums give every chunk its window, and the chunks are walked side by side.
    """
    names, types = ["user_id", "event_id", "hit", "retry_after"], [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
    schema = "user_id bigint, event_id bigint, hit int, retry_after double"

    def step(state: tuple | None, t: float) -> tuple:
        found, start, hits = first_hit_window([t], seconds, most, *(state or (None, 0)))
        return (start, hits), found[0][1:] if found else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (user, _), rows in chunks_of(batches):
            found, _, _ = first_hit_window(rows["t"], seconds, most, rows["start"][0], rows["hits"][0])
            out = [(user, rows["event_id"][i], hit, wait) for i, hit, wait in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names)

    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select(F.col("user_id").alias("heavy_id"))
    if users.isEmpty():
        return sorted_logs(events).mapInArrow(lambda b: walk_logs(b, step, names, types), schema)
    same = F.col("user_id").eqNullSafe(F.col("heavy_id"))
    light = sorted_logs(events.join(users, same, "left_anti")).mapInArrow(lambda b: walk_logs(b, step, names, types), schema)
    rows = events.join(users, same, "left_semi").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    rows = rows.withColumn("part", parts_of(rows, "t", parts))
    ordered = lambda df: df.repartition("user_id", "part").sortWithinPartitions("user_id", "part", "t", "event_id")
    opened = entries(ordered(rows), seconds).withColumnsRenamed({"user_id": "of_user", "part": "of_part"})
    both = rows.join(opened, F.col("user_id").eqNullSafe(F.col("of_user")) & (F.col("part") == F.col("of_part"))).select("user_id", "part", "event_id", "t", "start", "hits")
    return light.union(ordered(both).mapInArrow(walk, schema))


def lockout_step(state: tuple | None, t: float, failed: bool, succeeded: bool) -> tuple:
    """State (strikes, first strike, locked until) and an attempt -> the next state and (outcome, strikes, lock seconds)."""
    strikes, first, until = state or (0, 0.0, 0.0)
    if t < until:
        return (strikes, first, until), ("blocked", strikes, until - t)
    if strikes and t >= first + FORGET:
        strikes = 0
    lock = 0.0
    if failed:
        first = first if strikes else t
        strikes += 1
        if strikes >= LOCK_AFTER:
            lock = float(min(LOCK_FIRST * 2 ** min(strikes - LOCK_AFTER, 30), LOCK_MOST))
            until = t + lock
    elif succeeded:
        strikes = 0
    return (strikes, first, until), ("failed" if failed else "passed", strikes, lock)


def lockouts(events: DataFrame) -> DataFrame:
    names, types = ["user_id", "event_id", "outcome", "strikes", "lock_seconds"], [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64()]
    logs = sorted_logs(events.where("failed OR succeeded"), "failed", "succeeded")
    return logs.mapInArrow(lambda b: walk_logs(b, lockout_step, names, types), "user_id bigint, event_id bigint, outcome string, strikes int, lock_seconds double")
