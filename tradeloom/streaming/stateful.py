"""Keyed state for streams: what a key has stored, strikes and locks by event time, and conflicts with their history.

Each job needs the RocksDB state store, which it sets on the session. State lives with its key, so that the cost of a
micro-batch follows the batch, and a batch that is run again starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import FORGET, lockout_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows


class Stored(StatefulProcessor):
    """Rows stored under one source and hash: how many (2 stands for more), and their external ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "n int")
        self.ids = handle.getMapState("ids", "id string", "seen boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        ids = [i for i in initialState.external_id if i is not None]
        before = self.rows.get()[0] if self.rows.exists() else 0
        self.rows.update((min(before + len(initialState), 2),))
        for i in ids:
            self.ids.updateValue((i,), (True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("item_id", ignore_index=True)
        held, out = (self.rows.get()[0] if self.rows.exists() else 0), []
        for external, empty in zip(log.external_id, log["empty"]):
            if empty:
                out.append("failed")
            elif external is None:
                out.append(("created", "skipped_duplicate", "failed")[held])
                held = max(held, 1)
            elif self.ids.containsKey((external,)):
                out.append("skipped_duplicate")
            else:
                self.ids.updateValue((external,), (True,))
                out.append("created")
                held = min(held + 1, 2)
        self.rows.update((held,))
        yield log[["item_id", "source", "external_id", "content_hash"]].assign(outcome=out)

    def close(self) -> None:
        pass


def ingest_outcomes(items: DataFrame, existing: DataFrame) -> DataFrame:
    """items (item_id, source, external_id, content_hash, empty) as a stream -> with `outcome`, as in the batch form.

    existing (source, external_id, content_hash) is read once, when the stream first starts. Items of a key must come in
    id order between micro-batches; within one they are sorted. Items without a source or a hash are one key.
    """
    keys = ["source", "content_hash"]
    rows = keyed(items).select("item_id", "source", "external_id", "content_hash", "empty").groupBy(*keys)
    known = existing.select("source", "content_hash", "external_id").groupBy(*keys)
    schema = "item_id bigint, source string, external_id string, content_hash string, outcome string"
    return rows.transformWithStateInPandas(Stored(), schema, "append", "none", initialState=known)


class Attempts(StatefulProcessor):
    """Strikes and lock of one user. Attempts wait until the watermark has passed them and are then taken in order of
    time, so that late ones count where they belong; state goes when its strikes are forgotten and its lock is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("strikes", "strikes int, first double, until double")
        self.waiting = handle.getListState("waiting", "event_id bigint, t double, failed boolean, succeeded boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows))
        times = [t.timestamp() for t in log.ts]
        self.waiting.appendList([(int(e), t, bool(f), bool(s)) for e, t, f, s in zip(log.event_id, times, log.failed, log.succeeded)])
        self.handle.registerTimer(int(max(times) * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        every = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        due, rest = [r for r in every if r[1] < now], [r for r in every if r[1] >= now]
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for event, t, failed, succeeded in due:
            state, row = lockout_step(state, t, failed, succeeded)
            out.append((key[0], event, *row))
        if due:
            if rest:
                self.waiting.put([tuple(r) for r in rest])
            else:
                self.waiting.clear()
            self.state.update((int(state[0]), float(state[1]), float(state[2])))
            self.handle.registerTimer(int(max(state[1] + FORGET if state[0] else 0, state[2], now) * 1000) + 1)
        elif state and not rest and now >= max(state[1] + FORGET if state[0] else 0, state[2]):
            self.state.clear()  # strikes are forgotten, the lock is over
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "strikes", "lock_seconds"])

    def close(self) -> None:
        pass


def lockouts_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Attempts (user_id, event_id, ts, failed, succeeded) -> what `sessions.lockouts` gives on the same rows, each once
    the watermark has passed it. Rows up to `late` count wherever they come; later ones are left out."""
    rows = keyed(events).where("failed OR succeeded").select("user_id", "event_id", "ts", "failed", "succeeded").withWatermark("ts", late)
    schema = "user_id bigint, event_id bigint, outcome string, strikes int, lock_seconds double"
    return rows.groupBy("user_id").transformWithStateInPandas(Attempts(), schema, "append", "EventTime")


class Conflict(StatefulProcessor):
    """Records of one field until two of their values differ; then all of them are tagged, and each later one at once.
    A group that nobody adds to for `days`, where given, is forgotten."""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.days and self.days * 86_400_000
        self.group = handle.getValueState("group", "first bigint, value string, opened boolean", ttl)
        self.untagged = handle.getListState("untagged", "record_id bigint", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("record_id", ignore_index=True)
        first, value, opened = self.group.get() if self.group.exists() else (int(log.record_id[0]), None, False)
        ids, values = [int(i) for i in log.record_id], [v for v in log.value_observed if v is not None]
        value = value if value is not None else next(iter(values), None)
        tagged = ids
        if not opened and any(v != value for v in values):
            tagged = [*(r[0] for r in (self.untagged.get() if self.untagged.exists() else ())), *ids]
            self.untagged.clear()
            opened = True
        elif not opened:
            self.untagged.appendList([(i,) for i in ids])
            tagged = []
        self.group.update((first, value, opened))
        if tagged:
            yield pd.DataFrame({"company_id": [key[0]] * len(tagged), "field_name": [key[1]] * len(tagged), "record_id": tagged, "conflict_id": [first] * len(tagged)})

    def close(self) -> None:
        pass


def conflict_stream(records: DataFrame, days: int | None = None) -> DataFrame:
    """Records (company_id, field_name, record_id, value_observed) -> tags, those of `provenance.tag_conflicts`: when a
    group's values first differ, its earlier records are tagged too, under the group's first record.

    Records of a group must come in id order between micro-batches; within one they are sorted. With `days` a group's
    state lives so long by the clock after its last record; such a stream wakes up without data too, so a run that is to
    end needs spark.sql.streaming.noDataMicroBatches.enabled = false.
    """
    rows = keyed(records).select("company_id", "field_name", "record_id", "value_observed")
    schema = "company_id bigint, field_name string, record_id bigint, conflict_id bigint"
    return rows.groupBy("company_id", "field_name").transformWithStateInPandas(Conflict(days), schema, "append", "ProcessingTime" if days else "none")


def ingest_stream(items: DataFrame, existing: DataFrame, store: str, checkpoint: str):
    """Outcomes appended to Parquet in `store`; the sink's own log keeps a repeated batch from counting twice."""
    out = ingest_outcomes(items, existing).withColumn("stored_at", F.current_timestamp())
    return out.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
