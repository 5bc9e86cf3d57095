"""State that isn't forgotten: once-per-key events and debounced changes with a state of their own per key.

A watermark bounds what deduplication and session windows remember; here each key holds a
value that lasts until the stream's checkpoint goes, and timers say when a change is due.
The session needs the RocksDB state store (ROCKSDB), so that state lies on disk and
grows with the keys and not with memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Settings of a session that runs these.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _First(StatefulProcessor):
    """Of each key the first row by `order`; all later ones go, however much later."""

    def __init__(self, key: str, order: str, columns: list[str]):
        self.key, self.order, self.columns = key, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if self.seen.exists() or not parts:
            return
        self.seen.update((True,))
        first = min((p.loc[[p[self.order].idxmin()]] for p in parts if len(p)), key=lambda p: p[self.order].iloc[0])
        yield first[self.columns]

    def close(self) -> None:
        pass


class _Debounced(StatefulProcessor):
    """A row for each run of changes once `gap` has passed since the last one."""

    def __init__(self, key: str, ts: str, gap_ms: int):
        self.key, self.ts, self.gap_ms = key, ts, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "due long, changes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps = sorted(int(t) for part in rows for t in part[self.ts].astype("datetime64[ms]").astype("int64"))
        due, changes = self.run.get() if self.run.exists() else (None, 0)
        done = []
        for t in stamps:
            if due is not None and t > due:  # the run before has ended, and only the watermark has not yet said so
                done.append((due, changes))
                changes = 0
            due, changes = max(due or 0, t + self.gap_ms), changes + 1
        if stamps:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.run.update((due, changes))
            self.handle.registerTimer(due)
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            yield self._rows(key, [self.run.get()])
            self.run.clear()

    def _rows(self, key, runs) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(runs), "due": pd.to_datetime([d for d, _ in runs], unit="ms", utc=True), "changes": [c for _, c in runs]})

    def close(self) -> None:
        pass


def once_ever(events: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The first event of each key that the stream has ever seen; of those in one batch, the one with the least order."""
    return events.groupBy(key).transformWithStateInPandas(_First(key, order, events.columns), events.schema, "Append", "None")


def debounced(events: DataFrame, key: str, ts: str = "created_at", gap_s: int = 600, delay: str = "1 hour") -> DataFrame:
    """key, due, changes: changes no more than `gap_s` apart as one, once the watermark has passed the moment it is due."""
    kind = events.schema[key].dataType.simpleString()
    changes = events.withWatermark(ts, delay).select(key, ts)
    return changes.groupBy(key).transformWithStateInPandas(_Debounced(key, ts, gap_s * 1000), f"{key} {kind}, due timestamp, changes long", "Append", "EventTime")
