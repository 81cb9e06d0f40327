"""Folds over streams on event time, by timers of transformWithState.

Rows wait until the watermark has passed them, then they are folded in the order of their event time, so that a replay
gives what the batch form gives, however the stream is cut into micro-batches and whatever order rows come in.  Rows
later than the watermark are dropped by Spark, as everywhere on event time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from voxframe.operators.folds import AT, Fold, advance, as_frame, event_ms

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_pandas()


class EventFold(StatefulProcessor):
    """State of a key: rows that wait for the watermark (a list), and the fold's memory with the time of its last row."""

    def __init__(self, fold: Fold, order: list[str]):
        self.fold, self.order = fold, order

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getValueState("memory", "memory binary, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendValue((_packed(frame),))
                first = min(x for x in (first, int(frame[AT].min())) if x is not None)
        if first is not None:
            # The smallest time alone: when it has passed, the next one is set
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        memory, last = self.fold.start(key), None
        if self.memory.exists():
            blob, last = self.memory.get()
            memory = pickle.loads(blob)  # noqa: S301  written below, by this processor
        parts = [_unpacked(bytes(r[0])) for r in self.waiting.get()] if self.waiting.exists() else []
        out: list[tuple] = []
        if parts:
            frame = pd.concat(parts, ignore_index=True)
            due = frame[frame[AT] <= now].sort_values([AT, *self.order], kind="stable")
            later = frame[frame[AT] > now]
            memory, last, out = advance(self.fold, key, memory, last, due)
            self.waiting.clear()
            if len(later):
                self.waiting.put([(_packed(later),)])
                self.handle.registerTimer(int(later[AT].min()))
        idle = self.fold.idle
        if last is not None and idle is not None and now > last + idle and self.fold.over(memory):
            out += self.fold.end(key, memory)
            self.memory.clear()
        elif last is not None:
            self.memory.update((pickle.dumps(memory), last))
            if idle is not None and now <= last + idle:
                self.handle.registerTimer(int(last + idle) + 1)
        if out:
            yield as_frame(self.fold, out)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, keys: list[str], order: list[str], fold: Fold, at: str, late: str = "10 seconds") -> DataFrame:
    """What a fold gives over a stream, the rows of each key by event time ``at``, then ``order``.

    State lives in RocksDB, which this kind of operator needs: the session is set so, if it has no other than the default.
    """
    conf = df.sparkSession.conf
    if "RocksDB" not in (conf.get(_STORE, None) or ""):
        conf.set(_STORE, _ROCKS)
    rows = df.withColumn(AT, event_ms(at)).withWatermark(at, late)
    return rows.groupBy(*keys).transformWithStateInPandas(EventFold(fold, order), fold.columns, "Append", "EventTime")


