"""Streams with typed state and timers: open transactions that are appended to, and heartbeats of idle sources.

State of these operators needs the RocksDB provider:
``spark.sql.streaming.stateStore.providerClass=org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Timed(StatefulProcessor):
    """Keeps one timer a key: the latest that was set."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def set_timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if at is not None:
            self.handle.registerTimer(at)


class WholeTransactions(_Timed):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "seqno long")

    def _out(self, key, flushed: bool) -> pd.DataFrame:
        held = sorted(r[0] for r in self.open.get())
        self.open.clear()
        return pd.DataFrame({"seqno": held, "tx_id": key[0], "flushed": flushed})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = False
        for frame in rows:
            self.open.appendList([(int(s),) for s in frame["seqno"]])
            last = last or bool(frame["tx_last"].any())
        self.set_timer(None if last else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if last:
            yield self._out(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._out(key, True)
        if len(out):
            yield out


def whole_transactions(log: DataFrame, idle_ms: int = 3000) -> DataFrame:
    """seqno, tx_id and flushed of a stream of (tx_id, seqno, tx_last): the events of a transaction together.

    They are held back until the transaction's last event has come, or nothing of it has for ``idle_ms``; then what there
    is goes out, with flushed true. A batch appends its positions to the transaction's list; only the end reads it.
    """
    return log.groupBy("tx_id").transformWithStateInPandas(WholeTransactions(idle_ms), "seqno long, tx_id long, flushed boolean", "append", "ProcessingTime")


class Heartbeats(_Timed):
    def __init__(self, idle_ms: int, every_ms: int, forget_ms: int | None):
        self.idle_ms, self.every_ms, self.forget_ms = idle_ms, every_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seqno long, beat long", self.forget_ms)

    @staticmethod
    def _row(source, kind: str, seqno: int, beat: int, at: int) -> pd.DataFrame:
        return pd.DataFrame({"source": [source], "kind": [kind], "seqno": [seqno], "beat": [beat], "at_ms": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        most = max(int(frame["seqno"].max()) for frame in rows)
        held = self.last.get() if self.last.exists() else None
        most = most if held is None else max(most, held[0])
        self.last.update((most, 0))
        self.set_timer(now + self.idle_ms)
        yield self._row(key[0], "EVENTS", most, 0, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.last.exists():  # forgotten
            return
        seqno, beat = self.last.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((seqno, beat + 1))
        self.set_timer(now + self.every_ms)
        yield self._row(key[0], "HEARTBEAT", seqno, beat + 1, now)


def heartbeats(log: DataFrame, idle_ms: int, every_ms: int, forget_ms: int | None = None) -> DataFrame:
    """source, kind, seqno, beat and at_ms of a stream of (source, seqno): how far each source is, also while it is idle.

    EVENTS for each batch that has events of a source, with its greatest position; HEARTBEAT where none has come for
    ``idle_ms`` and then every ``every_ms``, numbered by beat, with the last position. A source that is idle for
    ``forget_ms`` is forgotten and beats no more.
    """
    return log.groupBy("source").transformWithStateInPandas(Heartbeats(idle_ms, every_ms, forget_ms), "source string, kind string, seqno long, beat long, at_ms long", "append", "ProcessingTime")
