"""Threads of a stream of messages by reference, then by subject and silence.

Messages of one tenant and normalised subject share a key, so that a reply meets the message that it cites. They wait in the
key's state until the watermark has passed them and are then threaded in event-time order, whatever the order of arrival:
the rows are those of the same messages read in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from bidlake.streaming import feeds

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000_000


class _Threads(StatefulProcessor):
    """Map states: messages that wait, by time and id; the thread of each message; each thread's last time, supplier and request."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id string", "refs array<string>, supplier string, rfq string")
        self.known = handle.getMapState("known", "id string", "thread int")
        self.threads = handle.getMapState("threads", "thread int", "last long, supplier string, rfq string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for at, own, refs, supplier, rfq in zip(part["at"], part["id"], part["refs"], part["supplier"], part["rfq"], strict=True):
                micros = at.value // 1000
                self.waiting.updateValue((micros, own), ([] if refs is None else [r for r in refs if r is not None], _text(supplier), _text(rfq)))
                first = micros // 1000 if first is None else min(first, micros // 1000)
        self._wake(first)
        return iter([])

    def _wake(self, at: int | None) -> None:
        """One timer a key: that of the earliest message that waits."""
        set_ = self.timer.get()[0] if self.timer.exists() else None
        if at is not None and (set_ is None or at < set_):
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000
        waiting = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0])
        due = [x for x in waiting if x[0][0] < upto]
        self.timer.clear()
        if len(due) < len(waiting):
            self._wake(waiting[len(due)][0][0] // 1000)
        out = []
        for (at, own), (refs, supplier, rfq) in due:
            thread, method = self._thread(at, refs, supplier, rfq)
            self.known.updateValue((own,), (thread,))
            self.waiting.removeKey((at, own))
            out.append((*key, own, thread, method))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "thread", "method"])

    def _thread(self, at: int, refs: list, supplier: str | None, rfq: str | None) -> tuple[int, str]:
        """The thread of the first cited message that is known; else the only one not silent for ``days`` with the message's supplier
        and request, where it has any; else a new one. A thread keeps its supplier, its request and its latest time."""
        thread, method = next((self.known.getValue((r,))[0] for r in refs if self.known.containsKey((r,))), None), "REFERENCE"
        if thread is None and (supplier or rfq):
            method = "SUBJECT"
            open_ = [k[0] for k, (last, s, q) in self.threads.iterator() if last >= at - self.days * _DAY and supplier in (None, s) and rfq in (None, q)]
            thread = open_[0] if len(open_) == 1 else None
        if thread is None:
            thread, method = sum(1 for _ in self.threads.keys()) + 1, "NEW"
            self.threads.updateValue((thread,), (at, supplier, rfq))
        else:
            last, s, q = self.threads.getValue((thread,))
            self.threads.updateValue((thread,), (max(last, at), s or supplier, q or rfq))
        return thread, method

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return value if isinstance(value, str) and value else None


def reference_threads(messages: DataFrame, key: str, id_col: str, at: str, refs: str, supplier: str, rfq: str, days: int = 30, late: str = "1 day") -> DataFrame:
    """``key, id, thread, method`` of a stream of messages, once the watermark, ``late`` behind the latest time, has passed them.

    ``refs`` is an array of cited ids, the one replied to first; null ids, null arrays and empty ones cite nothing. Messages of one
    time are taken by id. Rows of an id that has come before replace it while it waits. Rows behind the watermark do not enter the
    state: see ``late.recomputed``. Threads are numbered within their key. State grows with messages and threads; it
    needs RocksDB, which ``to_table`` sets for its query.
    """
    text = {c: F.col(c).cast("string") for c in (supplier, rfq)}
    rows = messages.select(
        F.col(key).cast("string").alias("key"), F.col(id_col).cast("string").alias("id"), F.col(at).cast("timestamp").alias("at"),
        F.col(refs).cast("array<string>").alias("refs"), text[supplier].alias("supplier"), text[rfq].alias("rfq"),
    ).withWatermark("at", late)
    schema = "key string, id string, thread int, method string"
    return rows.groupBy("key").transformWithStateInPandas(_Threads(days), schema, "append", "eventTime")


def to_table(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """``feeds.to_table`` with state in RocksDB. A query keeps the settings that it starts with, so the session's own are put back at once."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return feeds.to_table(df, out, checkpoint)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
