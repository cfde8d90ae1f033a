"""Order within a session: one request of each session at a time, others wait in keyed state, and a timer frees what hangs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session's events are, and what comes out of them.
EVENT = "session_id string, request_id string, kind string, ts timestamp"
RELEASED = "session_id string, request_id string, why string, at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OneAtATime(StatefulProcessor):
    """kind `ask` brings a request, `done` ends the one that runs. A request is released when none runs: asked, next, or after a timeout."""

    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "request_id string, until long")
        self.waiting = handle.getListState("waiting", "request_id string")

    def _release(self, session: str, request: str, why: str, at_ms: int) -> tuple:
        self.running.update((request, at_ms + self.lease_ms))
        self.handle.registerTimer(at_ms + self.lease_ms)
        return session, request, why, pd.Timestamp(at_ms, unit="ms", tz="UTC").tz_localize(None)

    def _next(self, session: str, why: str, at_ms: int) -> list[tuple]:
        queue = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if not queue:
            self.running.clear()
            return []
        if queue[1:]:
            self.waiting.put([(r,) for r in queue[1:]])
        return [self._release(session, queue[0], why, at_ms)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "request_id", "kind"], kind="stable")
        out: list[tuple] = []
        for e in events.itertuples(index=False):
            at = int(pd.Timestamp(e.ts).value // 1_000_000)
            running = self.running.get() if self.running.exists() else None
            if e.kind == "ask":
                waits = self.waiting.exists() and any(r[0] == e.request_id for r in self.waiting.get())
                if running is None:
                    out.append(self._release(key[0], e.request_id, "asked", at))
                elif running[0] != e.request_id and not waits:  # a request that is sent again changes nothing
                    self.waiting.appendValue((e.request_id,))
            elif running is not None and running[0] == e.request_id:
                out += self._next(key[0], "next", at)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        running = self.running.get() if self.running.exists() else None
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = self._next(key[0], "timeout", at) if running is not None and running[1] <= at else []
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "request_id", "why", "at"]).astype({"at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, lease_seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """Released requests (columns of RELEASED) of a stream of EVENT rows.

    Sessions are keys of the state, so that one that waits holds up no other, and a session's events meet in one task whatever
    their number; the queue of one session alone is read at a time. Events later than `late` behind the newest are dropped.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(OneAtATime(lease_seconds * 1000), RELEASED, "append", "EventTime")


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that in_order needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
