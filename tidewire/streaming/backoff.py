"""How often a source has failed since its last success, and when it may be asked again, as state of a stream.

The state of a source is one value: its failures, the time and number of its last fetch, and when it is eligible. A
processing-time timer stands at that time and tells when the wait is over; every new fetch takes it back. A stream can begin
with the states that another one left. Fetches of a source must arrive in order from batch to batch; within a batch they are
put in order. A null success counts as a failure; fetches without a time are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidewire.functions.rules import BACKOFF_MS

#: told: state after fetches, or eligible when a wait is over.
OUT = "source_id string, told string, failures long, last_at long, next_eligible_at long"
STATE = "failures long, last_at long, fetch_id long, next_eligible_at long"
#: The state store that timers need. A stream with processing-time timers always asks for one more batch, so one that is to end with its data must not make batches without any.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def after(failures: int, ok: np.ndarray) -> int:
    """Failures since the last success, after fetches in order."""
    good = np.flatnonzero(ok)
    return len(ok) - 1 - int(good[-1]) if len(good) else failures + len(ok)


class Backoff(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("backoff", STATE)

    def _told(self, key: tuple, told: str) -> pd.DataFrame:
        failures, last_at, _, next_at = self.state.get()
        return pd.DataFrame({"source_id": [key[0]], "told": [told], "failures": [failures], "last_at": [last_at], "next_eligible_at": pd.array([next_at], "Int64")})

    def _keep(self, failures: int, last_at: int, fetch_id: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        next_at = last_at + BACKOFF_MS[min(failures, len(BACKOFF_MS)) - 1] if failures else None
        self.state.update((failures, last_at, fetch_id, next_at))
        if next_at is not None:
            self.handle.registerTimer(next_at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, last_at, fetch_id = self.state.get()[:3] if self.state.exists() else (0, None, None)
        parts = [p.dropna(subset=["at"]) for p in rows]
        new = pd.concat(parts).sort_values(["at", "fetch_id"])
        if len(new):
            self._keep(after(failures, new["ok"].eq(True).to_numpy(bool)), int(new["at"].iloc[-1]), int(new["fetch_id"].iloc[-1]))
            yield self._told(key, "state")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[3] == expiredTimerInfo.getExpiryTimeInMs():
            yield self._told(key, "eligible")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self._keep(int(row["failures"]), int(row["last_at"]), int(row["fetch_id"]))

    def close(self) -> None:
        pass


def backoff(log: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """What is told of each source of a stream of fetches (source_id, at in ms, fetch_id, ok). initial: source_id, failures, last_at, fetch_id to begin with."""
    begin = None if initial is None else initial.select("source_id", "failures", "last_at", "fetch_id").groupBy("source_id")
    fetches = log.selectExpr("cast(source_id as string) as source_id", "at", "fetch_id", "ok")
    return fetches.groupBy("source_id").transformWithStateInPandas(Backoff(), OUT, "Update", "ProcessingTime", begin)


def write(log: DataFrame, out: str, checkpoint: str, initial: DataFrame | None = None) -> StreamingQuery:
    """Writes what is told to a folder of the batch's own number, so that a batch that runs again replaces what it wrote; each row has its batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for k, v in STORE.items():
        log.sparkSession.conf.set(k, v)
    return backoff(log, initial).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
