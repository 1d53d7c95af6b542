"""Cooldown per actor and operation: a call is accepted if enough time has passed since the last accepted one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

# Milliseconds between accepted calls.
COOLDOWNS = {"status": 3000, "sources": 3000, "interventions": 3000, "health": 5000, "cycle": 15000, "resume": 15000, "reanalyse": 15000}
DEFAULT = 5000
OUT = "actor string, operation string, `at` long, call_id long, accepted boolean"


def _accept(calls: pd.DataFrame, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which of one key's calls, in order, are accepted: from each accepted one the search goes on where its wait ends."""
    wait, at = COOLDOWNS.get(calls["operation"].iloc[0], DEFAULT), calls["at"].to_numpy()
    out = np.zeros(len(at), bool)
    i = 0 if last is None else int(np.searchsorted(at, last + wait))
    while i < len(at):
        out[i], last = True, int(at[i])
        i = int(np.searchsorted(at, last + wait))
    return out, last


def limited(calls: DataFrame) -> DataFrame:
    """accepted for each call (actor, operation, at, call_id) of a table. Rejected calls do not extend the wait. A key's calls pass through its task in order and in batches; only the time of the last accepted one is carried on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            parts = []
            new = (batch[["actor", "operation"]] != batch[["actor", "operation"]].shift()).any(axis=1).cumsum()
            for _, own in batch.groupby(new, sort=False):
                own_key = tuple(own[["actor", "operation"]].iloc[0])
                accepted, last = _accept(own, last if own_key == key else None)
                key = own_key
                parts.append(own.assign(accepted=accepted))
            if parts:
                yield pd.concat(parts)

    sorted_calls = calls.select("actor", "operation", "at", "call_id").repartition("actor", "operation").sortWithinPartitions("actor", "operation", "at", "call_id")
    return sorted_calls.mapInPandas(run, OUT)


def limited_stream(calls: DataFrame) -> DataFrame:
    """The same for a stream; the time of the last accepted call is the state of each key."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(parts)).sort_values(["at", "call_id"])
        accepted, last = _accept(own, state.get[0] if state.exists else None)
        if last is not None:
            state.update((last,))
        yield own.assign(accepted=accepted)[["actor", "operation", "at", "call_id", "accepted"]]

    return calls.select("actor", "operation", "at", "call_id").groupBy("actor", "operation").applyInPandasWithState(run, OUT, "last long", "append", "NoTimeout")
