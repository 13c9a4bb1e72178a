"""Machines replayed over event logs: rows of a key by time, each with its outcome."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listingflow.streaming.machines import Breaker, RateLimiter


def replay(log: DataFrame, machine: Callable[[], RateLimiter | Breaker], key: str, event: str = "event_id", ms: str = "ms", ok: str = "ok") -> DataFrame:
    """``key``, ``event`` and ``outcome`` of each row; equal times go by event.

    Rows are sorted by Spark within partitions of whole keys and pass one by one, so a
    key of any length needs the state of one machine only.
    """
    rows = log.select(F.col(key).alias("k"), F.col(event).alias("e"), F.col(ms).cast("long").alias("ms"), F.col(ok).cast("boolean").alias("ok"))
    kinds = rows.schema
    dealt = rows.repartition("k").sortWithinPartitions("k", "ms", "e")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = object(), None
        for part in parts:
            out = []
            for k, t, good in zip(part["k"].tolist(), part["ms"].tolist(), part["ok"].tolist()):
                if now is None or k != at:
                    at, now = k, machine()
                out.append(now.step(t, good))
            yield pd.DataFrame({"k": part["k"], "e": part["e"], "outcome": out})

    out = dealt.mapInPandas(run, f"k {kinds['k'].dataType.simpleString()}, e {kinds['e'].dataType.simpleString()}, outcome string")
    return out.withColumnsRenamed({"k": key, "e": event})


def replay_stream(events: DataFrame, machine: Callable[[], RateLimiter | Breaker], key: str, idle_ms: int | None = None, event: str = "event_id", ms: str = "ms", ok: str = "ok") -> DataFrame:
    """The same over a stream: the machine's state is kept for each key, or dropped after ``idle_ms`` without events.

    A stream with ``idle_ms`` looks for idle keys all the time, so it doesn't end by itself.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(event).cast("long").alias("e"), F.col(ms).cast("long").alias("ms"), F.col(ok).cast("boolean").alias("ok"))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = machine()
        if state.exists:
            now.load(json.loads(state.get[0]))
        for part in parts:
            part = part.sort_values(["ms", "e"])
            outcomes = [now.step(int(t), bool(good)) for t, good in zip(part["ms"], part["ok"])]
            yield pd.DataFrame({"k": part["k"], "e": part["e"], "outcome": outcomes})
        state.update((json.dumps(now.dump()),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("k").applyInPandasWithState(run, "k string, e long, outcome string", "dump string", "append", timeout)


def unseen_stream(events: DataFrame, keys: list[str], time: str, ttl: str = "30 days") -> DataFrame:
    """Events whose keys were not seen within ``ttl``: the registry as a stream."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def micro_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """``handle`` of each micro-batch of what is there now; a batch that was handled isn't handled again."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
