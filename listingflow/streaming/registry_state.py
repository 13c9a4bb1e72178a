"""The registry as keyed state of a stream.

Each normalised company and title holds its entry; a listing is admitted if there is none, or if it was admitted ``ttl``
or longer ago.  Event-time timers clear entries once the watermark has passed their end.  A stream can start from a
registry, and what it holds is read back as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from listingflow import schemas
from listingflow.functions.text import normalize_string
from listingflow.operators.registry import DAY_MS, can_match

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = T.StructType([T.StructField("listingId", T.StringType()), T.StructField("company", T.StringType()), T.StructField("title", T.StringType()), T.StructField("admitTime", T.LongType())])
ADMITTED = T.StructType([T.StructField("c", T.StringType()), T.StructField("t", T.StringType()), *STATE.fields])


class _Entries(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", STATE)

    def _hold(self, entry: tuple) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.entry.update(entry)
        self.handle.registerTimer(entry[3] + self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else None
        for e in initialState.itertuples(index=False):
            if held is None or e.admitTime > held[3]:
                held = (e.listingId, e.company, e.title, int(e.admitTime))
        self._hold(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, admitted = self.entry.get() if self.entry.exists() else None, []
        batch = pd.concat(list(rows)).sort_values(["admitTime", "listingId"])
        for e in batch.itertuples(index=False):
            if held is None or e.admitTime - held[3] >= self.ttl:
                held = (e.listingId, e.company, e.title, int(e.admitTime))
                admitted.append((*key, *held))
        if admitted:
            self._hold(held)
        yield pd.DataFrame(admitted, columns=ADMITTED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.entry.exists() and self.entry.get()[3] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("c", normalize_string(F.col("company"))).withColumn("t", normalize_string(F.col("title")))


def admitted_stream(listings: DataFrame, time: str = "ts", delay: str = "1 hour", ttl: int = 30 * DAY_MS, registry: DataFrame | None = None) -> DataFrame:
    """``listingId``, ``company``, ``title`` and ``admitTime`` (milliseconds) of the listings of a stream that are admitted.

    ``listings`` has ``listingId``, ``company``, ``title`` and the timestamp ``time``.  Within a micro-batch earlier listings come first, then smaller
    ids.  Those without an id, a time or a title and company that can match are left out, and so are those later than the
    watermark.  ``registry``: entries the stream starts from.  The session must use the state store of RocksDB (``PROVIDER``).
    A key's rows of one micro-batch are in one task; state is spread by key.
    """
    spark = listings.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    good = listings.where(can_match(F.col("title"), F.col("company")) & F.col("listingId").isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = _keyed(good).select("c", "t", F.col("listingId").cast("string").alias("listingId"), "company", "title", F.unix_millis(time).alias("admitTime"), time)
    start = None
    if registry is not None:
        start = _keyed(registry.where(can_match(F.col("title"), F.col("company")))).select("c", "t", *STATE.names).groupBy("c", "t")
    out = rows.groupBy("c", "t").transformWithStateInPandas(_Entries(ttl), ADMITTED, "append", "eventtime", initialState=start)
    return out.drop("c", "t")


def state_registry(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The registry that a stream of :func:`admitted_stream` holds in its ``checkpoint``."""
    held = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    return held.select("value.*").withColumn("lastProcessed", F.lit(None).cast("long")).select(*schemas.REGISTRY.names)


def admitted(listings: DataFrame, time: str = "ts", ttl: int = 30 * DAY_MS, registry: DataFrame | None = None) -> DataFrame:
    """What :func:`admitted_stream` admits of a table, a key's rows in the order of time and id.

    A key whose rows span less than ``ttl`` and that the registry lacks is one aggregate; only the others are walked, a key in one task.
    """
    good = listings.where(can_match(F.col("title"), F.col("company")) & F.col("listingId").isNotNull() & F.col(time).isNotNull())
    rows = _keyed(good).select("c", "t", F.col("listingId").cast("string").alias("listingId"), "company", "title", F.unix_millis(time).alias("admitTime"))
    if registry is None:
        known = rows.sparkSession.createDataFrame([], "rc string, rt string, held long")
    else:
        known = _keyed(registry.where(can_match(F.col("title"), F.col("company")))).groupBy(F.col("c").alias("rc"), F.col("t").alias("rt")).agg(F.max("admitTime").alias("held"))
    whole = F.struct(*STATE.names)
    by_key = rows.groupBy("c", "t").agg(F.min_by(whole, F.struct("admitTime", "listingId")).alias("first"), F.max("admitTime").alias("last"))
    by_key = by_key.join(known, (F.col("c") == F.col("rc")) & (F.col("t") == F.col("rt")), "left").drop("rc", "rt")
    simple = (F.col("last") - F.col("first.admitTime") < ttl) & (F.col("held").isNull() | (F.col("last") - F.col("held") < ttl) | (F.col("first.admitTime") - F.col("held") >= ttl))
    ones = by_key.where(simple & (F.col("held").isNull() | (F.col("first.admitTime") - F.col("held") >= ttl))).select("first.*")
    again = rows.join(by_key.where(~simple).select(F.col("c").alias("kc"), F.col("t").alias("kt"), "held"), (F.col("c") == F.col("kc")) & (F.col("t") == F.col("kt"))).drop("kc", "kt")

    def walk(batches):
        key, held = None, None
        for part in batches:
            out = []
            for e in part.itertuples(index=False):
                if (e.c, e.t) != key:
                    key, held = (e.c, e.t), None if pd.isna(e.held) else int(e.held)
                if held is None or e.admitTime - held >= ttl:
                    held = int(e.admitTime)
                    out.append((e.listingId, e.company, e.title, held))
            yield pd.DataFrame(out, columns=STATE.names)

    walked = again.repartition("c", "t").sortWithinPartitions("c", "t", "admitTime", "listingId").mapInPandas(walk, STATE)
    return ones.union(walked)
