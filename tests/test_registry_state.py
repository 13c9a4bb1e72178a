"""The registry as state: restarts, timers, a start from a registry, and the same rows in batch."""

import random

import pytest
from pyspark.sql import functions as F

from listingflow import schemas
from listingflow.streaming import registry_state as rs

DAY = 86_400_000
LISTING = "listingId string, company string, title string, ts timestamp"


def listings(spark, days, seed=0):
    rng = random.Random(seed)
    rows = [(f"{d:03d}-{i}", rng.choice(["Acme", " ACME ", "Bo", "c" * 101]), rng.choice(["Cook", "cook ", "Red  hat", None]), d * 86_400 + rng.randint(0, 80_000)) for d in days for i in range(4)]
    df = spark.createDataFrame(rows, "listingId string, company string, title string, s long")
    return df.select("listingId", "company", "title", F.timestamp_seconds("s").alias("ts"))


def plain(rows, start, ttl):
    held, out = dict(start), []
    for r in sorted(rows, key=lambda r: (r["ts"], r["listingId"])):
        if not r["title"] or len(r["company"]) > 100:
            continue
        key = (" ".join(r["company"].lower().split()), " ".join(r["title"].lower().split()))
        ms = int(r["ts"].timestamp() * 1000)
        if key not in held or ms - held[key] >= ttl:
            held[key] = ms
            out.append((r["listingId"], r["company"], r["title"], ms))
    return sorted(out), held


@pytest.fixture
def rocks(spark):
    spark.conf.set(rs.PROVIDER, rs.ROCKS)
    yield
    spark.conf.unset(rs.PROVIDER)


def test_stream_and_batch_admit_the_same(spark, tmp_path, rocks):
    ttl, start = 10 * DAY, {("acme", "cook"): 95 * DAY, ("bo", "red hat"): 60 * DAY}
    registry = spark.createDataFrame([("r", c, t, ms, None) for (c, t), ms in start.items()], schemas.REGISTRY)
    parts = [listings(spark, range(100, 104), 1), listings(spark, range(108, 113), 2), listings(spark, range(125, 128), 3)]
    want, held = plain([r for p in parts for r in p.collect()], start, ttl)
    every = parts[0].union(parts[1]).union(parts[2])
    assert sorted(map(tuple, rs.admitted(every, ttl=ttl, registry=registry).collect())) == want
    assert sorted(map(tuple, rs.admitted(every, ttl=ttl).collect())) == plain(every.collect(), {}, ttl)[0]
    for part in parts:  # each a run of its own: state stays over restarts
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LISTING).parquet(f"{tmp_path}/in")
        out = rs.admitted_stream(stream, ttl=ttl, registry=registry)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    kept = rs.state_registry(spark, f"{tmp_path}/state")
    assert kept.schema.names == schemas.REGISTRY.names
    now = max(held.values())
    assert sorted(r["admitTime"] for r in kept.collect()) == sorted(ms for ms in held.values() if ms + ttl > now - DAY)  # timers cleared the others


def test_empty_tables_and_the_wrong_store(spark):
    none = spark.createDataFrame([], LISTING)
    assert rs.admitted(none).count() == 0
    with pytest.raises(ValueError, match="RocksDB"):
        rs.admitted_stream(none)
