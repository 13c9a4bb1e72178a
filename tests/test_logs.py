"""Tiles of hot keys, paired timers, counts in passing, and what is judged."""

import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listingflow.functions.json_repair import is_json, repair_json, repaired
from listingflow.operators import batching, filters, order, stats
from listingflow.plans.pipelines import judge
from listingflow.plans.scoring import keyword_scorer


@pytest.mark.parametrize("parts", ["1", "7"])
def test_rolling_frames_of_a_hot_key(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randint(0, 99)) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for n in (1, 3, 100, 650):  # the last frame reaches over several tiles
            last = Window.partitionBy("k").orderBy("o").rowsBetween(1 - n, 0)
            want = df.withColumn("rolling_peak", F.max("v").over(last)).withColumn("rolling_mean", F.avg("v").over(last))
            got = stats.rolling(df, ["k"], "o", "v", n)
            assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        want = df.withColumn("p", (F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).cast("long"))
        assert sorted(map(tuple, order.numbered_within(df, ["k"], "o", "p").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        if parts == "7":  # one key lies in several tiles
            assert order.with_halos(df, ["k"], "o", 99).where("k = 'hot' and not _halo").select("_range").distinct().count() > 3
        assert stats.rolling(df.limit(0), ["k"], "o", "v").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


LOG = "ts timestamp, kind string, id string, name string"


def test_timers_in_batch_and_as_a_stream(spark, tmp_path):
    rows = []
    for i in range(40):
        rows.append((f"2024-01-01 00:{i:02d}:00", "timer_start", f"i{i}", f"op{i % 3}"))
        if i % 4:
            rows.append((f"2024-01-01 00:{i:02d}:0{i % 7}.250", "timer_end", f"i{i}", None))
    rows += [("2024-01-01 00:10:00", "timer_end", "nobody", None), (None, "timer_start", "x", "op"), ("2024-01-01 00:10:00", "timer_start", None, "op"), ("2024-01-01 00:05:00", "counter", "i5", "op")]
    df = spark.createDataFrame([(*r,) for r in rows], "t string, kind string, id string, name string").select(F.col("t").cast("timestamp").alias("ts"), "kind", "id", "name")
    batch = stats.pair_timers(df, "10 minutes")
    got = {r["id"]: r for r in batch.collect()}
    assert len(got) == 40 and all((r["duration"] is None) == (int(k[1:]) % 4 == 0) for k, r in got.items()) and got["i5"]["duration"] == 5250.0
    totals = {r["name"]: (r["total"], r["n"], r["open"]) for r in stats.timer_totals(batch).collect()}
    assert totals[None] == (sum(r["duration"] or 0 for r in got.values()), 30, 10) and set(totals) == {None, "op0", "op1", "op2"}
    again = df.union(df.where("id = 'i5'").withColumn("ts", F.expr("ts + INTERVAL 1 minute")))
    assert {r["id"]: r["duration"] for r in stats.pair_timers(again, "10 minutes").collect()} == {k: r["duration"] for k, r in got.items()}  # later ones of an id don't count
    late = spark.createDataFrame([("2024-01-02", "timer_start", "late", "op"), ("2024-01-02", "timer_end", "later", None), ("2024-01-03", "timer_start", "last", "op"), ("2024-01-03", "timer_end", "end", None)], "t string, kind string, id string, name string")
    late = late.select(F.col("t").cast("timestamp").alias("ts"), "kind", "id", "name")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    late.where("ts < '2024-01-03'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late.where("ts >= '2024-01-03'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stats.pair_timers(stream, "10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out").where("id like 'i%'")
    assert sorted(map(tuple, streamed.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_pages_read_only_their_ranges(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("a"), F.lit("x").alias("b"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    order.index_pages(df, "a", "b", path=str(tmp_path / "p"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for number, size in ((0, 10), (40, 100), (49, 100), (50, 100), (3, 1234), (0, 9999)):
        got = order.indexed_page(spark, "a", "b", path=str(tmp_path / "p"), number=number, size=size)
        assert [r["a"] for r in got.collect()] == list(range(5000))[number * size : (number + 1) * size]
    page = order.indexed_page(spark, "a", "b", path=str(tmp_path / "p"), number=40, size=10)
    assert spark.read.parquet(f"{tmp_path}/p/rows").select("_range").distinct().count() > 10
    assert re.search(r"PartitionFilters: \[isnotnull\(_range#\d+\), \(_range#\d+ = \d+\)\]", page._jdf.queryExecution().toString())  # one range is read
    order.index_pages(df.limit(0), "a", path=str(tmp_path / "none"))
    assert order.indexed_page(spark, "a", path=str(tmp_path / "none")).count() == 0


def test_calls_in_flight(spark):
    import threading
    import time

    now, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01 * (x % 3))
        with lock:
            now[0] -= 1
        if x % 7 == 0:
            raise ValueError(f"no {x}")
        return x

    taken = []
    got = list(batching.in_flight(call, (taken.append(x) or x for x in range(60)), 5))
    assert [str(g) if isinstance(g, Exception) else g for g in got] == [f"no {x}" if x % 7 == 0 else x for x in range(60)] and 1 < most[0] <= 5
    part = batching.in_flight(call, (taken.append(x) or x for x in range(100, 200)), 5)
    next(part)
    assert sum(x >= 100 for x in taken) <= 6  # no more than the window is taken ahead
    list(part)
    assert batching.shares(10, 4) == (4, 2) and batching.shares(2, None) == (2, 1) and batching.shares(1, 9) == (1, 1)

    def slow(record):
        time.sleep(0.05)
        return {"y": record["id"] * 2} if record["id"] % 100 else 1 / 0

    df = spark.range(1000)
    batching.each_row(df.limit(8), slow, "y long", calls=40, tasks=4).count()
    start = time.time()
    rows = batching.each_row(df.select("id", F.col("id").alias("k")), lambda r: {"k": r["k"], **slow(r)}, "k long, y long", calls=40, tasks=4).collect()
    took = time.time() - start
    assert sum(r["error"] is not None for r in rows) == 10 and {r["k"]: r["y"] for r in rows if r["error"] is None} == {i: 2 * i for i in range(1000) if i % 100}
    assert took < 10  # 50 s one after the other, 12.5 s on four tasks with one each


def test_counts_in_passing(spark):
    df = spark.createDataFrame([("Acme", "Cook"), ("Brand#1", "Cook"), ("Acme", "Red"), (None, None)], "company string, title string")
    kept, counts = filters.filter_passes(df, ["brand#1"], ["RED"])
    assert tuple(counts.first()) == (4, 1, 1, 2) and kept.count() == 2
    for none in (df.limit(0), df.where("company = 'none'")):
        kept, counts = filters.filter_passes(none, ["brand#1"], ["RED"])
        assert tuple(counts.first()) == (0, 0, 0, 0) and kept.count() == 0


def test_only_what_is_left_is_scored(spark):
    asked = spark.sparkContext.accumulator(0)

    def scorer(df):
        @F.udf("string")
        def seen(title):
            asked.add(1)
            return title

        return keyword_scorer()(df.withColumn("title", seen("title")))

    rows = [(1, "Software engineer", "c", "d"), (2, "software  ENGINEER", "C", "d"), (3, "Security analyst", "r", "d"), (4, "Cook", "c", None), (5, "Cook", "d", "d"), (6, "Developer engineer", "e", "")]
    df = spark.createDataFrame(rows, "o int, title string, company string, descriptionText string")
    registry = spark.createDataFrame([("9", "R", "security analyst", 100, None)], "listingId string, company string, title string, admitTime long, lastProcessed long")
    got = {r["o"]: (r["route"], r["verdict"] is None) for r in judge(df, registry, scorer, F.col("o"), 100).collect()}
    assert got == {1: ("pass", False), 2: ("dupe", True), 3: ("dupe", True), 4: ("no_description", True), 5: ("fail", False), 6: ("no_description", True)}
    assert asked.value == 2


def test_texts_that_are_json_stay_out_of_python(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}{', "[1,2]", '{"a":1,}', "{'a':1}", '{"a":NaN}', '{"a":1,"a":2}', "01", '"x\ny"', '{"a":"\\q"}', "", "nul", "null", "[1] ]", "1,2", "1}", '1,"b":2', "]", "[", "```json\n[1]\n```", None, '{"a":"\t"}', "/**/1", "1]+[2", '1},"c":{"d":2']

    def valid(t):
        try:
            json.loads(t)
        except (TypeError, ValueError):
            return False
        return True

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", is_json(F.col("t")).alias("sure"), repair_json(F.col("t")).alias("r")).collect()
    assert all(valid(r["t"]) or not r["sure"] for r in rows) and sum(r["sure"] for r in rows) >= 3
    assert [tuple(r["r"]) for r in rows] == [repaired(t) for t in texts]
