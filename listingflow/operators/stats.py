"""Run statistics from an event log, and rolling metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.numbers import half_up
from listingflow.functions.text import error_category
from listingflow.operators.order import with_halos

#: Counters that are kept.
COUNTERS = (
    "operations.total", "operations.successful", "operations.failed", "operations.warnings",
    "api.totalCalls", "api.successfulCalls", "api.failedCalls", "api.retries", "api.circuitBreakerTrips",
)
PREFIXES = ("files.", "network.", "data.", "errors.")


def counters(log: DataFrame, known: tuple | None = COUNTERS) -> DataFrame:
    """Sums by name; with ``known``, other names are left out but for those of the open groups."""
    rows = log.where("kind = 'counter'")
    if known is not None:
        fits = F.col("name").isin(list(known))
        for p in PREFIXES:
            fits = fits | F.col("name").startswith(p)
        rows = rows.where(fits)
    return rows.groupBy("name").agg(F.sum("value").alias("value"))


def timers(log: DataFrame) -> DataFrame:
    """Milliseconds by operation and, with a null name, in all."""
    return log.where("kind = 'timer'").rollup("name").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def pair_timers(log: DataFrame, within: str = "1 hour") -> DataFrame:
    """``id``, ``name``, ``started``, ``ended`` and ``duration`` (milliseconds) of every timer that was started.

    ``log`` has ``ts``, ``kind`` (``timer_start``, ``timer_end``), ``id`` and ``name``, as a table or a stream.  The first start and the first end of an id
    count.  A start without an end ``within`` that time has null ``ended`` and ``duration``; ends without a
    start, and events with a null id or time, are left out.  A stream keeps what is open for that long and gives unpaired starts once
    its watermark has passed them.
    """
    rows = log.where("id is not null and ts is not null")

    def firsts(kind: str, *more: str) -> DataFrame:
        own = rows.where(F.col("kind") == kind).select("id", "ts", *more)
        if own.isStreaming:
            return own.withWatermark("ts", within).dropDuplicatesWithinWatermark(["id"])
        return own.groupBy("id").agg(F.min("ts").alias("ts"), *[F.min_by(c, "ts").alias(c) for c in more])

    s = firsts("timer_start", "name").select("id", "name", F.col("ts").alias("started"))
    e = firsts("timer_end").select(F.col("id").alias("_id"), F.col("ts").alias("ended"))
    span = F.expr(f"INTERVAL {within}")
    both = s.join(e, (F.col("id") == F.col("_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + span), "left").drop("_id")
    return both.withColumn("duration", (F.unix_micros("ended") - F.unix_micros("started")) / 1000)


def timer_totals(paired: DataFrame) -> DataFrame:
    """Milliseconds, ended and open timers by operation and, with a null name, in all."""
    return paired.rollup("name").agg(F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total"), F.count("duration").alias("n"), F.count_if(F.col("duration").isNull()).alias("open"))


def gauges(log: DataFrame) -> DataFrame:
    """The peak, the last, the first and the mean value of each gauge, and how much it grew."""
    first, last = F.min_by("value", "ts"), F.max_by("value", "ts")
    return log.where("kind = 'gauge'").groupBy("name").agg(first.alias("first"), last.alias("last"), F.max("value").alias("peak"), F.avg("value").alias("mean"), (last - first).alias("growth"))


def histograms(log: DataFrame) -> DataFrame:
    return log.where("kind = 'histogram'").groupBy("name").agg(F.avg("value").alias("mean"), F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p50_p95_p99"))


def error_categories(log: DataFrame, message: str = "message") -> DataFrame:
    return log.groupBy(error_category(F.col(message)).alias("category")).agg(F.count("*").alias("n"))


def categorised(log: DataFrame, message: str = "message") -> DataFrame:
    """The log's errors with their ``category``: the list of details behind :func:`error_categories`."""
    return log.withColumn("category", error_category(F.col(message)))


def call_metrics(calls: DataFrame, *order: str, n: int = 1000) -> DataFrame:
    """Requests, success rate, mean duration, and sum and mean of ``tokens`` over the last ``n`` calls; zeros of none."""
    from listingflow.operators.order import last_rows

    count = F.count("*")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    total = F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")
    return last_rows(calls, *order, n=n).agg(count.alias("requests"), rate(F.count_if("ok"), count).alias("success_rate"), mean("duration").alias("mean_duration"), total.alias("tokens"), mean("tokens").alias("mean_tokens"))


def parse_metrics(parses: DataFrame) -> DataFrame:
    """Attempts by the ``way`` that JSON was come by and the ``kind`` of its error, with the mean ``duration``."""
    return parses.groupBy("way", "kind").agg(F.count("*").alias("attempts"), F.avg("duration").alias("mean_duration"))


def rate(part: Column, whole: Column) -> Column:
    """A percentage, 0 of nothing."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def final_rates(calls: DataFrame, ok: Column, duration: Column) -> DataFrame:
    """Calls, success and error rates, mean duration."""
    n, good = F.count("*"), F.count_if(ok)
    return calls.agg(n.alias("calls"), half_up(rate(good, n), 2).alias("success_rate"), half_up(rate(n - good, n), 2).alias("error_rate"), half_up(F.coalesce(F.avg(duration), F.lit(0.0)), 4).alias("mean_duration"))


def provider_health(calls: DataFrame) -> DataFrame:
    """A status for each provider by error share (0.2, 0.5) and mean duration (15 s, 30 s)."""
    grouped = calls.groupBy("provider").agg(F.avg((~F.col("ok")).cast("int")).alias("error_share"), F.avg("duration").alias("mean_duration"))
    status = F.when((F.col("error_share") > 0.5) | (F.col("mean_duration") > 30_000), "unhealthy").when((F.col("error_share") > 0.2) | (F.col("mean_duration") > 15_000), "degraded").otherwise("healthy")
    return grouped.withColumn("status", status)


def rolling(df: DataFrame, keys: list[str], order: str, value: str, n: int = 100) -> DataFrame:
    """``df`` with the peak and the mean of the last ``n`` values of its key.

    Rows are dealt into tiles of keys and order, each with the ``n`` - 1 rows ahead of it, so that a hot key runs on all
    cores.  ``order`` should be total; nulls are one key.
    """
    tiles = with_halos(df, keys, order, n - 1)
    last = Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(1 - n, 0)
    return tiles.withColumn("rolling_peak", F.max(value).over(last)).withColumn("rolling_mean", F.avg(value).over(last)).where(~F.col("_halo")).drop("_range", "_halo")


def last_per_key(df: DataFrame, keys: list[str], order: str, n: int = 5) -> DataFrame:
    """The last ``n`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def pipeline_counts(files: Column, total: Column, duplicates: Column, filtered: Column) -> list[Column]:
    """Files, rows merged, duplicates, filtered rows and rows left."""
    bad = F.count_if(duplicates | filtered)
    return [F.count_distinct(files).alias("files"), F.count(total).alias("merged"), F.count_if(duplicates).alias("duplicates"), F.count_if(filtered & ~duplicates).alias("filtered"), (F.count(total) - bad).alias("left")]
