"""Listings, calls and logs as views of the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The place of a listing among all: a struct, so that no global numbering is needed.
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def order() -> Column:
    return F.struct(*ORDER)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as listings: the part's name is the title, its brand the company, its type the location."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    # orders first: lines are narrow until the parts' texts come to them
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        *ORDER,
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("postedDate"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("salaryMin"),
        F.col("l_extendedprice").alias("salaryMax"),
        F.col("o_orderpriority").alias("descriptionText"),
    )


LISTINGS_SQL = """
listings AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey AS VARCHAR) AS id, p_name AS title, p_brand AS company, p_type AS location,
    strftime(o_orderdate, '%Y-%m-%d') AS postedDate, o_orderpriority AS descriptionText
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings with ids that several share."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), (F.col("p_size") * 7 + F.col("p_partkey") % 11).cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"), F.lit("").alias("url"))


PARTS_SQL = """
parts AS (
  SELECT p_partkey AS ord, CAST(p_size * 7 + p_partkey % 11 AS VARCHAR) AS id, p_name AS title, p_brand AS company, p_type AS location FROM part)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts as entries seen before, admitted a day apart by size."""
    p = table(spark, sf_dir, "part").where("p_size >= 40")
    return p.select(F.col("p_partkey").cast("string").alias("listingId"), F.upper("p_brand").alias("company"), F.concat(F.lit("  "), "p_name").alias("title"), (F.col("p_size").cast("long") * 86_400_000).alias("admitTime"), F.lit(None).cast("long").alias("lastProcessed"))


REGISTRY_SQL = """
registry AS (
  SELECT CAST(p_partkey AS VARCHAR) AS listingId, p_brand AS company, p_name AS title, CAST(p_size AS BIGINT) * 86400000 AS admitTime FROM part WHERE p_size >= 40)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a user; an error is a failed call."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_type") != "error").alias("ok"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a statistics log: errors and clicks count, purchases take time, views are gauges."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "timer").when(F.col("event_type") == "view", "gauge").otherwise("counter")
    name = F.when(F.col("event_type") == "error", "operations.failed").when(F.col("event_type") == "click", "operations.successful").otherwise(F.concat(F.lit("x."), "event_type"))
    return e.select("event_id", "ts", kind.alias("kind"), name.alias("name"), "value")


def timer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends of a timer for each event."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("x."), "event_type").alias("name"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("ms"), "event_id")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("ms") * 1000)
    starts = e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("timer_start").alias("kind"), "id", "name")
    return starts.union(e.where("event_id % 10 != 0").select(end.alias("ts"), F.lit("timer_end").alias("kind"), "id", "name"))
