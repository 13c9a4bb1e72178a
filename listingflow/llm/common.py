"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingflow.shared import staged, unstage  # noqa: F401

#: ASCII white space, the separator of words in every operator here.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the same ``keys`` up to each in ``order``, which should be total.

    Rows are dealt by range; what one task sums of a key is its rows of one range, and then
    one row for each range, so a hot key is spread.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "running")
    by_range = staged(dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")), "running-sums")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_range.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_in", F.sum(value).over(within)).join(ahead, [*keys, "_range"]).withColumn(name, F.col("_ahead") + F.col("_in")).drop("_range", "_in", "_ahead")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, followed by as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
