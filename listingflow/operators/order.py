"""Global positions without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.shared import staged


def numbered(df: DataFrame, *order: str, name: str = "_pos") -> DataFrame:
    """``df`` with the 0-based position of each row by ``order``, which should be a total order.

    Rows are dealt by range, counted by range, and numbered within it; what is summed in
    one task is a row for each range.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", within).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_ahead") + F.col("_in") - 1).cast("long")).drop("_range", "_in", "_ahead")


def same(left: list[Column], right: list[Column]) -> Column:
    """Equality of all, nulls alike."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def tiled(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt into ranges of ``keys`` and ``order`` (``_range``), and a table of how many rows of a key lie before each of its ranges (``_ahead``).

    The table has only keys of several ranges: two rows for each range at most, so that it can be broadcast.
    A hot key is dealt over as many ranges as its rows fill.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(df.repartitionByRange(parts, *keys, order).withColumn("_range", F.spark_partition_id()), "tiles")
    of_key = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_n").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_tiles", F.count("*").over(of_key)).withColumn("_ahead", ahead)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return dealt, staged(counts.where("_tiles > 1").select(*named, F.col("_range").alias("_tile"), "_ahead"), "tiles-ahead")


def numbered_within(df: DataFrame, keys: list[str], order: str, name: str = "_pos") -> DataFrame:
    """``df`` with the 0-based position of each row within its key by ``order``, which should be total; nulls are one key."""
    dealt, tiles = tiled(df, keys, order)
    here = same([F.col(k) for k in keys], [F.col(f"_k{i}") for i in range(len(keys))]) & (F.col("_range") == F.col("_tile"))
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(order)) - 1
    return dealt.withColumn("_in", place).join(F.broadcast(tiles), here, "left").select(*df.columns, (F.coalesce("_ahead", F.lit(0)) + F.col("_in")).cast("long").alias(name))


def with_halos(df: DataFrame, keys: list[str], order: str, before: int) -> DataFrame:
    """``df`` by tiles (``_range``), each with the ``before`` rows of its key that come ahead of it, marked ``_halo``.

    These are taken from as many tiles as needed; so a frame of ``before`` rows and the current one is whole within a tile.
    """
    dealt, tiles = tiled(df, keys, order)
    of = [F.col(f"_k{i}") for i in range(len(keys))]
    own = dealt.join(F.broadcast(tiles), same([F.col(k) for k in keys], of) & (F.col("_range") == F.col("_tile"))).drop(*[f"_k{i}" for i in range(len(keys))], "_tile")
    own = own.withColumn("_g", F.col("_ahead") + F.row_number().over(Window.partitionBy("_range", *keys).orderBy(order)) - 1).withColumnRenamed("_ahead", "_own")
    needs = same([F.col(k) for k in keys], of) & (F.col("_tile") > F.col("_range")) & (F.col("_g") >= F.col("_ahead") - before)
    halo = own.join(F.broadcast(tiles), needs).select(*df.columns, F.col("_tile").alias("_range"), F.lit(True).alias("_halo"))
    return dealt.withColumn("_halo", F.lit(False)).unionByName(halo)


def page(df: DataFrame, *order: str, number: int = 0, size: int = 100) -> DataFrame:
    """Page ``number`` of ``size`` rows by ``order``."""
    return df.orderBy(*order).offset(number * size).limit(size)


def index_pages(df: DataFrame, *order: str, path: str) -> None:
    """Writes ``df`` to ``path`` in ranges of ``order``, which should be total, with how many rows lie before each."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/columns")
    counts = _ranges_of(df.sparkSession, path).groupBy("_range").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts.withColumn("ahead", ahead).write.parquet(f"{path}/ranges")


def _ranges_of(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("_range", T.IntegerType())).parquet(f"{path}/rows")


def indexed_page(spark: SparkSession, *order: str, path: str, number: int = 0, size: int = 100) -> DataFrame:
    """Page ``number`` of ``size`` rows of what :func:`index_pages` wrote; only the ranges that the page lies in are read."""
    start, end = number * size, (number + 1) * size
    met = spark.read.parquet(f"{path}/ranges").where((F.col("ahead") < end) & (F.col("ahead") + F.col("n") > start)).collect()  # as many as a page has
    first = min((r["ahead"] for r in met), default=start)
    rows = _ranges_of(spark, path).where(F.col("_range").isin([r["_range"] for r in met])).drop("_range")
    return rows.orderBy(*order).offset(start - first).limit(size)


def last_rows(df: DataFrame, *order: str, n: int = 1000) -> DataFrame:
    """The ``n`` last rows by ``order``: logs keep no more."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
