"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import staged, unstage


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (``u``, ``v``) that is not itself a root.

    Every round writes its edges to the shared folder, so a lost executor costs one
    round at most.  Minima are written before they are joined back: both sides of that
    join are then plain exchanges, which adaptive execution can split at a hot node.
    """
    edges = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    sign = _signature(edges)
    while sign[0]:
        both = edges.union(edges.select("v", "u"))
        minima = staged(both.groupBy("u").agg(F.min("v").alias("m")), f"{label}-large")
        least = minima.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u != v").distinct(), label)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-small")
        other = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, staged(other.union(least.select("u", F.col("m").alias("v"))).distinct(), label)
        unstage(old, minima, large, least)
        before, sign = sign, _signature(edges)
        if sign == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return got["n"], got["s"], got["x"]
