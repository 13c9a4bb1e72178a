"""First-wins deduplication by one key and by two."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.text import first_filled, fuzzy_key
from listingflow.shared import staged, unstage


def first_per_key(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The first row of each key by ``order``, aggregated before the shuffle; null keys are one key."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    grouped = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, order).alias("_row"))
    return grouped.select("_row.*")


def strategy_key(strategy: str = "url") -> list[Column]:
    """Keys of the strategies ``url`` (title and company where it is empty), ``exact`` and ``fuzzy``."""
    c = F.col
    if strategy == "url":
        return [first_filled(c("url"), F.concat_ws("_", c("title"), c("company")))]
    if strategy == "exact":
        return [c("title"), c("company"), c("location"), c("url")]
    if strategy == "fuzzy":
        return [fuzzy_key(c("title"), c("company"))]
    raise ValueError(f"unknown strategy {strategy}")


def greedy_two_key(df: DataFrame, first: str, second: str, order: str, plain: int = 3, rounds: int = 12) -> DataFrame:
    """What a scan by ``order`` keeps that drops a row if an earlier kept row has its ``first`` or its ``second`` key.

    Only kept rows shadow others, so this is not two deduplications.  In each round the
    rows that come first in both their groups are kept, and all that share a key with
    them go; few rounds are usual.  Rounds work on order and keys alone and are written
    to the shared folder.  ``order`` must be distinct; null keys are one key.

    Chains of rows that alternate their keys would need a round for each second row.  So after the ``plain`` rounds each also follows
    every row that a single earlier one can shadow to where that one is decided, by doubling its steps: a chain of any length is
    one round of as many joins as its length has binary digits.  What is left after ``rounds`` is scanned, each component of
    rows connected by keys by one task, which holds the keys it has kept.
    """
    live = staged(df.select(F.col(order).alias("o"), F.to_json(F.struct(F.col(first).alias("k"))).alias("a"), F.to_json(F.struct(F.col(second).alias("k"))).alias("b")), "greedy")
    kept = []
    while not live.isEmpty():
        if len(kept) >= rounds:
            kept.append(staged(_scan(live), "greedy-rest"))
            break
        if len(kept) < plain:
            ma, mb = live.groupBy("a").agg(F.min("o").alias("o")), live.groupBy("b").agg(F.min("o").alias("o"))
            won = staged(live.join(ma.select("o"), "o", "left_semi").join(mb.select("o"), "o", "left_semi"), "greedy-kept")
        else:
            won = _followed(live)
        kept.append(won.select("o"))
        old, live = live, staged(live.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"), "greedy")
        unstage(old)
    if not kept:
        return df
    all_kept = kept[0]
    for k in kept[1:]:
        all_kept = all_kept.union(k)
    return df.join(all_kept.withColumnRenamed("o", order), order, "left_semi").select(*df.columns)


def _followed(live: DataFrame) -> DataFrame:
    """Rows that no earlier one can shadow, and those kept among the rows that lead to them one by one."""

    def ranked(rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with the first row of their group and whether they are its first (1), its second (2), or later ones (3)."""
        # written, so that joins have plain exchanges, which can be split at a hot key
        least = staged(rows.groupBy(key).agg(F.min("o").alias(f"first_{key}")), "greedy-first")
        with_first = rows.join(least, key)
        after = staged(with_first.where(F.col("o") > F.col(f"first_{key}")).groupBy(key).agg(F.min("o").alias(f"second_{key}")), "greedy-second")
        rank = F.when(F.col("o") == F.col(f"first_{key}"), 1).when(F.col("o") == F.col(f"second_{key}"), 2).otherwise(3)
        return with_first.join(after, key, "left").withColumn(f"rank_{key}", rank).drop(f"second_{key}")

    rows = staged(ranked(ranked(live, "a"), "b"), "greedy-ranked")
    one = F.when((F.col("rank_a") == 2) & (F.col("rank_b") == 1), F.col("first_a")).when((F.col("rank_a") == 1) & (F.col("rank_b") == 2), F.col("first_b"))
    one = F.coalesce(one, F.when((F.col("rank_a") == 2) & (F.col("rank_b") == 2) & (F.col("first_a") == F.col("first_b")), F.col("first_a")))
    steps = staged(rows.select("o", one.alias("to"), F.lit(True).alias("turns")).where("to is not null"), "greedy-steps")
    while True:
        onward = steps.select(F.col("o").alias("to"), F.col("to").alias("next"), F.col("turns").alias("more"))
        met = steps.join(onward, "to", "left")
        went = staged(met.select("o", F.coalesce("next", "to").alias("to"), (F.col("turns") != F.coalesce("more", F.lit(False))).alias("turns"), F.col("next").isNotNull().alias("on")), "greedy-steps")
        unstage(steps)
        steps = went.drop("on")
        if went.where("on").isEmpty():
            break
    roots = rows.where("rank_a = 1 and rank_b = 1").select("o", "a", "b")
    ends = steps.where(~F.col("turns")).join(roots.select(F.col("o").alias("to")), "to", "left_semi")
    return staged(roots.union(rows.join(ends.select("o"), "o", "left_semi").select("o", "a", "b")), "greedy-kept")


def _roots(edges: DataFrame) -> DataFrame:
    """``k`` and ``root``, the least node that it reaches, for each node of the edges (``u``, ``v``) but the roots."""
    edges = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "greedy-edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("k"), F.col("v").alias("root"))
        mark = now
        for both in (True, False):  # neighbours above a node go to its least one, then those below
            near = edges.union(edges.select(F.col("v"), F.col("u"))) if both else edges
            least = staged(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "greedy-least")
            met = near.join(least, F.col("u") == F.col("w"))
            moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("w", "m"))
            old, edges = edges, staged(moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "greedy-edges")
            unstage(old, least)


def _scan(live: DataFrame) -> DataFrame:
    """The ``o`` that a plain scan keeps, by component."""
    own = live.select("o", "a", "b", F.xxhash64("a", F.lit("a")).alias("k"))
    roots = _roots(live.select(F.xxhash64("a", F.lit("a")).alias("u"), F.xxhash64("b", F.lit("b")).alias("v")))
    # keys of one hash join two components, which costs a task's time and no row
    whole = own.join(roots, "k", "left").select("o", "a", "b", F.coalesce("root", "k").alias("root"))

    def run(batches):
        a, b, root = set(), set(), None
        for batch in batches:
            keep = []
            for x, y, r in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "root"))):
                if r != root:
                    a, b, root = set(), set(), r
                keep.append(x not in a and y not in b)
                if keep[-1]:
                    a.add(x)
                    b.add(y)
            yield pa.RecordBatch.from_arrays([batch.column("o")], names=["o"]).filter(pa.array(keep, pa.bool_()))

    return whole.repartition("root").sortWithinPartitions("root", "o").mapInArrow(run, f"o {live.schema['o'].dataType.simpleString()}")
