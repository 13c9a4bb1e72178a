"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are hashed into blocks.  Its target gives whole passes over
the blocks and, in one further pass, a number of blocks in permuted order, of
which the last is filled with documents that still fit.  The block quotas of all sources
are then split over the output shards by a binary tree: at each node the left
half's quota of each source is drawn from the hypergeometric distribution given
those of the sources before it, so all quotas stay exact and shards have equal
numbers of blocks.  Shards draw disjoint runs of each source's permuted blocks
and shuffle their documents locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.common import let, running, staged, unstage, words_of


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def hypergeometric(u: Column, good: Column, bad: Column, drawn: Column) -> Column:
    """The quantile ``u`` of the number of good items among ``drawn`` of ``good`` + ``bad``; masses beyond nine deviations count as none."""
    total = good + bad
    low, high = F.greatest(F.lit(0).cast("long"), drawn - bad), F.least(good, drawn)
    mean = drawn * good / F.greatest(total, F.lit(1))
    spread = 9 * F.sqrt(mean * (bad / F.greatest(total, F.lit(1))) * ((total - drawn) / F.greatest(total - 1, F.lit(1)))) + 10
    first = F.greatest(low, F.floor(mean - spread).cast("long"))
    last = F.greatest(first, F.least(high, F.ceil(mean + spread).cast("long")))
    zero = F.struct(F.lit(1e-30).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))

    def at(k: Column, p: Column) -> Column:
        """The mass of k + 1 from that of k."""
        return p * ((good - k).cast("double") * (drawn - k)) / ((k + 1).cast("double") * (bad - drawn + k + 1))

    total_mass = F.aggregate(F.sequence(first, last), zero, lambda a, k: F.struct(at(k, a["p"]).alias("p"), (a["sum"] + a["p"]).alias("sum"), a["below"].alias("below")), lambda a: a["sum"])
    pick = lambda mass: F.aggregate(
        F.sequence(first, last),
        zero,
        lambda a, k: F.struct(at(k, a["p"]).alias("p"), (a["sum"] + a["p"]).alias("sum"), (a["below"] + F.when(a["sum"] + a["p"] <= mass, 1).otherwise(0)).alias("below")),
        lambda a: a["below"],
    )
    return F.when(first == last, first).otherwise(let(total_mass * u, lambda mass: F.least(last, first + pick(mass))))


def split_quotas(quotas: DataFrame, shards: int, seed: int, group: int = 1024) -> DataFrame:
    """``shard``, ``source_ix``, ``taken``: the ``quota`` of each ``source_ix`` split over ``shards``.

    A node row holds an entry for each source that has a quota there; a level of the tree
    is one narrow step.  Beyond ``group`` sources, the quotas of groups of sources are split
    first, and then each group's sources have its shares of every node to fill.
    """
    grouped = quotas.select(F.floor(F.col("source_ix") / group).cast("long").alias("g"), F.col("source_ix").alias("ix"), F.col("quota").cast("long").alias("quota"))
    totals = staged(grouped.groupBy("g").agg(F.sum("quota").alias("quota")), "mix-groups")
    if totals.count() > 1:
        _, shares = _tree(totals.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("ix"), "quota"), shards, seed + 1)
        leaves, _ = _tree(grouped, shards, seed, shares)
    else:
        leaves, _ = _tree(grouped, shards, seed)
    return leaves.select(F.col("lo").alias("shard"), F.explode("q").alias("e")).select("shard", F.col("e.ix").alias("source_ix"), F.col("e.quota").alias("taken"))


def _tree(entries: DataFrame, shards: int, seed: int, shares: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The leaves (``lo``, ``q``) of each group ``g`` of ``entries``, and what each node's left half got of each entry.

    Nodes are filled in equal parts or, with ``shares``, by what a tree of the groups gave them.
    """
    nodes = entries.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("ix", "quota"))).alias("q"), F.sum("quota").alias("all"))
    nodes = nodes.select("g", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("n"), "q", "all")
    half = F.floor(F.col("n") / 2).cast("long")
    before = lambda s: F.floor(s * F.col("all") / F.lit(shards)).cast("long")
    node = F.concat_ws(":", F.col("lo"), F.col("n"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    start = F.struct(total.alias("total"), F.col("room"), F.array().cast("array<bigint>").alias("left"))

    def step(a, x):
        drawn = hypergeometric(_uniform(F.lit(seed), node, x["ix"]), x["quota"], a["total"] - x["quota"], a["room"])
        return let(drawn, lambda d: F.struct((a["total"] - x["quota"]).alias("total"), (a["room"] - d).alias("room"), F.concat(a["left"], F.array(d)).alias("left")))

    def part(right: bool) -> Column:
        """The entries of one half, without empty ones."""
        own = F.zip_with("q", "left", lambda x, d: F.struct(x["ix"].alias("ix"), ((x["quota"] - d) if right else d).alias("quota")))
        return F.filter(own, lambda x: x["quota"] > 0)

    width, kept = shards, []
    while width > 1:
        if shares is None:
            nodes = nodes.withColumn("room", before(F.col("lo") + half) - before(F.col("lo")))
        else:
            given = shares.select(F.col("ix").alias("g"), "lo", "n", F.col("given").alias("room"))
            nodes = nodes.join(given, ["g", "lo", "n"], "left").withColumn("room", F.coalesce("room", F.lit(0).cast("long")))
        drawn = nodes.withColumn("left", F.when(F.col("n") > 1, F.aggregate("q", start, step, lambda a: a["left"])))
        if shares is None:
            kept.append(drawn.where("n > 1").select("lo", "n", F.explode(F.arrays_zip("q.ix", "left")).alias("e")).select("lo", "n", F.col("e.ix").alias("ix"), F.col("e.left").alias("given")))
        children = F.when(
            F.col("n") > 1,
            F.array(
                F.struct(F.col("lo").alias("lo"), half.alias("n"), part(False).alias("q")),
                F.struct((F.col("lo") + half).alias("lo"), (F.col("n") - half).alias("n"), part(True).alias("q")),
            ),
        ).otherwise(F.array(F.struct("lo", "n", "q")))
        nodes = drawn.select("g", "all", F.explode(children).alias("c")).select("g", "c.lo", "c.n", "c.q", "all")
        width = (width + 1) // 2
        if width > 1 and shards // width in (64, 65):  # enough rows to share out the rest of the tree
            nodes = nodes.repartition(64, "lo")
    shared = None
    for k in kept:
        shared = k if shared is None else shared.unionByName(k)
    return nodes.select("lo", "q"), shared


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), times: int = 3) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``source_ix`` and ``target``.

    Sources by code point, null last, take ``weights`` in turn and share the total size
    by them; none goes above ``times`` its size, and the excess is shared again by weight.
    The shares of a round depend on one number, so rounds need a sum over sources each.
    """
    n = max(1, sizes.sparkSession.sparkContext.defaultParallelism)
    placed = staged(sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    each = placed.groupBy("part").count()
    ahead = each.withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "ahead")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = placed.withColumn("r", within).join(F.broadcast(ahead), "part").withColumn("source_ix", (F.col("ahead") + F.col("r") - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_ix") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_ix", "source_size", weight.alias("weight"), (F.col("source_size") * times).cast("double").alias("most")), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, before = 0.0, None
    while rate != before:
        before = rate
        capped = F.col("most") < F.col("weight") * rate
        got = ranked.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)).alias("fixed"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        rate = max(rate, (total - got["fixed"]) / got["open"])
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * rate)).select("source", "source_ix", "source_size", "target")


def mix(
    docs: DataFrame,
    keep: tuple = ("doc_id",),
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple = (1, 2, 3),
    times: int = 3,
    block_words: int = 50_000,
    block_docs: int = 10_000,
    shard_words: int = 1_000_000,
    seed: int = 7,
) -> DataFrame:
    """Every document with its draws.

    Returns the columns ``keep`` in a struct ``row``, then ``source``, ``size`` (words),
    ``source_size``, ``target`` and ``draws``, an array of (``shard``, ``pass``,
    ``order``): the output shards that take the document and its place in their local
    order.  No document is drawn more than ``times`` times.  Null texts have no words;
    a null source is a source; documents without words may be drawn but take nothing; an
    empty table gives no rows.  Equal inputs give equal draws, in whatever order rows come;
    rows repeated in id and text are told apart by their place.  Columns that aren't named are
    not read.  Very long texts only count their words; one longer than a block is a block of its own.

    A block holds about ``block_words`` words and ``block_docs`` documents of a source at most
    and is the only group that one task sorts; a source of any share, and any number of repeated
    rows, is spread over blocks.  Running sums go by ranges (:func:`running`).
    """
    slim = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.col(source_col).alias("source"),
        F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in docs.columns else F.lit(""), F.col(text_col), F.lit(seed)).alias("h"),
    )
    slim = staged(slim.withColumn("place", F.monotonically_increasing_id()), "mix-docs")
    repeats = staged(slim.groupBy("h").count().where("count > 1").select(F.col("h").alias("again")), "mix-repeats")
    if not repeats.isEmpty():
        apart = F.when(F.col("again").isNotNull(), F.xxhash64("h", "place")).otherwise(F.col("h"))
        slim = staged(slim.join(repeats, F.col("h") == F.col("again"), "left").withColumn("h", apart).drop("again"), "mix-docs")
    sizes = staged(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, times).join(sizes.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    blocks_of = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / block_words).cast("long"), F.ceil(F.col("n_docs") / block_docs).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = staged(targets.withColumn("blocks", blocks_of).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-plan")

    known = plan.select(F.col("source").alias("s"), "source_ix", "source_size", "target", "blocks")
    placed = slim.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.col("h"), F.col("blocks")).cast("long"))
    sized = staged(placed.groupBy("source_ix", "block").agg(F.sum("size").alias("words")), "mix-blocks")

    order = lambda p: F.xxhash64(F.lit(seed), p, "source_ix", "block")
    budget = plan.select("source_ix", "passes", "rest")
    in_last = sized.join(budget, "source_ix").where("rest > 0").withColumn("o", order(F.lit("rest")))
    last = running(in_last, ["source_ix"], ["o", "block"], "words", "upto")
    last = last.withColumn("left", F.col("rest") - (F.col("upto") - F.col("words"))).where("left > 0")
    last = staged(last.select("source_ix", "block", F.col("passes").alias("pass"), F.when(F.col("words") > F.col("left"), F.col("left")).alias("room")), "mix-last")
    whole = sized.join(budget, "source_ix").where("passes > 0").select("source_ix", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("pass"))
    draws = whole.withColumn("room", F.lit(None).cast("double")).unionByName(last).withColumn("o", order(F.col("pass"))).withColumn("one", F.lit(1).cast("long"))
    draws = staged(running(draws, ["source_ix"], ["pass", "o", "block"], "one", "draw").select("source_ix", "block", "pass", "room", (F.col("draw") - 1).alias("draw")), "mix-draws")

    quotas = draws.groupBy("source_ix").agg(F.count("*").alias("quota"))
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, int(-(-total // shard_words)))
    cut = staged(split_quotas(quotas, shards, seed), "mix-tree")
    runs = running(cut, ["source_ix"], ["shard"], "taken", "upto").select("source_ix", "shard", F.explode(F.sequence(F.col("upto") - F.col("taken"), F.col("upto") - 1)).alias("draw"))
    dealt = draws.join(runs, ["source_ix", "draw"])
    by_block = staged(dealt.groupBy("source_ix", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "room"))).alias("all")), "mix-dealt")

    # the block that a rest ends in: documents in hash order that still fit, then the one that comes nearest
    ends = by_block.where(F.exists("all", lambda d: d["room"].isNotNull())).select("source_ix", "block", F.array_max(F.transform("all", lambda d: d["room"])).alias("room"))
    inside = placed.join(ends, ["source_ix", "block"]).groupBy("source_ix", "block").agg(F.max("room").alias("room"), F.sort_array(F.collect_list(F.struct("h", "size"))).alias("docs"))
    filled = staged(inside.select("source_ix", "block", _fitting(F.col("docs"), F.col("room")).alias("fit")), "mix-filled")
    unstage(repeats, sizes, sized, last, draws, cut)
    drawn = placed.join(by_block.select("source_ix", "block", "all"), ["source_ix", "block"], "left").join(filled, ["source_ix", "block"], "left")
    in_room = F.coalesce(F.array_contains("fit", F.col("h")), F.lit(False))
    mine = F.filter(F.coalesce("all", F.array().cast(by_block.schema["all"].dataType)), lambda d: d["room"].isNull() | in_room)
    out = F.transform(mine, lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"), F.xxhash64(F.lit(seed), d["shard"], d["pass"], "h").alias("order")))
    return drawn.select("row", "source", "size", "source_size", "target", out.alias("draws"))


def _fitting(docs: Column, room: Column) -> Column:
    """The ``h`` of those of ``docs`` (``h``, ``size``) that fill ``room``.

    Half of it is filled in the order of ``docs``, the rest from long to short with what still
    fits, and then by one more document if its end is nearer to the room's.
    """
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("h"))

    def upto(most):
        def step(a, d):
            fits = a["used"] + d["size"] <= most
            return F.struct((a["used"] + F.when(fits, d["size"]).otherwise(0)).alias("used"), F.when(fits, F.concat(a["h"], F.array(d["h"]))).otherwise(a["h"]).alias("h"))

        return step

    others = lambda a: F.filter(docs, lambda d: ~F.array_contains(a["h"], d["h"]))
    by_size = lambda x: F.sort_array(F.transform(x, lambda d: F.struct(d["size"].alias("size"), d["h"].alias("h"))), asc=False)

    def nearest(a):
        left = room - a["used"]
        over = F.filter(others(a), lambda d: (d["size"] > left) & (d["size"] < 2 * left))
        best = F.array_min(F.transform(over, lambda d: F.struct(d["size"].alias("size"), d["h"].alias("h"))))
        return F.when(best.isNotNull(), F.concat(a["h"], F.array(best["h"]))).otherwise(a["h"])

    half = F.aggregate(docs, empty, upto(room / 2))
    return let(half, lambda a: let(F.aggregate(by_size(others(a)), a, upto(room)), nearest))


def mixed_rows(drawn: DataFrame) -> DataFrame:
    """The mix itself: one row for each draw, with the columns kept, in shards sorted by their local order."""
    rows = drawn.select("row", F.explode("draws").alias("d"))
    return rows.repartition(F.col("d.shard"), F.pmod(F.col("d.order"), F.lit(16))).sortWithinPartitions("d.shard", "d.order").select("row.*")
