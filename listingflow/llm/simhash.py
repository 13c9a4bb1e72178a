"""SimHash near-duplicates by tiled exact comparison, and an exact Jaccard join.

Distinct fingerprints are dealt into tiles by the population counts of their
parts.  Counts of two fingerprints can differ by no more than their distance, so
only tiles meet whose counts, summed over the parts, differ within the radius.
Within a pair of tiles every fingerprint is compared with every other by
exclusive or and bit count.

For Jaccard similarity, fingerprints only find most of the links early.  The rest
comes from prefixes: two sets that are alike share one of their first shingles in any
order of all shingles, here from rare to common.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import free_name, staged, unstage
from listingflow.llm.components import connected_components

SEED = 42
SLICE = 1 << 16
#: Shingles of a few texts whose hashes are held at once.
HELD = 1 << 18
#: Distinct fingerprints up to which they are split into so many parts; all give the same links.
PARTS = ((20_000, 1), (1_500_000, 2), (None, 4))
#: Other tiles that one may meet; beyond it, finer parts cost more copies than they spare comparisons.
MOST_STEPS = 100
#: Counters of shingles, a power of two, and the pieces in which tasks hand them on.
COUNTERS, PIECES = 1 << 20, 64
#: Bits of the filter that says which texts are asked for; a full one lets more pass and changes no result.
FILTER = 1 << 26


def fingerprint_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the groups of ``hashes`` that end before ``ends``: a bit is 1 if set in over half of a group."""
    ones = np.zeros((len(ends), 64), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    for at in range(0, len(hashes), SLICE):
        to = min(at + SLICE, len(hashes))
        bits = np.unpackbits(hashes[at:to].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, to, "left")
        own = np.arange(first, last)
        own = own[ends[own] > starts[own]]
        ones[own] += np.add.reduceat(bits, np.maximum(starts[own] - at, 0), axis=0, dtype=np.int64)
    over = (2 * ones > (ends - starts)[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles, for more bits."""
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, more: int = 0) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a long) of every row; ``w1`` and so on for ``more`` fingerprints of other hashes.

    A-Z count as a-z.  Fewer words than ``shingle`` make one shingle; a null or empty
    text, or one of white space, has the fingerprint zero.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            parts, hashes, ends = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().lower().split()
                if len(words) > shingle:
                    hashes += [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
                elif words:
                    hashes.append(digest(b" ".join(words), SEED))
                ends.append(len(hashes))
                if len(hashes) > HELD:
                    parts.append(finished(hashes, ends))
                    hashes, ends = [], []
            parts.append(finished(hashes, ends))
            found = [np.concatenate(f) for f in zip(*parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f.view("<i8")) for f in found)], names=["key", *names])

    def finished(hashes: list, ends: list) -> list[np.ndarray]:
        h, at = np.array(hashes, dtype="<u8"), np.array(ends, dtype=np.int64)
        return [fingerprint_bits(_mixed(h, k) if k else h, at) if ends else np.zeros(0, "<u8") for k in range(more + 1)]

    names = ["fp", *(f"w{k}" for k in range(1, more + 1))]
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, {', '.join(n + ' long' for n in names)}").withColumnRenamed("key", id_col)


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, in which every node points at the root of its tree, after joining the trees of all ``i`` and ``j``."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _tile_links(a: list[np.ndarray], b: list[np.ndarray] | None, radius: int, total: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``a`` (without ``b``) or between ``a`` and ``b``: its nodes and their roots."""
    nodes = a[0] if b is None else np.concatenate([a[0], b[0]])
    label = np.arange(len(nodes))
    right, shift = (a, 0) if b is None else (b, len(a[0]))
    rows = max(1, (1 << 18) // max(1, len(right[0])))
    for at in range(0, len(a[0]), rows):
        i, j = np.nonzero(np.bitwise_count(a[0][at : at + rows, None] ^ right[0][None, :]) <= radius)
        i = i + at
        if total is not None:
            near = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(a, right)) <= total
            i, j = i[near], j[near]
        j = j + shift
        label = merged(label, i[i != j], j[i != j])
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _steps(parts: int, radius: int) -> list[tuple]:
    """Half of the differences of population counts that a pair within ``radius`` can have."""
    found = [()]
    for _ in range(parts):
        found = [(*d, x) for d in found for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in found if d >= (0,) * parts]


def near_links(distinct: DataFrame, radius: int = 3, tile: int = 4096, total: int | None = None) -> DataFrame:
    """Links (``u``, ``v``) between the fingerprints ``fp`` of ``distinct``: a spanning forest of each pair of tiles.

    With ``total``, pairs must also differ in that many bits or fewer over all columns of ``distinct``.

    Every two fingerprints that differ in ``radius`` bits or fewer are connected
    through the forests.  A tile holds about ``tile`` fingerprints; the table of tile
    keys that is broadcast has at most 17 to the power 4 rows.
    """
    n = distinct.count()
    parts = next(p for most, p in PARTS if most is None or n <= most)
    while parts > 1 and len(_steps(parts, radius)) > MOST_STEPS:
        parts //= 2
    width = 64 // parts
    counts = [F.bit_count(F.col("fp").bitwiseAND(_mask(k * width, width))).cast("int").alias(f"c{k}") for k in range(parts)]
    key = F.array(*[f"c{k}" for k in range(parts)])
    words = ["fp", *(c for c in distinct.columns if c != "fp")]
    keyed = distinct.select(*words, *counts).select(*words, key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("splits"))
    dealt = keyed.join(F.broadcast(sizes), "key").withColumn("split", F.pmod(F.xxhash64("fp", F.lit("tile")), "splits").cast("int"))
    tiles = staged(dealt.groupBy("key", "split").agg(F.sort_array(F.collect_list(F.struct(*words))).alias("t")).select("key", "split", F.array(*[F.col(f"t.{w}") for w in words]).alias("fps")), "simhash-tiles")
    step = F.array(*[F.array(*map(F.lit, d)) for d in _steps(parts, radius)])
    left = tiles.select("key", F.col("split").alias("split_a"), F.col("fps").alias("a"), F.explode(step).alias("step"))
    left = left.select(F.zip_with("key", "step", lambda x, y: x + y).alias("to"), (F.aggregate("step", F.lit(0), lambda s, x: s + F.abs(x)) == 0).alias("same"), "split_a", "a")
    pairs = left.join(tiles.select(F.col("key").alias("to"), F.col("split").alias("split_b"), F.col("fps").alias("b")), "to")
    pairs = pairs.where(~F.col("same") | (F.col("split_a") <= F.col("split_b")))
    pairs = pairs.select("a", F.when(~F.col("same") | (F.col("split_a") < F.col("split_b")), F.col("b")).alias("b"))

    def run(batches):
        for batch in batches:
            u, v = [], []
            for a, b in zip(batch.column(0), batch.column(1)):
                own = [w.values.to_numpy().view(np.uint64) for w in a.values]
                other = [w.values.to_numpy().view(np.uint64) for w in b.values] if b.is_valid else None
                got = _tile_links(own, other, radius, total)
                u.append(got[0])
                v.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    links = staged(pairs.mapInArrow(run, "u long, v long"), "simhash-links", rows_per_batch=256)
    unstage(tiles)
    return links


def _mask(at: int, width: int) -> Column:
    bits = ((1 << width) - 1) << at
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def near_classes(prints: DataFrame, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """``prints`` with ``component_id``: the smallest id (of any type that has an order) that links of ``radius`` bits or fewer reach.

    Equal fingerprints are linked like any others.  Null ids reach others but are
    nobody's smallest; a component of null ids alone has a null ``component_id``.
    Repeated rows stay.
    """
    classes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    links = near_links(classes.select("fp"), radius)
    stars = connected_components(links, "simhash-stars")
    rooted = staged(classes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    roots = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    named = staged(rooted.join(roots, "root").select("fp", "component_id"), "simhash-named")
    unstage(classes, links, rooted, roots)
    return prints.join(named, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` of every document; see :func:`fingerprints` and :func:`near_classes`.

    An empty table gives no rows; very long texts are hashed whole; other columns are not read, whatever their names.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    return near_classes(prints, id_col, radius).select(id_col, "fp", "component_id")


def _key(*columns: Column) -> Column:
    """128 bits of hash of some columns, nulls told apart from empty strings."""
    marks = [F.struct(*columns)]
    return F.concat(F.hex(F.xxhash64(*marks, F.lit(1))), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *marks)))


def _shingle_sets(keyed: DataFrame, key: str, text: Column, asked: DataFrame, shingle: int) -> DataFrame:
    """``asked`` (``k``, ``digest``, ``fp``, ``part``) with the sorted distinct shingle hashes (``shingles``) of the rows' texts, one row for each.

    Texts are not shuffled: a filter of ``FILTER`` bits says which may be asked for, and what is shuffled are their hashes.
    """
    at = F.pmod(F.xxhash64("k", F.lit("asked")), F.lit(FILTER))
    bits = asked.select((at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER / 64 at most
    words = np.zeros(FILTER // 64, np.uint64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    wanted = keyed.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        from xxhash import xxh64_intdigest as digest

        held = wanted.value
        for batch in batches:
            places = batch.column(1).to_numpy()
            hits = np.nonzero((held[places // 64] >> (places % 64).astype(np.uint64)) & np.uint64(1))[0]
            sets = []
            for i in hits.tolist():
                words = (batch.column(2)[i].as_py() or "").encode().lower().split()
                runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
                sets.append(np.unique(np.fromiter((digest(s, SEED) for s in runs), dtype="<u8")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hits)), pa.array(sets, pa.binary())], names=["k", "shingles"])

    rows = keyed.select(F.col(key).alias("k"), text.alias("text")).select("k", at.alias("at"), "text")
    return asked.join(rows.mapInArrow(run, "k string, shingles binary"), "k").dropDuplicates(["k", "digest"])


def verified_forest(fps: np.ndarray, sets: list[np.ndarray], first: int, radius: int, similarity: float) -> np.ndarray:
    """Labels that join what links within ``radius`` and ``similarity`` connect: within all, or between the first ``first`` and the others.

    Pairs go by distance; those that are connected already need no look at their sets.
    """
    label = np.arange(len(fps))
    right = fps[first:] if first < len(fps) else fps
    distance = np.bitwise_count(fps[:first, None] ^ right[None, :])
    i, j = np.nonzero(distance <= radius)
    order = np.argsort(distance[i, j], kind="stable")
    i, j = i[order], j[order] + (first if first < len(fps) else 0)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        apart = label[a] != label[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            if label[x] == label[y]:
                continue
            m, n = len(sets[x]), len(sets[y])
            if min(m, n) < similarity * max(m, n):
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= similarity * (m + n - both):
                label = merged(label, np.array([x]), np.array([y]))
    return label


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 18, total: int = 59, similarity: float = 0.8, block: int = 512, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id.

    Two texts are linked whose sets of ``shingle``-word shingles have a Jaccard similarity
    of ``similarity`` or more, checked exactly; a group is what links connect.  Texts of equal words are one text.
    Null and empty texts are copies of each other; null ids come after all others, and ids may have any type
    that has an order; of rows repeated in id and text one stays.  Other columns are carried along, whatever
    their names; an empty table stays empty; very long texts are compared whole.

    Most links are found among texts whose fingerprints of distinct shingles differ in
    ``radius`` of 64 and ``total`` of 256 bits or fewer (at 0.8 they differ in 9.7 and 38.8
    on average, with deviations of 2.9 and 5.7).  :func:`_prefix_links` then checks
    every other pair that can be alike, so the two bounds change the cost and not the result.

    Candidate groups come from the tiles.  A group is cut into blocks of about ``block``
    texts and ``block_bytes`` of shingles, and pairs of blocks are checked apart, so no
    task holds a whole group.
    """
    text = F.col(text_col).cast("string")
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, _key(F.col(id_col), text))
    slim = keyed.select(F.struct(F.col(key).alias("k"), F.col(id_col).alias("id")).alias("row"), text.alias("t"))
    prints = staged(_prints_and_digests(slim, shingle), "dedup-prints")
    texts = staged(prints.groupBy("digest", "fp", "w1", "w2", "w3").agg(F.min(F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), F.col("row.k").alias("k"))).alias("least"), F.count("*").alias("n")), "dedup-texts")
    near_fps = near_links(texts.select("fp", "w1", "w2", "w3").distinct(), radius, total=total)
    stars = connected_components(near_fps, "dedup-candidates")
    near = stars.union(stars.select("root", "root").distinct())
    shared = texts.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fp").alias("node"), F.col("fp").alias("root")).join(near, "node", "left_anti")
    groups = staged(near.union(shared).distinct(), "dedup-groups")
    asked = texts.join(groups, F.col("fp") == F.col("node")).select(F.col("least.k").alias("k"), "digest", "fp", F.col("root").alias("part"))
    asked = staged(asked, "dedup-asked")
    sets = staged(_shingle_sets(keyed, key, text, asked, shingle), "dedup-sets")
    splits = staged(sets.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("shingles")) / block_bytes)).cast("int").alias("splits")), "dedup-splits")
    blocks = sets.join(splits, "part").withColumn("split", F.pmod(F.xxhash64("digest"), F.col("splits")).cast("int")).repartition("part", "split")
    blocks = staged(blocks.groupBy("part", "split").agg(F.max("splits").alias("splits"), F.collect_list(F.struct("digest", "fp", "shingles")).alias("rows")), "dedup-blocks")
    a = blocks.select("part", F.col("split").alias("sa"), F.col("rows").alias("a"), F.explode(F.sequence(F.col("split"), F.col("splits") - 1)).alias("sb"))
    pairs = a.join(blocks.select("part", F.col("split").alias("sb"), F.col("rows").alias("b")), ["part", "sb"])
    pairs = pairs.select("a", F.when(F.col("sa") != F.col("sb"), F.col("b")).alias("b"))

    def run(batches):
        for batch in batches:
            u, v = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                rows = [*x.values.to_pylist(), *(y.values.to_pylist() if y.is_valid else [])]
                fps = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
                found = verified_forest(fps, [np.frombuffer(r["shingles"], "<u8") for r in rows], len(x.values), radius, similarity)
                for k in np.nonzero(found != np.arange(len(rows)))[0]:
                    u.append(rows[k]["digest"])
                    v.append(rows[found[k]]["digest"])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], names=["u", "v"])

    links = staged(pairs.mapInArrow(run, "u string, v string"), "dedup-links", rows_per_batch=1)
    unstage(near_fps, groups, asked, sets, splits, blocks)
    stars = connected_components(links, "dedup-stars")
    more = _prefix_links(keyed, key, text, texts, stars, shingle, similarity)
    if not more.isEmpty():
        stars = connected_components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "dedup-stars")
    rooted = staged(texts.join(stars, F.col("digest") == F.col("node"), "left").select(F.coalesce("root", "digest").alias("root"), "least"), "dedup-rooted")
    kept = staged(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k").alias(key)), "dedup-kept")
    left = keyed.join(kept, key, "left_semi")
    again = prints.groupBy(F.col("row.k").alias(key)).count().where("count > 1").join(kept, key, "left_semi").select(key)
    again = staged(again, "dedup-again")
    unstage(prints, texts, links, more, rooted)
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*docs.columns)


def _prints_and_digests(slim: DataFrame, shingle: int) -> DataFrame:
    """``row``, four fingerprints of the distinct shingles and the 128-bit ``digest`` of the lower-cased words of ``t``."""

    def run(batches):
        from xxhash import xxh3_128_hexdigest, xxh64_intdigest

        for batch in batches:
            digests, parts, hashes, ends = [], [], [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().lower().split()
                digests.append(xxh3_128_hexdigest(b" ".join(words)))
                runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)] if words else []
                hashes += {xxh64_intdigest(s, SEED) for s in runs}
                ends.append(len(hashes))
                if len(hashes) > HELD:
                    parts.append(finished(hashes, ends))
                    hashes, ends = [], []
            parts.append(finished(hashes, ends))
            found = [pa.array(np.concatenate(f).view("<i8")) for f in zip(*parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), *found], names=["row", "digest", "fp", "w1", "w2", "w3"])

    def finished(hashes: list, ends: list) -> list[np.ndarray]:
        h, at = np.array(hashes, dtype="<u8"), np.array(ends, dtype=np.int64)
        return [fingerprint_bits(_mixed(h, k) if k else h, at) if ends else np.zeros(0, "<u8") for k in range(4)]

    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(run, f"row {kind}, digest string, fp long, w1 long, w2 long, w3 long")


def _word_hashes(text: str | None, shingle: int) -> tuple[str, np.ndarray]:
    """The digest of the words and the distinct hashes of ``shingle`` words, made of hashes of words; none of shorter texts, which only their copies are like."""
    from xxhash import xxh3_128_hexdigest, xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    own = np.array([xxh64_intdigest(w, SEED) for w in words] if n > 0 else [], dtype="<u8")
    found = np.zeros(max(0, n), "<u8")
    for k in range(shingle if n > 0 else 0):
        found = _mixed(found ^ own[k : k + n], k + 1)
    return xxh3_128_hexdigest(b" ".join(words)), np.unique(found)


def _prefix_links(keyed: DataFrame, key: str, text: Column, texts: DataFrame, stars: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (``u``, ``v``) between digests of all pairs of texts of ``similarity`` or more that ``stars`` leaves apart.

    Of n shingles, at most n less ``similarity`` times n can be missing in a set that is
    alike, so one more than that, the rarest by shared counters, must meet.  The
    counters only order shingles: shared ones change the cost and not the result.
    Of two prefixes, all common shingles up to the end of the one that ends first lie in both;
    with those, and all that can come after it, a pair must reach ``similarity`` to be checked.
    """

    def count(batches):
        seen = np.zeros(COUNTERS, np.int64)
        held, n = [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(_word_hashes(t.as_py(), shingle)[1] % COUNTERS)
                n += len(held[-1])
                if n > HELD:
                    seen += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
                    held, n = [], 0
        if held:
            seen += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.split(seen, PIECES)], pa.binary())], names=["piece", "seen"])

    def summed(group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_py(), np.int64) for x in group["seen"])
        return pa.table({"piece": group["piece"][:1].cast(pa.int32()), "seen": pa.array([whole.tobytes()], pa.binary())})

    slim = keyed.select(text.alias("text"))
    pieces = slim.mapInArrow(count, "piece int, seen binary").groupBy("piece").applyInArrow(summed, "piece int, seen binary").collect()  # COUNTERS numbers
    seen = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["seen"], np.int64) for r in sorted(pieces, key=lambda r: r["piece"]))])
    often = keyed.sparkSession.sparkContext.broadcast(seen)

    def prefixes(batches):
        seen, done = often.value, set()
        for batch in batches:
            hs, ts, places, about = [], [], [], []
            for t in batch.column(0):
                digest, found = _word_hashes(t.as_py(), shingle)
                n = len(found)
                if digest in done or not n:
                    continue
                if len(done) < HELD:
                    done.add(digest)
                first = n - math.ceil(similarity * n - 1e-9) + 1
                order = np.lexsort((found, seen[(found % COUNTERS).astype(np.int64)]))[:first]
                hs.append(found[order])
                ts.append(np.full(first, int(digest[:16], 16), "<u8"))
                places.append(np.arange(first, dtype=np.int32))
                last = int(found[order[-1]])
                about += [{"n": n, "often": int(seen[last % COUNTERS]), "last": last - (1 << 63)}, *[None] * (first - 1)]
            if hs:
                kind = pa.struct([("n", pa.int32()), ("often", pa.int64()), ("last", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view("<i8")), pa.array(np.concatenate(ts).view("<i8")), pa.array(np.concatenate(places)), pa.array(about, kind)], names=["h", "t", "at", "about"])

    def checked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    rows = slim.mapInArrow(prefixes, "h long, t long, at int, about struct<n:int,often:long,last:long>")  # about: in the first row of a text
    rows = staged(rows, "dedup-prefixes")
    met = staged(rows.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("h"), "dedup-met")
    shared = staged(rows.select("h", "t", "at").join(met, "h", "left_semi").distinct(), "dedup-shared")
    about = staged(rows.where("about is not null").select(F.col("t").alias("text_t"), "about.*").distinct(), "dedup-about")
    unstage(rows, met)
    # equal first halves of digests only bring more pairs to check
    t = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long")
    rooted = staged(texts.join(stars, F.col("digest") == F.col("node"), "left").select(t.alias("t"), "digest", F.col("least.k").alias("k"), F.coalesce("root", "digest").alias("root")), "dedup-linked")
    members = staged(shared.join(rooted.select("t", "root").join(about, F.col("t") == F.col("text_t")).drop("text_t"), "t"), "dedup-members")
    apart = staged(members.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h"), "dedup-apart")
    members, old = staged(members.join(apart, "h", "left_semi"), "dedup-members"), members
    unstage(shared, about, old, apart)
    a, b = (members.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("t", "root", "n", "at")]) for x in "ab")
    least = lambda: F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    # what is left from the first shingle that both have on; the other rows of a pair are of no use
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least()
    # sizes and places decide that, so they meet first: of a shingle that many texts have late in their prefixes no pairs are made
    kinds = staged(members.select("h", "n", "at").distinct(), "dedup-kinds")
    x, y = (kinds.select("h", *[F.col(c).alias(f"{c}_{i}") for c in ("n", "at")]) for i in "ab")
    kinds_met = staged(x.join(y, "h").where((F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & enough), "dedup-kinds-met")
    pairs = a.join(kinds_met, ["h", "n_a", "at_a"]).join(b, ["h", "n_b", "at_b"]).where((F.col("t_a") < F.col("t_b")) & (F.col("root_a") != F.col("root_b")))
    met = staged(pairs.select("t_a", "t_b").distinct(), "dedup-near")
    unstage(kinds, kinds_met)
    some = met.select(F.col("t_a").alias("t")).union(met.select("t_b")).distinct()
    lists = staged(members.join(staged(some, "dedup-some"), "t", "left_semi").groupBy("t", "n", "often", "last").agg(F.collect_set("h").alias("hs")), "dedup-lists")
    a, b = (lists.select(*[F.col(c).alias(f"{c}_{x}") for c in lists.columns]) for x in "ab")
    first_ends = (F.col("often_a") < F.col("often_b")) | ((F.col("often_a") == F.col("often_b")) & (F.col("last_a") <= F.col("last_b")))
    after = F.floor(F.lit(similarity) * F.when(first_ends, F.col("n_a")).otherwise(F.col("n_b")) + 1e-6)
    shared = F.size(F.array_intersect("hs_a", "hs_b"))
    pairs = staged(met.join(a, "t_a").join(b, "t_b").where(shared + after >= least()).select("t_a", "t_b").distinct(), "dedup-pairs")
    unstage(met, lists)
    asked = pairs.select(F.col("t_a").alias("t")).union(pairs.select("t_b")).distinct().join(rooted, "t").select("k", "digest", F.col("t").alias("part"), F.lit(0).cast("long").alias("fp"))
    asked = staged(asked, "dedup-wanted")
    sets = staged(_shingle_sets(keyed, key, text, asked, shingle), "dedup-rest")
    x, y = (sets.select(F.col("part").alias(f"t_{i}"), F.col("digest").alias(u), F.col("shingles").alias(i)) for i, u in (("a", "u"), ("b", "v")))
    links = staged(pairs.join(x, "t_a").join(y, "t_b").select("u", "v", "a", "b").mapInArrow(checked, "u string, v string"), "dedup-more", rows_per_batch=1000)
    unstage(rooted, members, pairs, asked, sets)
    return links
