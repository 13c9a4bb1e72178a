"""Similarity of listings, and the join of all that are alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.shared import staged, unstage


def string_similarity(a: Column, b: Column) -> Column:
    """One less edit distance over the longer length; 0 if either is empty or missing."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), (longer - F.levenshtein(a, b)) / longer).otherwise(0.0)


def listing_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0.4 of the title's, 0.3 of the company's, 0.2 of the location's similarity, 0.1 for equal URLs; two places."""
    total = 0.4 * string_similarity(a["title"], b["title"]) + 0.3 * string_similarity(a["company"], b["company"]) + 0.2 * string_similarity(a["location"], b["location"])
    total = total + F.when(a["url"] == b["url"], 0.1).otherwise(0.0)
    return F.floor(total * 100 + 0.5) / 100


#: Weights of title, company and location, of equal URLs, and what rounding can add.
WEIGHTS, SAME_URL, ROUNDING = {"title": 0.4, "company": 0.3, "location": 0.2}, 0.1, 0.005


def _near(values: DataFrame, least: float) -> DataFrame:
    """All pairs (``a``, ``b``) of different ``value`` with a string similarity of ``least`` or more, both ways, and that similarity (``sim``).

    The shorter string of a pair is cut into segments.  Strings of a similarity have so many edits at most, and each spoils one
    segment: of one more of them one stands unspoiled in the longer string, at a bounded shift.  The rarest are
    taken.  Where segments would be single characters, the number of those that must match bounds the spoiled ones.
    So no pair is lost at any ``least`` above 0; keys and work of a value depend on its own length alone.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0, and 1 at most, is needed")
    own = staged(values.select("value").where("length(value) > 0").distinct().withColumn("n", F.length("value")), "similar-values")
    edits = lambda m: F.floor((1 - least) * m + 1e-9).cast("int")
    spoiled = lambda n: edits(F.floor(n / least + 1e-9))  # of the longest partner
    width = lambda n: F.greatest(F.lit(1), F.floor(n / (spoiled(n) + 1))).cast("int")
    # lengths of partners fall into one or two bands
    band = (lambda n: F.floor(F.log(n.cast("double")) / math.log(1 / least)).cast("int")) if least < 1 else (lambda n: n.cast("int"))
    matched = lambda n: F.ceil(least * n - 1e-9).cast("int")
    q, n, v = F.col("q"), F.col("n"), F.col("value")
    cut = F.transform(F.sequence(F.lit(0), F.floor(n / q).cast("int") - 1), lambda i: F.struct((i * q).alias("at"), F.substring(v, i * q + 1, q).alias("gram")))
    segments = own.withColumn("q", width(n)).select("value", "n", "q", band(n).alias("band"), F.when(q > 1, spoiled(n) + 1).otherwise(n - matched(n) + 1).alias("need"), F.explode(cut).alias("s"))
    segments = staged(segments.select("value", "n", "q", "band", "need", "s.at", "s.gram"), "similar-segments")
    often = staged(segments.groupBy("q", "gram").agg(F.count("*").alias("often")), "similar-counts")
    # a value's segments are as many as its length allows
    listed = segments.join(often, ["q", "gram"]).groupBy("value", "n", "q", "band", "need").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "at"))).alias("s"))
    keys = listed.select(v.alias("a"), n.alias("n_a"), "q", "band", F.explode(F.slice("s", F.lit(1), F.col("need"))).alias("s"))
    keys = staged(keys.select("a", "n_a", "q", "band", "s.gram", F.col("s.at").alias("at_a")), "similar-keys")
    lengths = F.sequence(F.greatest(F.lit(1), matched(n)), n)
    kinds = F.array_distinct(F.transform(lengths, lambda m: F.struct(width(m).alias("q"), band(m).alias("band"))))
    grams = F.flatten(F.transform(kinds, lambda k: F.transform(F.sequence(F.lit(0), n - k["q"]), lambda i: F.struct(k["q"].alias("q"), k["band"].alias("band"), F.substring(v, i + 1, k["q"]).alias("gram"), i.alias("at")))))
    probes = staged(own.select(v.alias("b"), n.alias("n_b"), F.explode(grams).alias("s")).select("b", "n_b", "s.q", "s.band", "s.gram", F.col("s.at").alias("at_b")), "similar-probes")
    shift, longer = F.col("at_b") - F.col("at_a"), F.col("n_b") - F.col("n_a")
    fits = (longer >= 0) & (F.col("n_a") >= matched(F.col("n_b"))) & (F.abs(shift) + F.abs(longer - shift) <= edits(F.col("n_b"))) & ((longer > 0) | (F.col("a") < F.col("b")))
    met = keys.join(probes, ["q", "band", "gram"]).where(fits).select("a", "b").distinct()
    near = staged(met.withColumn("sim", string_similarity(F.col("a"), F.col("b"))).where(F.col("sim") >= least - 1e-9), "similar-pairs")
    unstage(segments, often, keys, probes)
    return near.union(near.select("b", "a", "sim")).union(own.select("value", "value", F.lit(1.0)))


def similar_values(values: DataFrame, least: float) -> DataFrame:
    """All pairs (``a``, ``b``) of ``value`` with a string similarity of ``least`` or more, both ways and each with itself; empty and null values are alike to none."""
    return _near(values, least).select("a", "b")


def members(df: DataFrame, key: str, fields: tuple = ("title", "company", "location", "url")) -> DataFrame:
    """The ``key`` of each row and that of its representative (``member_of``), the smallest of those with equal ``fields``."""
    first = staged(df.groupBy(*[F.col(f).alias(f"_{f}") for f in fields]).agg(F.min(key).alias("member_of")), "similar-firsts")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return df.join(first, same).select(key, "member_of")


def _conditions(least: float) -> list[dict[str, float]]:
    """Sets of least similarities by field, one of which every pair of a score of ``least`` meets in full.

    With all else alike, title and company must each reach a similarity of their own.  Where these are too low to tell
    much, one field reaches the mean that the score asks of all three, and one other the mean that the
    first, even if equal, leaves to the rest.
    """
    score = least - ROUNDING - 1e-9
    each = {f: (score - (1 - w)) / w for f, w in WEIGHTS.items()}
    if min(each["title"], each["company"]) >= 0.4:
        return [{f: each[f] for f in ("title", "company")}]
    total = sum(WEIGHTS.values())
    found = []
    for f, w in WEIGHTS.items():
        mean, rest = (score - SAME_URL) / total, (score - SAME_URL - w) / (total - w)
        for g in WEIGHTS:
            if g != f and rest > 0:
                found.append({f: mean, g: rest})
        if rest <= 0:
            found.append({f: mean})
    return found


def similar_pairs(df: DataFrame, key: str, fields: tuple = ("title", "company", "location", "url"), least: float = 0.9) -> DataFrame:
    """All pairs of different listings whose similarity is ``least`` or more, between representatives of equal ones (:func:`members`).

    The pairs of different titles, companies and locations that are alike enough are found first (:func:`_conditions`), and
    listings meet by two of them, so that a hot title meets itself only within like companies.  A similarity of a tenth or less,
    which equal URLs alone give, is refused.
    """
    if least - ROUNDING <= SAME_URL:
        raise ValueError("equal URLs alone reach this similarity")
    reps = staged(df.groupBy(*fields).agg(F.min(key).alias("_key")), "similar-reps")
    b = reps.select(*[F.col(c).alias(f"{c}_b") for c in reps.columns])
    score = listing_similarity({f: F.col(f) for f in fields}, {f: F.col(f"{f}_b") for f in fields})
    conditions = _conditions(least)
    near = {}
    for f in {f for c in conditions for f in c}:
        pairs = _near(reps.select(F.col(f).alias("value")), min(c[f] for c in conditions if f in c))
        near[f] = staged(pairs.select(F.col("a").alias(f), F.col("b").alias(f"{f}_b"), "sim"), "similar-fields") if len(conditions) > 1 else pairs.select(F.col("a").alias(f), F.col("b").alias(f"{f}_b"), "sim")
    out = None
    for c in conditions:
        a = reps
        for f, enough in c.items():
            a = a.join(near[f].where(F.col("sim") >= enough).drop("sim"), f)
        met = a.join(b, [f"{f}_b" for f in c]).where(F.col("_key") < F.col("_key_b"))
        met = met.select(F.col("_key").alias("left_key"), F.col("_key_b").alias("right_key"), score.alias("similarity")).where(F.col("similarity") >= least)
        out = met if out is None else out.union(met)
    return out.distinct() if len(conditions) > 1 else out
