"""Verdicts by title, routes of judged listings, and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.functions.text import normalize_string
from listingflow.operators.registry import can_match, known_keys
from listingflow.shared import staged, unstage

#: Words that speak for a listing.
KEYWORDS = ("engineer", "developer", "software", "security", "analyst", "specialist")


def keyword_verdict(title: Column, description: Column) -> Column:
    """A verdict without a model: two keywords in title or description pass."""
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    n = sum((t.contains(k) | d.contains(k)).cast("int") for k in KEYWORDS)
    return F.struct((n >= 2).alias("isVeryHighlyAligned"), F.least(F.floor(n * 30 + 0.5) / 100, F.lit(1.0)).alias("confidence"), n.alias("matches"))


def distinct_titles(df: DataFrame, order: Column, title: str = "title") -> DataFrame:
    """Each title once, with its first place."""
    return df.where(F.col(title).isNotNull()).groupBy(title).agg(F.min(order).alias("first"))


def last_verdicts(verdicts: DataFrame, key: str, order: Column) -> DataFrame:
    """The last verdict of each key, aggregated before the shuffle."""
    whole = F.struct(*[F.col(c) for c in verdicts.columns])
    return verdicts.groupBy(key).agg(F.max_by(whole, order).alias("_v")).select("_v.*")


def join_verdicts(df: DataFrame, verdicts: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows whose last verdict is favourable, with its confidence."""
    # written, so that the join has plain exchanges, which can be split at a hot key
    last = staged(last_verdicts(verdicts, key, order).where("isVeryHighlyAligned").select(key, "confidence"), "last-verdicts")
    return df.drop("confidence").join(last, key)


def attempts_outcome(attempts: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """The outcome of the last attempt of each key, successful or not; without a success a fail-safe verdict, or null if ``strict``."""
    last = attempts.groupBy(key).agg(F.max_by(F.struct("ok", "isVeryHighlyAligned", "confidence", "error"), F.col("attempt")).alias("v"), F.count("*").alias("attempts"))
    fail = lambda c, x: F.when(F.col("v.ok"), F.col(f"v.{c}")).otherwise(F.lit(None if strict else x))
    return last.select(key, "attempts", F.col("v.ok").alias("ok"), fail("isVeryHighlyAligned", False).alias("isVeryHighlyAligned"), fail("confidence", 0.0).alias("confidence"), F.when(~F.col("v.ok"), F.col("v.error")).alias("parsingError"), (~F.col("v.ok")).alias("fallbackUsed"))


def with_singles(batched: DataFrame, singles: DataFrame, key: str) -> DataFrame:
    """Verdicts of batches, and for titles that their batch left out those of single calls."""
    return batched.unionByName(singles.join(batched.select(key).distinct(), key, "left_anti"))


def evaluated(df: DataFrame, verdict: Column, timestamp: str, mode: int = 1, retries: Column | None = None, most: int = 3, error: Column | None = None) -> DataFrame:
    """``df`` with ``evaluationResult``."""
    n = F.lit(0) if retries is None else retries
    e = F.lit(None).cast("string") if error is None else error
    return df.withColumn(
        "evaluationResult",
        F.struct(
            F.lit(mode).alias("mode"), verdict["isVeryHighlyAligned"].alias("isPass"), F.lit(timestamp).alias("timestamp"), e.alias("parsingError"), e.isNotNull().alias("fallbackUsed"),
            verdict.alias("analysisResult"), n.alias("retryCount"), F.lit(most).alias("maxRetries"), ((n > 0) & e.isNull()).alias("retrySuccess"),
        ),
    )


def before_judging(df: DataFrame, registry: DataFrame, order: Column, description: str = "descriptionText") -> DataFrame:
    """``df`` with ``route``: dupe, no_description, or null for what is to be judged.

    A listing is a dupe if the registry has it, or if an earlier one of this run, which
    is then in the registry, has its normalised company and title.
    """
    keyed = df.withColumn("_c", normalize_string(F.col("company"))).withColumn("_t", normalize_string(F.col("title"))).withColumn("_can", can_match(F.col("title"), F.col("company"))).withColumn("_o", order)
    marks = _firsts(keyed.select("_c", "_t", "_can", "_o"), known_keys(registry))
    route = F.when((F.col("_can") & F.col("_known")) | (F.col("_o") != F.col("_first")), "dupe").when(F.coalesce(F.length(F.col(description)), F.lit(0)) == 0, "no_description")
    return keyed.join(marks, _same_key(), "left").withColumn("route", route).drop("_c", "_t", "_can", "_o", "_kc", "_kt", "_known", "_first")


def _same_key() -> Column:
    return F.col("_c").eqNullSafe(F.col("_kc")) & F.col("_t").eqNullSafe(F.col("_kt"))


def _firsts(keyed: DataFrame, entries: DataFrame) -> DataFrame:
    """Each key (``_kc``, ``_kt``) once: whether ``entries`` have it (``_known``), and the first ``_o`` of its rows that they don't stand for (``_first``).

    The least of a struct has no place in a hash table and would sort all rows.  So the least first field is found by hashing, and
    structs are compared only among the rows that have it.
    """
    kind = keyed.schema["_o"].dataType
    lead = F.col("_o")[kind.names[0]] if isinstance(kind, T.StructType) else F.col("_o")
    least = lambda which: (F.min(F.when(which, lead)), F.bool_or(which & F.col("_o").isNotNull() & lead.isNull()))
    (a, a_null), (b, b_null) = least(F.lit(True)), least(~F.col("_can"))  # a field that is null comes before all others
    by_key = keyed.groupBy(F.col("_c").alias("_kc"), F.col("_t").alias("_kt")).agg(a.alias("_a"), a_null.alias("_an"), b.alias("_b"), b_null.alias("_bn"))
    met = by_key.join(entries.withColumn("_hit", F.lit(True)), (F.col("_kc") == F.col("_rc")) & (F.col("_kt") == F.col("_rt")), "left").withColumn("_known", F.coalesce("_hit", F.lit(False)))
    met = met.select("_kc", "_kt", "_known", F.when(F.col("_known"), F.when(~F.col("_bn"), F.col("_b"))).otherwise(F.when(~F.col("_an"), F.col("_a"))).alias("_first"))
    # written, so that the join has plain exchanges, which can be split at a hot key
    leads = staged(met, "judge-leads")
    if not isinstance(kind, T.StructType):
        return leads
    near = keyed.join(leads.withColumnRenamed("_first", "_lead"), _same_key() & lead.eqNullSafe(F.col("_lead"))).where(~(F.col("_can") & F.col("_known")))
    first = near.groupBy(F.col("_c"), F.col("_t")).agg(F.min("_o").alias("_first"))
    marks = staged(leads.drop("_first").join(first, _same_key(), "left").drop("_c", "_t"), "judge-firsts")
    unstage(leads)
    return marks


def routes(df: DataFrame, registry: DataFrame, order: Column, verdict: Column, description: str = "descriptionText") -> DataFrame:
    """``df``, whose rows all have a verdict, with ``route``: dupe, no_description, pass or fail; see :func:`before_judging`."""
    route = F.coalesce("route", F.when(verdict["isVeryHighlyAligned"], "pass").otherwise("fail"))
    return before_judging(df, registry, order, description).withColumn("route", route)


def judge_totals(routed: DataFrame) -> DataFrame:
    """Counts by route of one run and the rounded share that passed of those judged; with ``evaluationResult``, also parse failures and fallbacks."""
    n = lambda r: F.count_if(F.col("route") == r)
    judged = n("pass") + n("fail")
    rate = F.when(judged > 0, F.floor(n("pass") * 100.0 / judged + 0.5)).otherwise(0).cast("long")
    more = []
    if "evaluationResult" in routed.columns:
        more = [F.count_if(F.col("evaluationResult.parsingError").isNotNull()).alias("parse_failures"), F.count_if("evaluationResult.fallbackUsed").alias("fallbacks")]
    return routed.agg(F.count("*").alias("total"), n("pass").alias("passed"), n("fail").alias("failed"), n("dupe").alias("dupes"), n("no_description").alias("no_description"), rate.alias("success_percent"), *more)


def take_while_pages(pages: DataFrame, keys: list[str], number: str, stop: Column, most: int = 1000) -> DataFrame:
    """Pages of each search up to the first at which ``stop`` holds, that one included."""
    stops = staged(pages.where(stop).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(number).alias("_at")), "page-stops")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = pages.join(stops, same, "left").where((F.col("_at").isNull() | (F.col(number) <= F.col("_at"))) & (F.col(number) < most))
    return met.select(*pages.columns)


def search_grid(terms: DataFrame, locations: DataFrame, pages: int) -> DataFrame:
    """Every term in every location with page numbers from 0; both are lists of arguments, and only their grid is made here."""
    return terms.join(locations, how="cross").withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
