"""The registry of listings already seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.text import normalize_string
from listingflow.shared import staged

DAY_MS = 86_400_000


def is_entry() -> Column:
    return F.col("listingId").isNotNull() & F.col("company").isNotNull() & F.col("title").isNotNull() & F.col("admitTime").isNotNull()


def can_match(title: Column, company: Column) -> Column:
    """Listings with a title of 200 and a company of 100 characters at most."""
    return F.coalesce(F.length(title).between(1, 200) & F.length(company).between(1, 100), F.lit(False))


def expire(registry: DataFrame, now: int, ttl: int = 30 * DAY_MS) -> DataFrame:
    return registry.where(F.lit(now) - F.col("admitTime") < ttl)


def _keys(registry: DataFrame) -> DataFrame:
    return registry.select(normalize_string(F.col("company")).alias("_rc"), normalize_string(F.col("title")).alias("_rt"), F.col("listingId").alias("_ri"))


def known_keys(registry: DataFrame, exclude_id: str | None = None) -> DataFrame:
    """Normalised company and title of entries, each pair once: ``_rc``, ``_rt``."""
    entries = _keys(registry)
    if exclude_id is not None:
        entries = entries.where(F.col("_ri") != exclude_id)
    # written, so that a join has plain exchanges, which can be split at a hot key
    return staged(entries.select("_rc", "_rt").where("_rc is not null and _rt is not null").distinct(), "registry-keys")


def flag_seen(df: DataFrame, registry: DataFrame, name: str = "seen", exclude_id: str | None = None, title: str = "title", company: str = "company") -> DataFrame:
    """``df`` with whether the registry has its normalised company and title; entries of ``exclude_id`` don't count."""
    entries = known_keys(registry, exclude_id).withColumn("_hit", F.lit(True))
    keyed = df.withColumn("_c", F.when(can_match(F.col(title), F.col(company)), normalize_string(F.col(company)))).withColumn("_t", normalize_string(F.col(title)))
    joined = keyed.join(entries, (F.col("_c") == F.col("_rc")) & (F.col("_t") == F.col("_rt")), "left")
    return joined.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_c", "_t", "_rc", "_rt", "_hit")


def unseen(df: DataFrame, registry: DataFrame, exclude_id: str | None = None, title: str = "title", company: str = "company") -> DataFrame:
    """Rows that the registry doesn't have."""
    entries = _keys(registry)
    if exclude_id is not None:
        entries = entries.where(F.col("_ri") != exclude_id)
    c = F.when(can_match(F.col(title), F.col(company)), normalize_string(F.col(company)))
    return df.join(entries, (c == F.col("_rc")) & (normalize_string(F.col(title)) == F.col("_rt")), "left_anti")


def admit(registry: DataFrame, new: DataFrame, now: int, cap: int = 10_000, ttl: int = 30 * DAY_MS) -> DataFrame:
    """The registry with ``new`` added; above ``cap`` it is expired first and must then fit."""
    valid = new.where(can_match(F.col("title"), F.col("company")))
    n = valid.count()
    if registry.count() + n > cap:
        registry = expire(registry, now, ttl)
        if registry.count() + n > cap:
            raise ValueError(f"the registry is full: {cap} entries")
    added = valid.select("listingId", "company", "title", F.lit(now).cast("long").alias("admitTime"), F.lit(None).cast("long").alias("lastProcessed"))
    return registry.unionByName(added)


def remove(registry: DataFrame, listing_id: str) -> DataFrame:
    return registry.where(F.col("listingId") != listing_id)


def stats(registry: DataFrame, now: int, ttl: int = 30 * DAY_MS) -> DataFrame:
    """``total``, ``expired`` and milliseconds to the next expiry, 0 for an empty registry."""
    left = F.col("admitTime") + ttl - now
    return registry.agg(F.count("*").alias("total"), F.count_if(left <= 0).alias("expired"), F.coalesce(F.greatest(F.lit(0), F.min(left)), F.lit(0)).cast("long").alias("next_expiry"))
