"""Small checks of single values, and their twins that end the job at the first value that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An instant in ISO form, an address, and parts of keys that are not real.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"
ADDRESS = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
UNREAL = ("sk-test", "test_", "demo", "example")
KEY_LENGTHS = (10, 100)


def is_iso_instant(c: Column) -> Column:
    return F.coalesce(c.rlike(ISO_INSTANT), F.lit(False))


def is_address(c: Column) -> Column:
    return F.coalesce(c.rlike(ADDRESS), F.lit(False))


def is_absolute_url(c: Column) -> Column:
    """Whether the text has a scheme and something after it."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"), F.lit(False))


def sanitized(c: Column, most: int = 1000) -> Column:
    """The text without angle brackets and control characters, cut at ``most``."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[<>]", ""), r"[\x00-\x1F\x7F]", ""), 1, most)


def made_id(prefix: str, ms: Column, seed: Column, suffix: str | None = None) -> Column:
    """An id of prefix, suffix, time in base 36 and six characters that depend on ``seed``, so that reruns agree."""
    tail = F.substring(F.lower(F.conv(F.sha2(seed.cast("string"), 256).substr(1, 12), 16, 36)), 1, 6)
    return F.concat_ws("_", F.lit(prefix), F.lit(suffix), F.lower(F.conv(ms.cast("string"), 10, 36)), tail)


def key_problem(c: Column) -> Column:
    """What is wrong with a key, or null."""
    low, high = KEY_LENGTHS
    unreal = F.lit(False)
    for part in UNREAL:
        unreal = unreal | F.lower(c).contains(part)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "key is required").when(~F.length(c).between(low, high), "key length is out of range").when(unreal, "key seems to be a test key")


def inner_path(c: Column) -> Column:
    """A path below the root: without steps up, doubled slashes and slashes at its ends."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\.\./", ""), "/+", "/")
    return F.regexp_replace(plain, "^/+|/+$", "")


def insisted(c: Column, problem: Column) -> Column:
    """``c`` where ``problem`` is null; the first other value ends the job with it."""
    return F.when(problem.isNull(), c).otherwise(F.raise_error(problem))
