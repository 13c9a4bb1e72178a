"""Ids of listings from their URLs, and repair of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingflow.functions.text import first_filled

#: The places of an id in a listing's URL, in order of precedence.
VIEW_PATTERNS = (r"/jobs/view/[^/]+-(\d+)", r"/jobs/view/\?[^=]*=(\d+)", r"/jobs/view/(\d+)", r"/jobs/c/view/(\d+)")
SLUG_PATTERN = r"/jobs/view/[^/]+/(\d+)"


def _first(url: Column, *patterns: str) -> list[Column]:
    return [F.regexp_extract(url, p, 1) for p in patterns]


def id_from_url(url: Column) -> Column:
    """The id at a known place, else the first digits, else null."""
    return first_filled(*_first(url, *VIEW_PATTERNS, r"(\d+)"))


def id_or_hash(url: Column, file: Column | None = None) -> Column:
    """The id after a slug, else that of the file's name, else eight digits of the URL's MD5."""
    found = _first(url, SLUG_PATTERN)
    if file is not None:
        found += _first(file, r"^job_(\d+)\.json$", r"^processed_jobs_(\d+)\.json$")
    return F.coalesce(first_filled(*found), F.substring(F.md5(url), 1, 8))


def record_id(id_: Column, url: Column, title: Column) -> Column:
    """A record's own id, else one of its URL, else a hash of URL or title."""
    from_url = F.coalesce(first_filled(*_first(url, r"-(\d+)\?", SLUG_PATTERN)), F.substring(F.md5(url), 1, 8))
    by_title = F.substring(F.md5(F.coalesce(F.nullif(title, F.lit("")), F.lit("unknown"))), 1, 8)
    return F.coalesce(F.nullif(id_, F.lit("")), F.when(F.length(url) > 0, from_url), by_title)


def registry_id(id_: Column, url: Column, title: Column, host: str) -> Column:
    """A sanitised id of 20 characters at most; null for a URL of another host, where the origin fails."""
    clean = lambda c: F.substring(F.regexp_replace(c, "[^A-Za-z0-9-]", ""), 1, 20)
    found = first_filled(*_first(url, r"-(\d+)\?$", r"/view/[^/]+/(\d+)"))
    hashed = F.substring(F.sha2(F.concat_ws(":", F.coalesce(title, F.lit("unknown")), F.coalesce(url, F.lit(""))), 256), 1, 12)
    own = F.lower(F.regexp_extract(url, "^https?://([^/]+)", 1))
    foreign = (F.length(url) > 0) & ~((own == host) | own.endswith("." + host))
    return F.when(F.length(id_) > 0, clean(id_)).when(foreign, None).otherwise(F.coalesce(clean(found), hashed))


def repair_url(url: Column, host: str) -> Column:
    """A URL behind one or two stray copies of its site."""
    site = r"https?://(?:www\.)?" + host.replace(".", r"\.")
    return F.regexp_replace(url, f"(?i)^({site}){{1,2}}(https?://)", "$2")
