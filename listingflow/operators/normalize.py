"""Normalised listings from records whose fields go by several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.text import first_filled, trimmed

#: The names that a field may have, in order of precedence.
ALIASES = {
    "id": ["id", "jobId"],
    "title": ["title", "jobTitle"],
    "company": ["company", "companyName"],
    "location": ["location", "jobLocation"],
    "descriptionText": ["descriptionText", "description", "jobDescription"],
    "descriptionHtml": ["descriptionHtml", "htmlDescription"],
    "url": ["url", "jobUrl", "applyUrl"],
    "postedDate": ["postedDate", "datePosted"],
}
OPTIONAL = ("salary", "salaryCurrency", "jobType", "experienceLevel")


def hash_id(*columns: Column) -> Column:
    """An id of a record without one; equal records get equal ids."""
    return F.concat(F.lit("job_"), F.hex(F.xxhash64(*columns)))


def normalize(df: DataFrame, now: str, source: str = "unknown") -> DataFrame:
    """The normalised fields; ``now`` stands for missing dates, so that results repeat."""
    have = set(df.columns)

    def one(name: str) -> Column:
        found = [F.col(c).cast("string") for c in ALIASES[name] if c in have]
        return trimmed(F.coalesce(first_filled(*found), F.lit(""))) if found else F.lit("")

    fields = {n: one(n) for n in ALIASES}
    fields["id"] = F.coalesce(F.nullif(fields["id"], F.lit("")), hash_id(fields["title"], fields["company"], fields["url"]))
    fields["postedDate"] = F.coalesce(F.nullif(fields["postedDate"], F.lit("")), F.lit(now))
    out = [c.alias(n) for n, c in fields.items()]
    out += [(F.col(n).cast("string") if n in have else F.lit(None).cast("string")).alias(n) for n in OPTIONAL]
    meta = df.schema["metadata"].dataType.names if "metadata" in have else []
    given = lambda n, default: F.coalesce(F.col(f"metadata.{n}"), default) if n in meta else default
    out.append(F.struct(given("source", F.lit(source)).alias("source"), given("scrapedAt", F.lit(now)).alias("scrapedAt"), given("confidence", F.lit(1.0)).cast("double").alias("confidence")).alias("metadata"))
    return df.select(*out)
