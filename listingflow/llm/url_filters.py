"""URL filters: host suffixes and path prefixes looked up by short hash prefixes.

A URL expands into every suffix of its host joined with every prefix of its path
that a rule could have.  Expressions meet rules in an equi-join on the first eight
hex digits of their SHA-256; the full digest decides, then the longest rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import ascii_lower, free_name, let, staged

PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, labels: int) -> Column:
    """The last 1 to ``labels`` labels of the host."""
    return let(
        F.split(host, r"\."),
        lambda x: F.transform(
            F.sequence(F.lit(1), F.least(F.size(x), F.lit(labels))),
            lambda k: F.array_join(F.slice(x, F.size(x) - k + 1, k), "."),
        ),
    )


def _prefixes(path: Column, longest: int, depth: int, lengths: list[int]) -> Column:
    """The prefixes of the path that a rule could have: none, those that end with one of its first ``depth`` slashes, and those of ``lengths``; none is longer than ``longest``."""
    head = F.substring(path, F.lit(1), F.lit(longest))
    found = F.array(F.lit(""))
    if depth:
        slashed = lambda x: F.transform(F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda k: k < F.size(x)), lambda k: F.concat(F.array_join(F.slice(x, 1, k), "/"), F.lit("/")))
        found = F.concat(found, let(F.split(head, "/"), slashed))
    if lengths:
        found = F.concat(found, F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)))
    return F.array_distinct(found)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = 100_000,
    salts: int = 32,
) -> DataFrame:
    """``pages`` with a struct ``judged``: ``host``, ``path``, ``rule``, ``verdict``; its name gets underscores where ``pages`` has such a column.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and all
    subdomains where the URL's path starts with the rule's path.  The longest fitting
    rule wins; between two of one length the longer host, then ``block``.  Without a
    rule, ``rule`` is null and ``verdict`` is ``default``.  Null URLs and those without
    ``://`` have an empty host and path, which no rule fits.  Repeated rows stay; an
    empty rule table judges everything by ``default``; rules with a null host, path or
    verdict, or an empty host, are void.  Of very long URLs only the prefixes are built whose depth and length a
    rule has, in time that grows with the length.

    Rules are broadcast up to ``broadcast_rules``, which are counted first; beyond it
    each rule goes to all ``salts`` and each URL to one, so that an expression which a
    third of all URLs share is spread.  Distinct (host, path) are judged once; those that a rule fits are
    written, so that the join back has plain exchanges, which can be split at a hot URL, and URLs without a host
    are spread over all of them.
    """
    good = rules.where("host is not null and host != '' and path is not null and verdict is not null").select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    about = good.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.length("rule_path")).alias("longest"),
        F.max(F.when(F.col("rule_path").endswith("/"), F.size(F.split("rule_path", "/")) - 1)).alias("depth"),
        F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))).alias("lengths"),
    ).first()
    judged = free_name(pages, "judged")
    parts = pages.withColumn(judged, F.struct(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    keyed = good.select(
        F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("length"),
            F.length("rule_host").alias("host_length"),
            (F.col("rule_verdict") == "block").alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        ).alias("fit"),
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    prefixes = _prefixes(F.col("path"), about["longest"] or 0, about["depth"] or 0, sorted(about["lengths"] or []))
    urls = parts.select(f"{judged}.host", f"{judged}.path").where("host != ''").distinct()
    wide = urls.select(
        "host",
        "path",
        F.explode(
            F.flatten(
                F.transform(
                    _suffixes(F.col("host"), about["labels"] or 0 or 1),
                    lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, p), 256)),
                )
            )
        ).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    if about["n"] <= broadcast_rules:
        met = wide.join(F.broadcast(keyed), "short")
    else:
        spread = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = wide.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(spread, ["short", "salt"])
    decided = staged(met.where("digest = rule_digest").groupBy("host", "path").agg(F.max("fit").alias("fit")), "url-decided")
    apart = free_name(parts, "apart")
    spread_parts = parts.withColumn(apart, F.when(F.col(f"{judged}.host") == "", F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    same = (F.col(f"p.{judged}.host") == F.col("d.host")) & (F.col(f"p.{judged}.path") == F.col("d.path")) & (F.col(f"p.{apart}") == F.col("d.apart"))
    out = spread_parts.alias("p").join(decided.withColumn("apart", F.lit(-1).cast("long")).alias("d"), same, "left")
    return out.select(
        *[F.col(f"p.`{c}`") for c in pages.columns],
        F.struct(
            F.col(f"p.{judged}.host").alias("host"),
            F.col(f"p.{judged}.path").alias("path"),
            F.col("d.fit.rule").alias("rule"),
            F.coalesce("d.fit.verdict", F.lit(default)).alias("verdict"),
        ).alias(judged),
    )
