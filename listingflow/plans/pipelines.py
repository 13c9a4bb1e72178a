"""The stages of the listing pipeline as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.templates import render, sections
from listingflow.functions.text import pair_key
from listingflow.operators.dedup import greedy_two_key
from listingflow.operators.filters import excluded, filled
from listingflow.operators.registry import expire, unseen
from listingflow.operators.verdicts import before_judging, distinct_titles, join_verdicts
from listingflow.plans.scoring import Scorer
from listingflow.shared import staged


def refine(df: DataFrame, order: str, company_terms: list[str], title_terms: list[str], registry: DataFrame | None = None, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Refined listings, and rows without title or company.

    Filters come before the deduplication: they read nothing but its key, so rows of
    one key pass or fail together.  The registry expires only if ``now`` is given.
    """
    broken = df.where("title is null or company is null")
    rows = df.where("title is not null and company is not null")
    rows = rows.where(~excluded(F.col("company"), F.col("title"), company_terms, title_terms))
    if registry is not None:
        rows = unseen(rows, registry if now is None else expire(registry, now))
    keyed = rows.withColumn("_pair", pair_key(F.col("title"), F.col("company")))
    return greedy_two_key(keyed, "id", "_pair", order).drop("_pair"), broken


def refine_sorted(df: DataFrame, order: str, company_terms: list[str], title_terms: list[str]) -> DataFrame:
    """The older way: the two-key scan by ``order`` (a date, then a place) over all rows, and filters on what it keeps.

    A row that the filters drop still shadows later ones here.
    """
    keyed = df.withColumn("_pair", pair_key(F.col("title"), F.col("company")))
    kept = greedy_two_key(keyed, "id", "_pair", order).drop("_pair")
    return kept.where(~excluded(F.col("company"), F.col("title"), company_terms, title_terms))


def prefilter(df: DataFrame, scorer: Scorer, order: Column) -> DataFrame:
    """Listings whose title is judged favourably; each title is judged once."""
    rows = filled(df, "title", "url")
    titles = scorer(distinct_titles(rows, order).withColumn("descriptionText", F.lit("")))
    verdicts = titles.select("title", "verdict.isVeryHighlyAligned", "verdict.confidence", F.col("first"))
    return join_verdicts(rows, verdicts, "title", F.col("first"))


def judge(df: DataFrame, registry: DataFrame, scorer: Scorer, order: Column, now: int) -> DataFrame:
    """All listings with ``route`` and ``verdict``; what is not a dupe goes to the registry next.

    Only what is neither a dupe nor without a description is scored; the others' verdict is null.
    """
    routed = staged(before_judging(df, expire(registry, now), order), "judge-routed")
    scored = scorer(routed.where("route is null").drop("route"))
    judged = scored.withColumn("route", F.when(F.col("verdict.isVeryHighlyAligned"), "pass").otherwise("fail"))
    others = routed.where("route is not null").withColumn("verdict", F.lit(None).cast(scored.schema["verdict"].dataType))
    return judged.unionByName(others)


def materials(passed: DataFrame, template: str, values: dict[str, Column], answer: Scorer) -> DataFrame:
    """Sections of the answer to a filled template for each listing."""
    asked = passed.withColumn("prompt", render(template, values, double=True))
    return answer(asked).withColumn("sections", sections(F.col("answer")))
