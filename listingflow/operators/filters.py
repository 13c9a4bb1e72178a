"""Term filters, required fields, and lists of terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listingflow.functions.text import contains_any
from listingflow.shared import staged

#: Terms used where no list is given.
COMPANY_TERMS = ["jobs via dice", "lensa", "jobot", "talentify.io", "piper companies", "talent", "motion recruitment", "braintrust", "recruit", "teksystems", "robert half", "zachary piper"]
TITLE_TERMS = ["grc", "compliance", "product", "application", "manager", "director", "red", "penetration test", "pentest", "devops", "devsecops"]


def terms(argument: str | None, defaults: Iterable[str] = (), strict_case: bool = False) -> list[str]:
    """Defaults, then the comma-separated terms of an argument, lower-cased; ``strict_case`` leaves defaults as they are."""
    own = [t.strip().lower() for t in (argument or "").split(",")]
    return [t if strict_case else t.lower() for t in defaults] + [t for t in own if t]


def read_terms(spark: SparkSession, path: str, fallback: Iterable[str] = ()) -> list[str]:
    """Lines of a file without blanks and ``#`` comments; ``fallback`` if it can't be read."""
    try:
        rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("t")).where("t != '' and not startswith(t, '#')").collect()
    except Exception as e:  # a missing file is an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return list(fallback)
    return [r["t"] for r in rows]


def search_arguments(text: str | None, fallback: Iterable[str] = ()) -> list[str]:
    """Locations: a JSON list, or comma-separated; a leading comma stands for an empty one."""
    import json

    text = (text or "").strip()
    if not text:
        return list(fallback)
    if text.startswith("["):
        return [str(x) for x in json.loads(text)]
    parts = [p.strip().strip("\"'") for p in text.split(",")]
    return ([""] if text.startswith(",") else []) + [p for p in parts if p]


def excluded(company: Column, title: Column, company_terms: list[str], title_terms: list[str]) -> Column:
    """Whether a term occurs anywhere in the lower-cased company or title; missing ones hold none."""
    empty = F.lit("")
    return contains_any(F.lower(F.coalesce(company, empty)), company_terms) | contains_any(F.lower(F.coalesce(title, empty)), title_terms)


def exclude(df: DataFrame, company_terms: list[str], title_terms: list[str], company: str = "company", title: str = "title") -> DataFrame:
    """Rows whose company and title hold none of their terms; lists of any length."""
    from listingflow.operators import terms as lists

    if max(len(company_terms), len(title_terms)) > lists.FEW:
        return lists.without_terms(df, {company: list(company_terms), title: list(title_terms)})
    return df.where(~excluded(F.col(company), F.col(title), company_terms, title_terms))


def filter_passes(df: DataFrame, company_terms: Iterable[str] = COMPANY_TERMS, title_terms: Iterable[str] = TITLE_TERMS, company: str = "company", title: str = "title") -> tuple[DataFrame, DataFrame]:
    """Rows that pass the companies' terms and then the titles', and one row of counts: ``total``, ``by_company``, ``by_title`` and ``kept``.

    The counts are taken in passing while the rows are written, in one scan; of an empty table they are zeros.
    """
    low = lambda xs: [x.lower() for x in xs]
    out_c = excluded(F.col(company), F.lit(None).cast("string"), low(company_terms), [])
    out_t = excluded(F.lit(None).cast("string"), F.col(title), [], low(title_terms))
    flags = {"by_company": out_c, "by_title": ~out_c & out_t, "kept": ~out_c & ~out_t}
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    kept = staged(counted.where(flags["kept"]), "filter-passes")
    counts = df.sparkSession.createDataFrame([tuple(seen.get.get(c) or 0 for c in ("total", *flags))], "total long, by_company long, by_title long, kept long")
    return kept, counts


def has_details(df: DataFrame, description: str = "descriptionText") -> DataFrame:
    """Detail records that were read; an empty description counts as read."""
    return df.where(F.col(description).isNotNull())


def audit_log(df: DataFrame, kind: str | None = None, level: str | None = None) -> DataFrame:
    """Entries of a log of one ``type``, one ``level``, or both."""
    for column, wanted in (("type", kind), ("level", level)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def select_terms(df: DataFrame, in_company=(), in_title=(), out_company=(), out_title=(), company: str = "company", title: str = "title") -> DataFrame:
    """Exclusions first, then inclusions; an empty list of inclusions passes all.  Lists may be of any length."""
    from listingflow.operators import terms as lists

    low = lambda xs: [x.lower() for x in xs]
    kept = exclude(df, low(out_company), low(out_title), company, title)
    for c, wanted in ((company, low(in_company)), (title, low(in_title))):
        if len(wanted) > lists.FEW:
            kept = lists.with_terms(kept, {c: wanted})
        elif wanted:
            kept = kept.where(contains_any(F.lower(F.coalesce(F.col(c), F.lit(""))), wanted))
    return kept


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all ``columns`` are neither null nor empty."""
    for c in columns:
        df = df.where(F.length(F.col(c).cast("string")) > 0)
    return df


def matching_term(text: Column, wanted: list[str]) -> Column:
    """The first term that the text contains, or null."""
    return F.coalesce(*[F.when(F.lower(text).contains(t), t) for t in wanted]) if wanted else F.lit(None).cast("string")


def search(df: DataFrame, keywords=(), exclude_keywords=(), min_salary: float | None = None, max_salary: float | None = None, sort_by: str | None = None, descending: bool = False, text: tuple = ("title", "descriptionText")) -> DataFrame:
    """Keyword, salary and order options over listings."""
    whole = F.lower(F.concat_ws(" ", *text))
    for k in keywords:
        df = df.where(whole.contains(k.lower()))
    if exclude_keywords:
        df = df.where(~contains_any(whole, [k.lower() for k in exclude_keywords]))
    if min_salary is not None:
        df = df.where(F.col("salaryMax") >= min_salary)
    if max_salary is not None:
        df = df.where(F.col("salaryMin").between(0, max_salary))
    return df.orderBy(F.desc(sort_by) if descending else sort_by) if sort_by else df
