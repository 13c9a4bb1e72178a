"""Lists of many terms over texts: which one, first by the list's order, a text contains.

Up to FEW terms are tests in one expression.  Longer lists are an automaton of all terms, broadcast once its size is
known to be bounded, that reads each text once.  Beyond the bound terms and texts meet on the rarest gram of each
term, and each meeting is checked.  All three give the same terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.operators.filters import matching_term
from listingflow.shared import staged, unstage

#: Terms tested one by one; bytes of terms that an automaton holds at most; characters of a gram.
FEW, AUTOMATON_BYTES, GRAM = 32, 16 << 20, 4


def first_term(df: DataFrame, text: str, terms: DataFrame | list[str], name: str = "term", few: int = FEW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``df`` with ``name``: the first of the ``terms`` that the lower-cased ``text`` contains, or null.

    ``terms`` is a list or a table of ``place`` (whole numbers) and ``term``.  Terms are lower-cased; null and empty ones contain
    nothing and are left out; of equal ones the first place counts.  Null and empty texts have no term.  Rows are neither
    dropped nor merged, and whole texts are read.  Only the way beyond ``automaton_bytes`` shuffles.
    """
    spark = df.sparkSession
    if isinstance(terms, list):
        terms = spark.createDataFrame(list(enumerate(terms)), "place long, term string")
    listed = terms.select(F.col("place").cast("long").alias("place"), F.lower("term").alias("term")).where("place is not null and term != ''").groupBy("term").agg(F.min("place").alias("place"))
    listed = staged(listed, "terms")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size > automaton_bytes:
        return _by_grams(df, text, listed, name)
    ordered = [r["term"] for r in listed.orderBy("place", "term").collect()]
    unstage(listed)
    return df.withColumn(name, matching_term(F.col(text), ordered) if n <= few else _by_automaton(F.lower(F.col(text)), ordered))


def _by_automaton(text: Column, terms: list[str]) -> Column:
    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            automaton.add_word(term, place)
        automaton.make_automaton()
        for texts in batches:
            places = [min((place for _, place in automaton.iter(t)), default=None) if t else None for t in texts]
            yield pd.Series([None if p is None else terms[p] for p in places], dtype=object)

    return find(text)


def _grams(text: Column, sizes: Column) -> Column:
    """The distinct substrings of ``text`` of the given ``sizes``."""
    each = F.transform(sizes, lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(each))


def _by_grams(df: DataFrame, text: str, listed: DataFrame, name: str) -> DataFrame:
    rows = staged(df.withColumn("_row", F.monotonically_increasing_id()), "terms-rows")
    texts = rows.select("_row", F.lower(F.col(text)).alias("_text")).where("_text != ''")
    size = F.least(F.length("term"), F.lit(GRAM))
    parts = staged(listed.select("place", "term", F.explode(_grams(F.col("term"), F.array(size))).alias("gram")), "terms-grams")
    sizes = sorted(r[0] for r in parts.select(F.length("gram")).distinct().collect())  # GRAM at most
    held = texts.select("_row", F.explode(_grams(F.col("_text"), F.array(*map(F.lit, sizes)))).alias("gram")) if sizes else texts.select("_row", F.lit("").alias("gram"))
    hits = staged(held.join(parts.select("gram").distinct(), "gram"), "terms-hits")
    often = staged(hits.groupBy("gram").agg(F.count("*").alias("often")), "terms-counts")
    # a gram that no text has is the rarest of its term, which then meets none
    rarest = parts.join(often, "gram", "left").groupBy("place", "term").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    met = hits.join(staged(rarest, "terms-rarest"), "gram").select("_row", "place", "term")
    found = met.join(texts, "_row").where(F.col("_text").contains(F.col("term"))).groupBy("_row").agg(F.min_by("term", "place").alias(name))
    found = staged(found, "terms-found")
    unstage(parts, hits, often)
    return rows.join(found, "_row", "left").select(*df.columns, name)


def without_terms(df: DataFrame, lists: dict[str, DataFrame | list[str]], **options) -> DataFrame:
    """Rows none of whose columns contains a term of the column's list, however long the lists are."""
    out = df
    for k, (column, terms) in enumerate(lists.items()):
        out = first_term(out, column, terms, f"_term{k}", **options).where(F.col(f"_term{k}").isNull())
    return out.select(*df.columns)


def with_terms(df: DataFrame, lists: dict[str, DataFrame | list[str]], **options) -> DataFrame:
    """Rows each of whose columns contains a term of the column's list; see :func:`without_terms`."""
    out = df
    for k, (column, terms) in enumerate(lists.items()):
        out = first_term(out, column, terms, f"_term{k}", **options).where(F.col(f"_term{k}").isNotNull())
    return out.select(*df.columns)
