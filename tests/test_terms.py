"""Long lists of terms against one test a term."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listingflow.operators import filters, terms


def brute(text, listed):
    low = (text or "").lower()
    return next((t for t in (x.lower() for x in listed if x) if t in low), None)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice((0, 3, 40, 400)))) for _ in range(150)] + [None, "", "ABC" * 20_000, "İSTANBUL ß"]
    return [*out, *out[:20]]


@pytest.mark.parametrize("way", [{}, {"few": 0}, {"automaton_bytes": 0}])
def test_all_ways_give_the_first_term(spark, texts, way):
    rng = random.Random(2)
    listed = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 7))) for _ in range(30)][::-1]
    listed = [t for t in listed if len(t) > 2] + ["", "ABC", "abc", "dd", "é", "ß"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, text string, place string")
    got = terms.first_term(df, "text", listed, **way)
    assert got.columns == ["k", "text", "place", "term"] and {r["k"]: r["term"] for r in got.collect()} == {i: brute(t, listed) for i, t in enumerate(texts)}
    assert got.count() == len(texts)
    for none in ([], [""]):
        assert terms.first_term(df, "text", none, **way).where("term is not null").count() == 0
    assert terms.first_term(df.limit(0), "text", listed, **way).count() == 0


def test_fifty_thousand_terms(spark, texts):
    rng = random.Random(3)
    listed = list({"".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(50_000)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    want = {i: brute(t, listed) for i, t in enumerate(texts)}
    table = spark.createDataFrame([(i, t.upper()) for i, t in enumerate(listed)] + [(None, "a"), (0, None)], "place long, term string")
    for options in ({}, {"automaton_bytes": 1000}):
        assert {r["k"]: r["term"] for r in terms.first_term(df, "text", table, **options).collect()} == want
    assert any(want.values())


def test_filters_take_lists_of_any_length(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(200)]
    rows = [(" ".join(rng.sample(words, 3)), rng.choice([*words, None])) for _ in range(80)]
    df = spark.createDataFrame(rows, "title string, company string")
    short, long = words[:3], words[:3] * 20  # the same terms, listed often enough for the other way
    for call in (lambda x: filters.exclude(df, x, x), lambda x: filters.select_terms(df, in_company=x, out_title=x), lambda x: filters.select_terms(df, in_title=x)):
        assert Counter(map(tuple, call(short).collect())) == Counter(map(tuple, call(long).collect()))
    assert terms.with_terms(df.withColumn("x", F.lit(1)), {"title": words}).columns == ["title", "company", "x"]
