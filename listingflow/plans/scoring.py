"""Scorers: what judges records, with an offline default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.operators.batching import in_flight, shares
from listingflow.operators.verdicts import keyword_verdict

VERDICT = "isVeryHighlyAligned boolean, confidence double, rationale string"


class Scorer(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` with a struct ``verdict``."""


#: Scorers by provider; each entry makes one from its configuration.
PROVIDERS: dict[str, Callable[[dict], Scorer]] = {}


def provider(name: str):
    """Registers a maker of scorers under ``name``."""

    def add(make: Callable[[dict], Scorer]):
        PROVIDERS[name] = make
        return make

    return add


def scorer_of(config: dict) -> Scorer:
    """The scorer of a provider's configuration (``name`` and what its maker reads)."""
    name = config.get("name")
    if name not in PROVIDERS:
        raise KeyError(f"no provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](config)


@provider("keywords")
def _keywords(config: dict) -> Scorer:
    return keyword_scorer(config.get("title", "title"), config.get("description", "descriptionText"))


def keyword_scorer(title: str = "title", description: str = "descriptionText") -> Scorer:
    return lambda df: df.withColumn("verdict", keyword_verdict(F.col(title), F.col(description)))


def retrying(call: Callable, times: int = 3, base_ms: float = 0, factor: float = 2, most_ms: float = 30_000, or_none: bool = False) -> Callable:
    """``call`` tried up to ``times``, with ``base_ms`` times ``factor`` to the attempt before the next; then its last error is raised, or the answer is None."""

    def tried(*args):
        for attempt in range(times):
            try:
                return call(*args)
            except Exception:
                if attempt == times - 1:
                    if or_none:
                        return None
                    raise
                time.sleep(min(base_ms * factor**attempt, most_ms) / 1000)

    return tried


def call_scorer(call: Callable[[str], dict], prompt: str, key: str, calls: int = 8, retries: int = 3, tasks: int | None = None) -> Scorer:
    """A scorer that asks ``call`` once for each distinct prompt, ``calls`` at a time over all ``tasks``, and falls back to a refusal after ``retries``."""
    tasks, each = shares(calls, tasks)

    def one(text: str) -> tuple:
        answer, error, tried = None, None, 0
        while answer is None and tried < retries:
            tried += 1
            try:
                answer = call(text)
            except Exception as e:  # the last one is kept
                error = str(e)
        good = answer or {}
        return text, bool(good.get("isVeryHighlyAligned", False)), float(good.get("confidence", 0.0)), good.get("rationale", ""), tried, None if answer is not None else error

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(list(in_flight(one, part[prompt], each)), columns=["_p", "isVeryHighlyAligned", "confidence", "rationale", "attempts", "error"])

    def score(df: DataFrame) -> DataFrame:
        asked = df.select(prompt).distinct().repartition(tasks).mapInPandas(ask, f"_p string, {VERDICT}, attempts int, error string")
        verdicts = asked.select("_p", F.struct("isVeryHighlyAligned", "confidence", "rationale", "attempts", "error").alias("verdict"))
        return df.join(verdicts, F.col(prompt) == F.col("_p"), "left").drop("_p")

    return score
