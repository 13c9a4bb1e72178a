"""Batches of rows for calls that take many at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.operators.order import numbered


def batches(df: DataFrame, order: str, value: str, size: int = 100, separator: str = "\n", most: int = 100_000) -> DataFrame:
    """``batch``, its number of rows ``n`` and its values joined in order.

    Size 0 makes one batch, and so one row: more than ``most`` rows are an error then.
    """
    if not size and df.limit(most + 1).count() > most:
        raise ValueError(f"one batch holds {most} rows at most")
    placed = numbered(df, order)
    batch = F.floor(F.col("_pos") / size).cast("long") if size else F.lit(0).cast("long")
    grouped = placed.groupBy(batch.alias("batch")).agg(F.sort_array(F.collect_list(F.struct("_pos", F.col(value).alias("v")))).alias("rows"))
    return grouped.select("batch", F.size("rows").cast("long").alias("n"), F.array_join("rows.v", separator).alias("text"))


def numbered_text(values: DataFrame, order: str, value: str, size: int = 100) -> DataFrame:
    """Batches whose values are numbered from 1 in each, as a question about many titles lists them."""
    placed = numbered(values, order)
    batch, k = F.floor(F.col("_pos") / size).cast("long"), (F.col("_pos") % size + 1).cast("string")
    rows = placed.select(batch.alias("batch"), F.struct("_pos", F.concat(k, F.lit(". "), F.col(value)).alias("v")).alias("r"))
    return rows.groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list("r"))["v"], "\n").alias("text"))


def each_batch(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, calls: int = 8) -> DataFrame:
    """``call`` of whole batches of rows; the first that fails ends the job with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(call, parts)

    return df.repartition(calls).mapInPandas(run, schema)


def all_or_error(rows: DataFrame, error: str = "error") -> DataFrame:
    """``rows`` without ``error``; an exception if any row has one, after all were tried."""
    from listingflow.shared import staged

    done = staged(rows, "settled")
    about = done.agg(F.count_if(F.col(error).isNotNull()).alias("n"), F.min(error).alias("first")).first()
    if about["n"]:
        raise RuntimeError(f"{about['n']} calls failed, such as: {about['first']}")
    return done.drop(error)


def in_flight(call: Callable, items: Iterable, n: int) -> Iterator:
    """``call`` of each item, ``n`` at a time, in the order of the items; no more than ``n`` are taken ahead.

    A call that fails gives its exception in place of an answer.
    """

    def settled(item):
        try:
            return call(item)
        except Exception as e:
            return e

    with ThreadPoolExecutor(n) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(settled, item))
            if len(waiting) >= n:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def shares(calls: int, tasks: int | None) -> tuple[int, int]:
    """Tasks, four if not said, and calls of each at once, so that all have ``calls`` in flight at most."""
    tasks = max(1, min(calls, 4 if tasks is None else tasks))
    return tasks, max(1, calls // tasks)


def each_row(df: DataFrame, call: Callable[[dict], dict], schema: str, calls: int = 8, tasks: int | None = None) -> DataFrame:
    """``call`` of every row, ``calls`` at once over all ``tasks``; a failure gives a row with its ``error`` and nulls.

    ``schema``: of what ``call`` returns; ``error string`` comes after it.  A task's answers come in the order of its rows, and it waits for
    ``calls`` / ``tasks`` of them at most.  ``call`` is used by several threads.
    """
    names = [f.split()[0] for f in schema.split(",")]
    tasks, each = shares(calls, tasks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = in_flight(call, part.to_dict("records"), each)
            rows = [{**dict.fromkeys(names), "error": str(a)} if isinstance(a, Exception) else {**dict.fromkeys(names), **a, "error": None} for a in answers]
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return df.repartition(tasks).mapInPandas(run, f"{schema}, error string")
