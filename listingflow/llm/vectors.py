"""Whole-number vectors, and tasks that hold a block of them while queries pass by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Doubles below it are told apart from their neighbours by one or less.
EXACT = 2**53


def whole(vector: Column, scale: float) -> Column:
    """floor(``scale`` * x) of each component as a double; null for a vector that is null or holds null or non-finite components.

    A product of 2^53 or more in magnitude has no such whole number in a double and is an error.
    """
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    too_large = F.raise_error(F.lit(f"a component times {scale:g} reaches 2^53")).cast("long")
    ints = F.transform(vector, lambda v: F.when(F.abs(v.cast("double") * scale) < EXACT, F.floor(v.cast("double") * scale)).otherwise(too_large))
    return F.when(~bad, ints)


def block_count(spark: SparkSession, n: int, most: int, least: int = 1024) -> int:
    """Blocks of at most about ``most`` rows, more of them while there are fewer than partitions and they keep ``least`` rows."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // most), min(-(-n // least), partitions))


def matrix(column: pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    """The rows of a list column, padded with zeros to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(column) * dims and (np.diff(ends, prepend=0) == dims).all():
        return flat.reshape(-1, dims).astype(dtype)
    out = np.zeros((len(column), dims), dtype)
    for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends)):
        out[i, : e - s] = flat[s:e]
    return out


def through_blocks(rows: DataFrame, asked: DataFrame, blocks: int, build: Callable[[pa.Table], object], ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``ask`` says of each batch of ``asked`` against each block of ``rows``, which have an int column ``block``.

    Each block goes to one task, which builds its index once; the queries, a copy for each block, follow it in
    the order of the shuffle and pass by in batches.  A task holds one block and one batch.
    """
    both = rows.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_asks", F.lit(True)), allowMissingColumns=True)

    def task(batches):
        held, index = [], None
        for batch in batches:
            split = batch.num_rows - int(np.count_nonzero(batch.column("_asks").to_numpy(zero_copy_only=False)))
            if split:
                held.append(batch.slice(0, split))
            if split < batch.num_rows and held is not None:
                index, held = (build(pa.Table.from_batches(held)) if held else None), None
            if split < batch.num_rows and index is not None:
                yield from ask(index, batch.slice(split))

    return both.repartitionById(blocks, "block").sortWithinPartitions("_asks").mapInArrow(task, schema)
