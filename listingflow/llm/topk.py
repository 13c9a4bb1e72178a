"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are integers.  A block's index orders its postings (vector, dimension,
value) by the quantised impact, the power of two of the value's magnitude, and
cuts them into segments of equal impact.  A segment keeps its postings by dimension, or as a
matrix where it has most of them.  Queries take segments from high to low
impact and add every posting at once.  After a segment the rest of a vector has a
known norm, so its score is bounded; a query stops when the bounds prove that all
but a few vectors are out, and those few are scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.common import staged
from listingflow.llm.vectors import block_count, matrix, through_blocks, whole

#: Queries scored together in a task; share of a segment's places from which it is kept as a matrix.
TOGETHER, DENSE = 256, 1 / 16


class ImpactIndex:
    """The postings of a block of integer vectors in descending impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        impact = np.frexp(np.abs(vectors).astype(np.float64))[1]
        impact[vectors == 0] = 0
        rows, dims = np.nonzero(vectors)
        values = vectors[rows, dims].astype(np.float64)
        level = impact[rows, dims]
        order = np.lexsort((rows, dims, -level))
        rows, dims, values, level = rows[order], dims[order], values[order], level[order]
        self.levels, starts = np.unique(-level, return_index=True)
        ends = np.append(starts[1:], len(level)).astype(np.int64)
        self.segments: list = []
        # the norm of what segments after each leave of a vector
        self.rest = np.zeros((len(self.levels), len(vectors)))
        left = (vectors.astype(np.float64) ** 2).sum(axis=1)
        for k, (s, e) in enumerate(zip(starts, ends)):
            left = left - np.bincount(rows[s:e], values[s:e] ** 2, len(vectors))
            self.rest[k] = np.sqrt(np.maximum(left, 0))
            if e - s >= DENSE * vectors.size:
                dense = np.zeros(vectors.shape)
                dense[rows[s:e], dims[s:e]] = values[s:e]
                self.segments.append(dense)
            else:
                own, at = np.unique(dims[s:e], return_index=True)
                cuts = np.append(at, e - s) + s
                self.segments.append([(j, rows[f:t], values[f:t]) for j, f, t in zip(own, cuts, cuts[1:])])

    def add(self, k: int, queries: np.ndarray, partial: np.ndarray, live: np.ndarray) -> None:
        """Adds the postings of segment ``k`` to the scores of the ``live`` queries."""
        segment = self.segments[k]
        if isinstance(segment, np.ndarray):
            partial[live] += queries[live] @ segment.T
            return
        for j, rows, values in segment:
            partial[np.ix_(live, rows)] += queries[live, j][:, None] * values


def block_top(index: ImpactIndex, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of its ``k`` best in the block; ``own``: the query's own position or -1."""
    n, found = len(index.vectors), [None] * len(queries)
    q = queries.astype(np.float64)
    norm = np.sqrt((q**2).sum(axis=1))
    partial, live = np.zeros((len(q), n)), np.arange(len(q))
    away = own[live] >= 0
    for s in range(len(index.levels) or 1):
        if len(index.levels):
            index.add(s, q, partial, live)
        slack = norm[live, None] * (index.rest[s][None, :] if len(index.levels) else 0.0)
        last = s >= len(index.levels) - 1
        low = partial[live] - slack * (1 + 1e-9) - 1e-6
        away = np.nonzero(own[live] >= 0)[0]
        low[away, own[live][away]] = -np.inf
        least = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), -np.inf)
        may = partial[live] + slack * (1 + 1e-9) + 1e-6 >= least[:, None]
        may[away, own[live][away]] = False
        few = may.sum(axis=1)
        done = np.ones(len(live), bool) if last else few <= max(4 * k, n // 64)
        for i in np.nonzero(done)[0]:
            member = np.nonzero(may[i])[0]
            exact = index.vectors[member] @ queries[live[i]]
            best = np.lexsort((ids[member], -exact))[:k]
            found[live[i]] = member[best], exact[best]
        live = live[~done]
        if not len(live):
            break
    return found


def _exact(vectors: np.ndarray, queries: np.ndarray) -> bool:
    """Whether all partial scores are whole numbers that a double holds."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return top(vectors) * top(queries) * max(1, vectors.shape[1]) < 2**52


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16_384) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query.

    Components become floor(``scale`` * x).  Queries are the rows whose id ``every``
    divides, candidates all rows but the query's own; ties go to the smaller id.
    Returns ``query_id``, ``rank`` from 1, ``id_col`` and ``score``.  Vectors that are
    null or hold null or non-finite components, and rows with a null id, take no part.
    Shorter vectors count as padded with zeros; rows of one id are rows of their own.
    With fewer candidates than ``k`` all are returned; an empty table gives no rows.  Ids must be
    whole numbers, since queries are told by division: others are an error.  A component whose product
    reaches 2^53 is an error, and so is a score beyond 64 bits.  Other columns are not read.

    Rows are dealt by number into blocks of at most about ``block``.  A block is one task, which indexes
    it once while the queries pass by in batches of ``TOGETHER``.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("x")).dropna()
    ints = staged(good.withColumn("row", F.monotonically_increasing_id()), "topk-ints")
    about = ints.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    blocks, dims = block_count(spark, about["n"], block), max(1, about["dims"] or 0)
    dealt = ints.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def build(table):
        return _Block(table, dims)

    def ask(held, batch):
        queries, rows, query_ids = matrix(batch.column("x"), dims, np.int64), batch.column("row").to_numpy(), batch.column("id").to_numpy()
        for at in range(0, len(queries), TOGETHER):
            part = slice(at, at + TOGETHER)
            tops = held.top(queries[part], rows[part], k)
            sizes, places = [len(t[0]) for t in tops], np.concatenate([t[0] for t in tops])
            columns = [np.repeat(rows[part], sizes), np.repeat(query_ids[part], sizes), held.rows[places], held.ids[places], np.concatenate([t[1] for t in tops]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "row", "vec", "score"])

    asked = ints.where(F.col("id") % every == 0)
    hits = through_blocks(dealt, asked, blocks, build, ask, "query_row long, query_id long, row long, vec long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec", "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec").alias(id_col), "score")


class _Block:
    """A task's block: rows by id, and their index unless scores are too large for doubles."""

    def __init__(self, table: pa.Table, dims: int):
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        self.ids, self.rows = table["id"].to_numpy(), table["row"].to_numpy()
        self.vectors = matrix(table["x"], dims, np.int64)
        self.index = ImpactIndex(self.vectors)
        self.places = {r: i for i, r in enumerate(self.rows.tolist())}

    def top(self, queries: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        own = np.array([self.places.get(r, -1) for r in rows.tolist()])
        if _exact(self.vectors, queries):
            return block_top(self.index, queries, own, self.ids, k)
        large = self.vectors.astype(object)
        return [_plain_top(large, q, o, self.ids, k) for q, o in zip(queries.astype(object), own)]


def _plain_top(vectors, query, own: int, ids, k: int):
    """Scores too large for doubles: whole numbers of any size."""
    scores = [sum(a * b for a, b in zip(v, query)) for v in vectors]
    order = sorted((i for i in range(len(scores)) if i != own), key=lambda i: (-scores[i], ids[i]))[:k]
    return np.array(order, dtype=np.int64), np.array([scores[i] for i in order], dtype=object)
