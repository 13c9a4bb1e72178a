"""Hard negatives by a vertical scan with bounds (branch and bound on decomposed data).

A task holds a block of vectors as columns, one for each dimension.  For each anchor it reads
them in descending magnitude of the anchor's components and adds their part of the inner
products.  What the dimensions still to come can add lies between the sums of their least and
greatest contributions, which the column's minimum and maximum give.  So each candidate's score
has a lower and an upper bound, and the candidates that can't matter leave the bitmap: first those
that can't be among the best of the anchor's own label, then those that can't be among the
best of a window of scores.  What the last column leaves has exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.common import staged, unstage
from listingflow.llm.vectors import block_count, matrix, through_blocks, whole

#: Columns read between two looks at the bounds.
STEP = 8


class Columns:
    """A block of vectors by dimension, with the range of each."""

    def __init__(self, table: pa.Table, dims: int):
        self.rows, self.ids = (table[c].to_numpy() for c in ("row", "id"))
        self.labels = table["label"].to_numpy()
        x = matrix(table["x"], dims)
        self.columns = np.ascontiguousarray(x.T)
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.largest = float(np.abs(x).max(initial=0))
        self._whole = None

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the ``candidates`` that ``keep(lower, upper)`` leaves, asked after every STEP columns."""
        exact = self.largest * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**52
        if not exact:
            return self._scan_whole(anchor, candidates)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor[order] * self.low[order], anchor[order] * self.high[order]])
        rest_low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0.0)
        rest_high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0.0)
        score = np.zeros(len(candidates))
        for at in range(0, len(order), STEP):
            read = order[at : at + STEP]
            score += anchor[read] @ (self.columns[read] if len(candidates) == self.columns.shape[1] else self.columns[np.ix_(read, candidates)])
            done = min(at + STEP, len(order))
            left = keep(score + rest_low[done], score + rest_high[done])
            if not left.all():
                candidates, score = candidates[left], score[left]
            if not len(candidates):
                break
        return candidates, score.astype(np.int64)

    def _scan_whole(self, anchor: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores beyond what doubles hold: whole numbers of any size, without bounds."""
        if self._whole is None:
            self._whole = self.columns.astype(np.int64).astype(object)
        return candidates, anchor.astype(np.int64).astype(object) @ self._whole[:, candidates]


def _at_least(lower: np.ndarray, k: int) -> float:
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf


def best_of_label(block: Columns, row: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows of the label in the block but the anchor's own, ties by smaller id."""
    at, score = block.scan(anchor, np.nonzero((block.labels == label) & (block.rows != row))[0], lambda low, high: high >= _at_least(low, k))
    first = np.lexsort((block.rows[at], block.ids[at], -score))[:k]
    return at[first], score[first]


def best_in_windows(block: Columns, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ends included, the ``k`` best rows of other labels in the block."""

    def keep(low, high):
        left = np.zeros(len(low), bool)
        for least, most in windows:
            # sure to lie in the window: what can't reach the k-th of these is out
            enough = max(least, _at_least(low[(low >= least) & (high <= most)], k))
            left |= (high >= enough) & (low <= most)
        return left

    at, score = block.scan(anchor, np.nonzero(block.labels != label)[0], keep)
    out = []
    for least, most in windows:
        fits = np.nonzero((score >= least) & (score <= most))[0]
        first = fits[np.lexsort((block.rows[at[fits]], block.ids[at[fits]], -score[fits]))[:k]]
        out.append((at[first], score[first]))
    return out


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, least_percent: int = 50, most_percent: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = 65_536
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become floor(``scale`` * x).  Scores are whole inner products; higher ones come first, ties by smaller
    id.  Anchors are rows whose id ``every`` divides.  Each anchor's positives are its best other rows of its
    label, ``positives`` at most; for each of them the result has the best rows of other labels, ``negatives`` at
    most, with ``least_percent`` * positive_score <= 100 * score <= ``most_percent`` * positive_score.  A negative
    positive_score has no such rows, and one of 0 only those of score 0.

    Rows with a null label, a null vector, or null or non-finite components take no part, nor do
    rows with a null id.  Rows that repeat an id are rows of their own, each an anchor if the id is one.  Shorter
    vectors count as padded with zeros.  A pair without negatives gives no row; an empty table gives none.
    Labels and ids must be whole numbers.  Other columns are not read.  A component that reaches
    2^53 is an error, and so is a score beyond 64 bits.

    Rows are dealt by number into blocks of at most about ``block``.  A block is one task, which holds
    it as columns while all anchors pass by, twice: for positives, then for the windows they give.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(F.col(vector_col), scale).alias("x")).dropna()
    ints = staged(good.withColumn("row", F.monotonically_increasing_id()), "negatives-ints")
    about = ints.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    blocks, dims = block_count(spark, about["n"], block), max(1, about["dims"] or 0)
    dealt = ints.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    anchors = ints.where(F.col("id") % every == 0)
    build = lambda table: Columns(table, dims)

    def find_positives(index, batch):
        x, rows, labels = matrix(batch.column("x"), dims), batch.column("row").to_numpy(), batch.column("label").to_numpy()
        found = [best_of_label(index, r, y, v, positives) for r, y, v in zip(rows, labels, x)]
        sizes = [len(f[0]) for f in found]
        at, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        columns = [np.repeat(rows, sizes), index.rows[at], index.ids[at], score.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_row", "row", "positive_id", "positive_score"])

    near = through_blocks(dealt, anchors, blocks, build, find_positives, "anchor_row long, row long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "row")
    chosen = staged(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "negatives-positives")

    s = F.col("positive_score")
    windows = chosen.groupBy("anchor_row").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    asked = anchors.join(windows, anchors["row"] == windows["anchor_row"]).drop("anchor_row")

    def find_negatives(index, batch):
        x, rows, labels = matrix(batch.column("x"), dims), batch.column("row").to_numpy(), batch.column("label").to_numpy()
        parts = []
        for r, y, v, scores in zip(rows, labels, x, batch.column("scores").to_pylist()):
            between = [(-(-least_percent * p // 100), most_percent * p // 100) for p in scores]
            for p, (at, score) in zip(scores, best_in_windows(index, y, v, between, negatives)):
                parts.append((np.full(len(at), r), np.full(len(at), p), index.rows[at], index.ids[at], score.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*parts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_row", "at_score", "row", "negative_id", "negative_score"])

    far = through_blocks(dealt, asked, blocks, build, find_negatives, "anchor_row long, at_score long, row long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_row", "at_score").orderBy(F.desc("negative_score"), "negative_id", "row")
    ranked = staged(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).drop("row"), "negatives-found")
    pairs = chosen.join(ranked.withColumnRenamed("anchor_row", "of"), (F.col("anchor_row") == F.col("of")) & (s == F.col("at_score")))
    # written, so that the tables before it can go
    out = staged(
        pairs.join(anchors.select(F.col("row").alias("own"), F.col("id").alias("anchor_id")), F.col("anchor_row") == F.col("own")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"
    )
    unstage(ints, chosen, ranked)
    return out
