"""K-means on whole numbers, the nearest centroid found by a vantage-point tree.

Every round builds a tree over the centroids and broadcasts it.  A node has a vantage
centroid and two children, each with the least and greatest distance of its centroids to
it; small nodes are leaves.  Every vector searches the tree best-first: it goes on with the
node whose bound is least and ends when that bound exceeds the distance of its best
centroid.  Bounds equal to it are still followed, so that ties reach the smaller number.
Distances to vantages and in leaves are exact whole numbers; only bounds are doubles,
with a margin above their rounding.  Vectors search in lockstep, so the work on one node is one
numpy call for all that have come to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import free_name, staged, unstage
from listingflow.llm.vectors import matrix, whole

#: Centroids of a leaf; relative margin of bounds; vectors that search together.
LEAF, MARGIN, TOGETHER = 4, 1e-12, 4096
#: Components below it keep squared distances of up to 64 dimensions within 64 bits; for more the limit is checked.
LARGEST = 2**27
#: Bytes of centroids that are broadcast at most.
MOST_BYTES = 64 << 20


class VantageTree:
    """A tree over the rows of ``points`` (whole numbers)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.members: list[list[int]] = []  # what a visit compares: a vantage, or all of a leaf
        self.children: list[list[tuple[float, float, int]]] = []
        if len(points):
            self._grow(list(range(len(points))))

    def _distances(self, c: int, others: list[int]) -> np.ndarray:
        return np.sqrt(((self.points[others] - self.points[c]) ** 2).sum(axis=1).astype(np.float64))

    def _grow(self, own: list[int]) -> int:
        at = len(self.members)
        self.members.append(own)
        self.children.append([])
        if len(own) > LEAF:
            vantage = own[int(self._distances(own[0], own).argmax())]
            rest = [c for c in own if c != vantage]
            apart = self._distances(vantage, rest)
            near = apart <= np.median(apart)
            if not near.all():  # else all are equally far, and a split gives no bound
                self.members[at] = [vantage]
                for part in (near, ~near):
                    child = self._grow([c for c, x in zip(rest, part) if x])
                    self.children[at].append((float(apart[part].min()), float(apart[part].max()), child))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of ``x`` the nearest point, the smallest number of several, its squared distance; and how many distances were taken."""
        best, found, taken = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), -1), 0
        bounds = np.full((len(x), len(self.members)), np.inf)
        bounds[:, :1] = 0
        live = np.arange(len(x))
        while len(live):
            node = bounds[live].argmin(axis=1)
            bound = bounds[live, node]
            go = bound <= np.sqrt(best[live].astype(np.float64)) * (1 + MARGIN)
            live, node, bound = live[go], node[go], bound[go]
            bounds[live, node] = np.inf
            for u in np.unique(node):
                rows, own = live[node == u], bound[node == u]
                taken += len(rows) * len(self.members[u])
                for c in self.members[u]:
                    d = ((x[rows] - self.points[c]) ** 2).sum(axis=1)
                    better = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
                    best[rows[better]], found[rows[better]] = d[better], c
                if self.children[u]:
                    apart = np.sqrt(d.astype(np.float64))
                    for low, high, child in self.children[u]:
                        least = np.maximum(low - apart, apart - high) - MARGIN * (apart + high)
                        bounds[rows, child] = np.maximum(own, least)
        return found, best, taken


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, scale: float = 256.0, dims: int = 64, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` of every vector.

    Vectors with exactly ``dims`` components take part, none of them null or non-finite; components become
    floor(``scale`` * x), and one that reaches 2^27 in magnitude is an error.  The first centroids are the
    vectors of smallest lowercase-hex sha256 of ``seed:id``, in that order; ties, which only rows of one id can have,
    go by vector, and rows with a null id come last.  Each round assigns all vectors, ties to the smaller number, and
    takes the exact floored mean of every cluster that isn't empty; after the last all are assigned once more.
    Fewer vectors than ``clusters`` give as many clusters; an empty table gives no rows.  Repeated rows stay and
    count each.  Other columns are not read.

    Vectors aren't shuffled: a task gives one sum for each cluster and dimension.  The driver holds ``clusters`` x
    ``dims`` numbers, which may be 64 MB at most.
    """
    if clusters * dims * 8 > MOST_BYTES or dims * (2 * LARGEST) ** 2 > 2**63:
        raise ValueError("too many centroids to broadcast, or too many dimensions for 64-bit distances")
    spark = vectors.sparkSession
    x = F.when(F.size(vector_col) == dims, whole(F.col(vector_col), scale))
    ints = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where("x is not null")
    fits = F.forall("x", lambda v: F.abs(v) < LARGEST)
    ints = staged(ints.select("id", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component reaches 2^27")).cast("array<bigint>")).alias("x")), "centroid-vectors")
    first = ints.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(clusters)
    points = np.array([r["x"] for r in first.collect()], np.int64).reshape(-1, dims)

    for _ in range(rounds if len(points) else 0):
        shared = spark.sparkContext.broadcast(VantageTree(points))
        sums = ints.select("x").mapInArrow(_summing(shared, dims), "cluster int, dim int, total long, n long")
        exact = F.sum(F.col("total").cast("decimal(38,0)"))
        found = sums.groupBy("cluster", "dim").agg(exact.alias("total"), F.sum("n").alias("n")).collect()
        points = points.copy()
        for r in found:
            points[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        shared.unpersist()

    shared = spark.sparkContext.broadcast(VantageTree(points))
    kind = ints.schema["id"].dataType.simpleString()
    assigned = staged(ints.mapInArrow(_assigning(shared, dims), f"id {kind}, cluster int, distance long"), "centroid-assigned")
    unstage(ints)
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(c, inertia[c], sum(inertia.values()), points[c].tolist()) for c in sorted(inertia)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    name = free_name(about.drop("centroid").withColumn("distance", F.lit(0)), id_col)
    # one row for each cluster
    return assigned.withColumnRenamed("id", name).join(F.broadcast(about), "cluster").select(name, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _summing(shared, dims: int):
    def run(batches):
        tree = shared.value
        totals, counts = np.zeros((len(tree.points), dims), np.int64), np.zeros(len(tree.points), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                x = matrix(batch.column("x").slice(at, TOGETHER), dims, np.int64)
                found = tree.nearest(x)[0]
                for c in np.unique(found):
                    totals[c] += x[found == c].sum(axis=0)
                    counts[c] += np.count_nonzero(found == c)
        full = np.nonzero(counts)[0]
        columns = (np.repeat(full, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(full)), totals[full].ravel(), np.repeat(counts[full], dims))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dim", "total", "n"])

    return run


def _assigning(shared, dims: int):
    def run(batches):
        tree = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found, best, _ = tree.nearest(matrix(part.column("x"), dims, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return run
