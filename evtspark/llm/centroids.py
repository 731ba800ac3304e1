"""k-means on integer vectors, with a vantage-point tree over the centroids.

Each round the driver builds a tree of the k centroids and broadcasts it; every
vector searches it best first, by branch and bound, and each task hands on the sums
of its clusters, k rows whatever it has read. All numbers are integers: distances
at the nodes are exact, equal distances go to the smaller number, and a branch is
left out only if it lies farther than the best by more than floating point can be
wrong, so that one at just the best distance is still looked into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import stage

#: Components, as given, are at most so large: 64 squared differences of the integers still fit 64 bits.
LARGEST = 1 << 17
#: More than square roots of 62-bit numbers are wrong by.
SLACK = 1e-5


class VPTree:
    """Nodes hold a centroid each; a node's children are the nearer and the farther half of the rest, each with its range of distances."""

    def __init__(self, centroids: list[list[int]]):
        self.points = np.array(centroids, np.int64)
        self.number: list[int] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self._build(list(range(len(centroids))))

    def _build(self, own: list[int]) -> int:
        node = len(self.number)
        self.number.append(own[0])
        self.children.append([])
        away = ((self.points[own[1:]] - self.points[own[0]]) ** 2).sum(1).tolist()
        rest = sorted(zip(away, own[1:], strict=True))
        half = (len(rest) + 1) // 2
        for part in (rest[:half], rest[half:]):
            if part:
                self.children[node].append((self._build([c for _, c in part]), part[0][0] ** 0.5, part[-1][0] ** 0.5))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid.

        Every row keeps the lower bounds of its open branches and takes the least of
        them; rows that are at one node in a step are looked at together.
        """
        n = len(x)
        best, number, reach = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.number)), np.full(n, np.inf)
        bound = np.full((n, len(self.number)), np.inf)
        bound[:, 0] = 0
        active = np.arange(n)
        while len(active):
            node = bound[active].argmin(1)
            low = bound[active, node]
            near = (low <= reach[active]) & (low < np.inf)
            active, node, low = active[near], node[near], low[near]
            bound[active, node] = np.inf
            for v in np.unique(node).tolist():
                rows, own = active[node == v], self.number[v]
                square = ((x[rows] - self.points[own]) ** 2).sum(1)
                better = (square < best[rows]) | ((square == best[rows]) & (own < number[rows]))
                best[rows[better]], number[rows[better]] = square[better], own
                reach[rows] = np.sqrt(best[rows]) + SLACK
                away = np.sqrt(square)
                for child, least, most in self.children[v]:
                    bound[rows, child] = np.maximum(low[node == v], np.maximum(least - away, away - most))
        return number, best


def _vectors(batch: pa.RecordBatch, tree: VPTree) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, tree.points.shape[1])


def _sums(batches: Iterator[pa.RecordBatch], tree: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per cluster of a task: rows (place -1), distance (place -2) and the sum of every component."""
    k, dim = tree.value.points.shape
    total = np.zeros((k, dim + 2), np.int64)
    for batch in batches:
        x = _vectors(batch, tree.value)
        number, square = tree.value.nearest(x)
        for c in np.unique(number).tolist():
            own = number == c
            total[c] += np.r_[x[own].sum(0), square[own].sum(), own.sum()]
    cluster, place = np.indices(total.shape)
    place = np.where(place < dim, place, place - dim - 2)  # the last two as -2 and -1
    yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(np.int64)) for a in (cluster, place, total)], names=["cluster", "place", "total"])


def _assign(batches: Iterator[pa.RecordBatch], tree: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, square = tree.value.nearest(_vectors(batch, tree.value))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(square)], names=["id", "cluster", "distance"])


def integers(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)``: the floors of ``scale`` times the components, of vectors with ``dim`` finite ones."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
    rows = rows.where((F.size("v") == dim) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    large = F.exists("v", lambda x: F.abs(x) * scale > LARGEST * 1024)
    x = F.when(large, F.raise_error(F.lit(f"a component times the scale is beyond {LARGEST * 1024}"))).otherwise(F.transform("v", lambda c: F.floor(c * scale).cast("int")))
    return rows.select("id", x.alias("x"))


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` per vector with ``dim`` finite components.

    Centroids start as the ``k`` vectors with the least SHA-256 of ``seed:id``
    (fewer, if there are fewer; a null id is written as nothing; of equal ids the
    least vector first). A round assigns all vectors and sets every centroid to the
    floor of its vectors' mean; one without vectors stays. Repeated rows count as
    often as they stand. An empty table gives no rows; other columns are ignored.
    Components of over 2**17 in size at scale 1024 raise an error, as distances
    would not fit a long.
    """
    spark = vectors.sparkSession
    rows = stage(integers(vectors, dim, scale, id_col, vector_col))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    now = [list(r.x) for r in rows.orderBy(order, "x").limit(k).select("x").collect()]
    if not now:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")

    def totals(tree: Broadcast) -> dict[int, dict[int, int]]:
        found: dict[int, dict[int, int]] = {c: {} for c in range(len(now))}
        partial = rows.mapInArrow(lambda batches: _sums(batches, tree), "cluster long, place long, total long")
        for r in partial.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
            found[r.cluster][r.place] = r.total
        return found

    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VPTree(now))
        sums = totals(tree)
        now = [[sums[c][i] // sums[c][-1] for i in range(dim)] if sums[c][-1] else now[c] for c in range(len(now))]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VPTree(now))
    sums = totals(tree)
    inertia = sum(s[-2] for s in sums.values())
    said = spark.createDataFrame([(c, sums[c][-2], inertia, now[c]) for c in range(len(now))], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    placed = rows.mapInArrow(lambda batches: _assign(batches, tree), "id long, cluster int, distance long")
    return placed.join(F.broadcast(said), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

