"""Approximate nearest neighbours by a permutation index.

A vector stands for the order of its nearest pivots. Vectors are dealt by their id
into blocks of bounded size; in a block each vector is posted, with the pivot's
place in its order, in the inverted files of its ``posted`` nearest pivots. A query
reads the files of its own ``probed`` nearest pivots and sums up, for each vector
found, ``posted`` less the difference of the two places: that is the footrule
distance, turned round, where a pivot beyond a prefix counts as the place after it.
The best ``share`` of the block, ties with the last included, and all that come
close to the block's k-th best are ranked again by the inner product in double
precision. Every row is in the index; only the pivots are of a bounded sample.

One more coordinate gives all vectors one length, so that the nearest by angle have
the largest inner product whatever the lengths were. Queries visit every block
(their number times the number of blocks is what is exchanged), vectors move once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Distinct vectors, at most, that the pivots are taken from, and the cosine over which two pivots say the same.
SAMPLE, APART = 4096, 0.8
#: Rows of a block: at least and at most. Between, a table has 64 blocks.
LEAST_ROWS, MOST_ROWS, BLOCKS = 4096, 65_536, 64
#: Vectors whose footrule gain comes this close to the block's k-th best are ranked again beyond the share.
CLOSE = 0.8
#: Vectors of a block that are ranked again at least, times k.
DEPTH = 40


def valid_vectors(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``: vectors of ``dim`` finite components and a length that is neither zero nor infinite, with an id."""
    given = vectors[vector_col]
    kind = vectors.schema[vector_col].dataType
    v = given if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else given.cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null").where((F.size("v") == dim) & finite)
    return rows.withColumn("square", square).where((F.col("square") > 0) & (F.col("square") < float("inf")))


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors of one coordinate more: what a vector lacks to the longest one's length."""
    unit = x / longest
    return np.c_[unit, np.sqrt(np.maximum(1 - (unit * unit).sum(1), 0))]


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Unit vectors in the order given, those first that lie apart from the ones before."""
    taken, nearest = [], np.full(len(sample), -1.0)
    for limit in (APART, 1 - 1e-9):
        for i in range(len(sample)):
            if len(taken) == number:
                break
            if nearest[i] < limit:
                taken.append(i)
                nearest = np.maximum(nearest, sample @ sample[i])
    return sample[taken]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, number: int) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :number]


class Block:
    """Pivot inverted files over the vectors of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, longest: float, posted: int):
        order = np.argsort(ids, kind="stable")
        order = order[np.r_[True, np.diff(ids[order]) != 0]]  # of rows with one id the first, as they come sorted
        self.ids, self.x, self.posted = ids[order], np.ascontiguousarray(x[order]), min(posted, len(pivots))
        near = nearest_pivots(lengthened(self.x, longest), pivots, self.posted).ravel()
        by_pivot = np.argsort(near, kind="stable")
        edge = np.searchsorted(near[by_pivot], np.arange(1, len(pivots)))
        self.rows = np.split(by_pivot // self.posted, edge)
        self.places = np.split((by_pivot % self.posted).astype(np.int32), edge)

    def gains(self, order: np.ndarray) -> np.ndarray:
        """Footrule gain of every row for a query's pivots in their order."""
        rows = [self.rows[p] for p in order]
        place = np.repeat(np.arange(len(order), dtype=np.int32), [len(r) for r in rows])
        gain = self.posted - np.abs(np.concatenate([self.places[p] for p in order]) - place)
        return np.bincount(np.concatenate(rows), weights=gain, minlength=len(self.ids))

    def search(self, query: int, q: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's k best among the candidates."""
        n = len(self.ids)
        gain = self.gains(order)
        own = np.searchsorted(self.ids, query)
        if own < n and self.ids[own] == query:
            gain[own] = -1
        depth = max(DEPTH * k, math.ceil(share * n))
        if depth < n:
            at = np.partition(gain, (n - depth, n - k))
            near = np.flatnonzero(gain >= max(0, min(at[n - depth], CLOSE * at[n - k])))
        else:
            near = np.flatnonzero(gain >= 0)
        x = self.x[near]
        score = x @ q
        if len(near) > k:  # close to the k-th: products summed in one way, so that equal vectors have equal scores
            last = np.partition(score, len(near) - k)[len(near) - k]
            keep = score >= last - 1e-9 * max(abs(last), np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1).max()))
            near, x = near[keep], x[keep]
        score = (x * q).sum(1)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][best], score[best]


def _search(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, longest: float, k: int, posted: int, probed: int, share: float) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (block, is a query, id): a block's vectors are held and indexed, its queries stream past them."""
    now, index, held, last = None, None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column(0).to_numpy()
        asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        ids = batch.column(2).to_numpy()
        x = batch.column(3).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edge = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for a, z in zip(np.r_[0, edge], np.r_[edge, len(ids)], strict=True):
            if number[a] != now:
                now, index, held, last = number[a], None, [], None
            if not asks[a]:
                held.append((ids[a:z], x[a:z]))
                continue
            if index is None:
                if not held:
                    continue
                index, held = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pivots, longest, posted), []
            q = x[a:z]
            unit = q / np.sqrt((q * q).sum(1, keepdims=True))
            order = nearest_pivots(np.c_[unit, np.zeros(len(q))], pivots, probed)
            for query, vector, own in zip(ids[a:z], q, order, strict=True):
                if query != last:  # of query rows with one id the first
                    found, score = index.search(query, vector, own, k, share)
                    out.append((np.full(len(found), query), found, score))
                last = query
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = 256, posted: int = 64, probed: int = 32, share: float = 3 / 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows found, by inner product, ties to the smaller id.

    ``is_query`` marks the queries by the column ``id``; all rows are candidates but
    those with the query's own id. Vectors that are null, zero, of another number of
    components or with null or non-finite ones take no part, nor do rows without an
    id. Of rows with one id the one with the least vector counts. Equal vectors have
    equal scores. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, dim, id_col, vector_col)
    n, square = rows.agg(F.count("*"), F.max("square")).first()
    longest = math.sqrt(square or 1.0) * (1 + 1e-12)
    rows = rows.select("id", "v")
    thinned = rows.select("v", F.xxhash64("v").alias("h")).where(F.pmod("h", F.lit(max(1, n // (SAMPLE // 2)))) == 0).distinct()
    sample = thinned.orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    points = np.array(sample["v"].to_pylist(), np.float64).reshape(-1, dim)
    chosen = choose_pivots(lengthened(points, longest), pivots)
    blocks = max(1, math.ceil(n / min(MOST_ROWS, max(LEAST_ROWS, n // BLOCKS))))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    held = rows.select(block.alias("block"), F.lit(False).alias("asks"), "id", "v")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v")
    cells = held.union(asked).repartition(min(blocks, 4096), "block").sortWithinPartitions("block", "asks", "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, chosen, longest, k, posted, probed, share)

    found = cells.mapInArrow(search, "query_id long, vec_id long, score double") if n else spark.createDataFrame([], "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
