"""Shards of near-equal bytes by histogram sort.

The key of a row is (XXH64 of its text, id), so copies of a text are neighbours.
Each round counts, over all rows, the exact bytes below some probe keys per shard
border and narrows the border's interval around its share of the bytes; rounds end
when every border is within the tolerance. A border cuts a group of equal texts
only if the group is larger than a quarter of a shard (the shards' sizes come
first); beside a smaller one the border goes to
the nearer edge of the group, and the borders between two such are spaced anew.
Then the rows are exchanged once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtspark.llm.common import chunks, stage

LOW = -(1 << 63)
TOP = 1 << 128
#: Tasks of the exchange at most; beyond it they grow.
MAX_TASKS = 50_000


def _pair(key: int) -> tuple[int, int]:
    """A key as (text hash, id), both signed 64-bit."""
    return (key >> 64) + LOW, (key & ((1 << 64) - 1)) + LOW


def _below(hashes: np.ndarray, ids: np.ndarray, probe_h: np.ndarray, probe_id: np.ndarray) -> np.ndarray:
    """Number of sorted probes at or below each row's key."""
    first, last = np.searchsorted(probe_h, hashes, "left"), np.searchsorted(probe_h, hashes, "right")
    out = first.copy()
    for a in np.unique(first[last > first]):
        rows = np.flatnonzero((first == a) & (last > first))
        out[rows] = a + np.searchsorted(probe_id[a : last[rows[0]]], ids[rows], "right")
    return out


def _count(batches: Iterator[pa.RecordBatch], probes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    probe_h, probe_id = np.array(probes, np.int64).reshape(-1, 2).T
    total = np.zeros(len(probes) + 1, np.int64)
    for batch in chunks(batches, 65536):
        h, i, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        np.add.at(total, _below(h, i, probe_h, probe_id), size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "bytes"])


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.01, probes: int = 48, whole: float = 0.25) -> list[tuple[int, int]]:
    """Borders (hash, id) of ``keys(h, id, size)``: a row is in the shard numbered by the borders at or below its key.

    ``tolerance`` and ``whole``, the size up to which groups of equal texts are not
    cut, are shares of one shard's bytes. Only the counts between probes,
    at most shards * probes numbers, come to the driver.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    known: dict[int, int] = {0: 0, TOP: total}  # bytes below all keys probed so far
    at_edge: dict[int, int] = {}  # borders that a group holds, and their keys
    while True:
        fixed = sorted({0: 0, shards: total, **{b: known[k] for b, k in at_edge.items()}}.items())
        goal = np.interp(range(shards + 1), *zip(*fixed, strict=True)).tolist()
        done = _refine(keys, goal, known, at_edge, tolerance * total / shards, whole * total / shards, probes)
        new = {b: key for b, (key, held) in done.items() if held and b not in at_edge}
        at_edge.update(new)
        if not new:
            borders = {b: key for b, (key, _) in done.items()} | at_edge
            ordered = np.maximum.accumulate([borders[b] for b in range(1, shards)]).tolist() if shards > 1 else []
            return [_pair(min(k, TOP - 1)) for k in ordered]


def _refine(keys: DataFrame, goal: list[float], known: dict[int, int], at_edge: dict[int, int], near: float, most: float, probes: int) -> dict[int, tuple[int, bool]]:
    """(key, whether a group holds the border) of every border: a key within ``near`` bytes of the goal, or the nearer edge of the group, of up to ``most`` bytes, that it falls in."""
    done: dict[int, tuple[int, bool]] = {b: (k, True) for b, k in at_edge.items()}
    while True:
        order = sorted(known)
        below = [known[k] for k in order]
        asked: set[int] = set()
        for b in range(1, len(goal) - 1):
            if b in done:
                continue
            z = bisect.bisect_right(below, goal[b])
            z = min(max(z, 1), len(order) - 1)
            low, high = order[z - 1], order[z]
            best = min((low, high), key=lambda k: abs(known[k] - goal[b]))
            one_group = high - low <= 1 << 64
            if abs(known[best] - goal[b]) <= near or high - low <= 1:
                done[b] = (best, False)
            elif one_group and low % (1 << 64) == 0 and known[high] - known[low] <= most:
                done[b] = (best, True)
            else:
                step = 1 if one_group else 1 << 64  # whole groups first, then ids within one that may be cut
                width = (high - low) // step
                asked |= {low + step * (width * (k + 1) // (probes + 1)) for k in range(probes)} - {low}
                if one_group and low % (1 << 64):
                    asked.add(low - low % (1 << 64))
        if not asked - known.keys():
            return done
        new = sorted(asked - known.keys())
        found = keys.mapInArrow(partial(_count, probes=[_pair(k) for k in new]), "bucket long, bytes long")
        got = found.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).toArrow()
        counts = np.zeros(len(new) + 1, np.int64)
        counts[got.column("bucket").to_numpy()] = got.column("bytes").to_numpy()
        known.update(zip(new, np.cumsum(counts).tolist(), strict=False))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, task_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    size: UTF-8 bytes of the text plus 16; a null text counts as empty, a null id
    as the smallest. Repeated rows each get a slot of their own. Columns named
    size, shard or slot in the input are replaced; others are kept. Slots are
    numbered in tasks of about ``task_bytes``, up to ``MAX_TASKS`` of them. An
    empty table gives no rows.
    """
    text, ident = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[id_col].cast("long"), F.lit(LOW))
    size = F.octet_length(text).cast("long") + 16
    h = F.xxhash64(text)
    keys = stage(docs.select(h.alias("h"), ident.alias("id"), size.alias("size")))
    borders = splitters(keys, shards, tolerance)

    def place(h_: F.Column, id_: F.Column) -> F.Column:
        out = F.lit(0)
        for bh, bi in borders:
            out = out + ((h_ > F.lit(bh)) | ((h_ == F.lit(bh)) & (id_ >= F.lit(bi)))).cast("int")
        return out

    most = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-min(most // task_bytes, MAX_TASKS) // shards))
    part = lambda h_, id_: F.pmod(F.xxhash64(h_, id_, F.lit(1)), F.lit(parts))
    counts = keys.select(place(F.col("h"), F.col("id")).alias("shard"), part(F.col("h"), F.col("id")).alias("_part"))
    counts = counts.groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))

    rows = docs.withColumns({"size": size, "shard": place(h, ident), "_part": part(h, ident), "_h": h, "_id": ident})
    rows = rows.repartition(max(shards * parts, 1), "shard", "_part")  # the one exchange; its number of tasks is not left to merging
    within = Window.partitionBy("shard", "_part").orderBy("_h", "_id")
    rows = rows.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    rows = rows.join(F.broadcast(counts) if shards * parts <= 2 * MAX_TASKS else counts, ["shard", "_part"])
    return rows.withColumn("slot", F.col("slot") + F.col("_before")).drop("_part", "_h", "_id", "_before")
