"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import chunks

#: Hashed feature space; the L1 term leaves a small share of it non-zero.
SPACE_BITS = 20
#: Bound of the labelled rows that the model is fitted on, drawn by hash of doc_id.
MAX_TRAIN = 16_000
EPOCHS = 4
#: FTRL-proximal's learning rate, smoothing and penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 500_000
#: The bias where there was nothing to learn from.
UNKNOWN = -35.0


class Features:
    """Distinct hashed unigrams, bigrams and one-word skip-grams of a text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        own = WORD.findall(text.lower()) if text else []
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in own:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        grams = np.concatenate([h * a, (h[:-1] * b) ^ (h[1:] * a), (h[:-2] * c) ^ (h[2:] * b)])
        return (grams >> np.uint64(64 - SPACE_BITS)).astype(np.int32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in chunks(batches, 256):
        got = [np.unique(features(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["id", "label", "at"])


def fit(examples: list[tuple[float, np.ndarray]], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, positions, weights): per-coordinate rates, L1 keeps the weights sparse. The order of examples decides."""
    z, n = np.zeros(1 << SPACE_BITS), np.zeros(1 << SPACE_BITS)
    zb = nb = 0.0

    def weight(z_: np.ndarray, n_: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for _ in range(epochs):
        for y, at in examples:
            zi, ni = z[at], n[at]
            w, wb = weight(zi, ni, L1), float(weight(np.float64(zb), np.float64(nb), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            rate = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - rate * w, ni + g * g
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * wb, nb + g * g
    w = weight(z, n, L1)
    at = np.flatnonzero(w)
    return float(weight(np.float64(zb), np.float64(nb), 0.0)), at, w[at]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = [(float(y), np.asarray(at, np.int64)) for b in batches for y, at in zip(b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), strict=True)]
    if not examples:
        return
    bias, at, w = fit(examples)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[bias, w])], names=["at", "w"])


def held_out(ident: F.Column) -> F.Column:
    """Rows that are never learnt from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, object]:
    """Weights learnt from at most ``max_train`` labelled rows that are not held out.

    Rows with a null id or label are not learnt from; of rows with the same id the
    label is the largest. Without any row to learn from nothing is known to be
    toxic: all scores are near 0 and ``keep`` keeps every row. Features are made in parallel; the bounded sample is
    then passed through one task, in the order of a hash of the id.
    """
    mark = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
    mark = mark.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    mark = mark.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(F.broadcast(mark), "id").select("id", "label", "text")  # max_train rows of 12 bytes
    made = rows.mapInArrow(_extract, "id long, label int, at array<int>")
    one = made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", F.xxhash64("at"))
    got = one.mapInArrow(_train, "at long, w double").toArrow()
    at, w = got.column("at").to_numpy(), got.column("w").to_numpy()
    bias = float(w[at < 0][0]) if (at < 0).any() else UNKNOWN
    return {"bias": bias, "at": at[at >= 0], "w": w[at >= 0]}


def _score(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    features, m = Features(), model.value
    weights = np.zeros(1 << SPACE_BITS)
    weights[m["at"]] = m["w"]
    for batch in chunks(batches):
        out = []
        for text in batch.column(1):
            at = features(text.as_py())
            at = np.unique(at[weights[at] != 0])
            out.append(1 / (1 + np.exp(-np.clip(weights[at].sum() + m["bias"], -35, 35))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])


def score(docs: DataFrame, model: dict[str, object], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per row, 0 to 1. Null and empty texts score as the bias alone."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=known), "id long, score double")


def keep(docs: DataFrame, model: dict[str, object], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``, all columns kept as they are."""
    known, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index(text_col)
    return docs.mapInArrow(partial(_keep, model=known, at=at, threshold=threshold), schema)


def _keep(batches: Iterator[pa.RecordBatch], model: object, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        text = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["id", "text"])
        for scored in _score([text], model):
            low = scored.column(1).to_numpy(zero_copy_only=False) < threshold
            yield batch.filter(pa.array(low))
