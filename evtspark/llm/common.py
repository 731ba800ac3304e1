"""Helpers that the text operators share: table access, words and materialised steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that one Arrow step hands to numpy at a time; texts of any length stay whole.
CHUNK_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session that names none gets one of its own; on a cluster that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


#: Folders of the steps written in this run, if it keeps account of them; another run, in a thread of its own, has its own list.
STEPS: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders whose rows nothing will read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame) -> DataFrame:
    """Write a step as Parquet in the shared folder and read it back.

    The lineage ends there, so later passes survive the loss of executors and do
    not compute the step again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (steps := STEPS.get()) is not None:
        steps.append(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: An odd base of rolling hashes modulo 2**64, and what undoes a multiplication by it.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers; 0 stays 0."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


@lru_cache(maxsize=2)
def _bases(size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, size), powers(INVERSE, size)


#: Bytes that are hashed at a time, so that the running sums stay in the processor's cache.
HASH_BYTES = 1 << 16


def hash_texts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): a 64-bit hash of every word of all texts in a row, and the number of words of each text.

    A word's bytes are the digits of a number modulo 2**64, taken from running
    sums over the joined texts, so no word becomes a Python object. Equal words have
    equal hashes; different ones can be made that have, so what is taken for equal by
    these is compared by its bytes, or by a hash of its bytes, before it counts.
    """
    hashes, counts, held, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0
    for k, text in enumerate(raw):
        held.append(text)
        size += len(text) + 1
        if size >= HASH_BYTES or k == len(raw) - 1:
            h, n = _hash_joined(held, size)
            hashes.append(h)
            counts.append(n)
            held, size = [], 0
    return np.concatenate(hashes), np.concatenate(counts)


def _hash_joined(raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    up_power, down_power = _bases(1 << max(size + 1, 2 * HASH_BYTES).bit_length())
    joined = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[:-1] != space[1:]) + 1  # words begin and end in turn, as the text begins and ends with a space
    start, stop = edge[::2], edge[1::2]
    up = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined + np.uint64(1)) * up_power[: len(joined)], out=up[1:])
    own = (up[stop] - up[start]) * down_power[start]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    counts = np.diff(np.searchsorted(start, ends + 1, "left"), prepend=0)
    return mix(own + (stop - start).astype(np.uint64) * ODD[4]) | np.uint64(1), counts


def hash_words(items: list[bytes]) -> np.ndarray:
    """XXH64 of each item as unsigned 64-bit."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, items), dtype=np.uint64, count=len(items))
