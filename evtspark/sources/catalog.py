"""Reading, changing and writing the session catalogue and the files around it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evtspark.schemas import MAIN, SESSIONS


def read_catalog(spark: SparkSession, path: str, schema: T.StructType = SESSIONS, dates: tuple[str, ...] = ("expDate",)) -> DataFrame:
    """Session tables of all subjects, one CSV per subject folder ``subject=...``: text columns, dates with - and lower case."""
    out = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    return out.withColumns({c: F.lower(F.regexp_replace(c, "_", "-")) for c in dates if c in out.columns})


def write_catalog(df: DataFrame, path: str) -> None:
    df.select([F.col(c).cast("string") for c in df.columns]).write.partitionBy("subject").mode("overwrite").csv(path, header=True)


def read_main(spark: SparkSession, path: str, schema: T.StructType = MAIN) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_objects(spark: SparkSession, root: str, wanted: dict[str, dict[str, list[str] | str]], sessions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Parquet objects ``root/collection/object`` with the asked-for attributes ('all' or names), of the given sessions."""
    out = {}
    for collection, objects in wanted.items():
        for name, attrs in objects.items():
            df = spark.read.parquet(f"{root}/{collection}/{name}")
            keys = ["session"] if "session" in df.columns else []
            if attrs != "all":
                df = df.select(*keys, *[a for a in attrs if a not in keys])
            if sessions is not None and keys:
                df = df.join(sessions.select("session").distinct(), "session", "left_semi")
            out[f"{collection}.{name}"] = df
    return out


def read_arrays(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, i, value): one-dimensional numpy files, one task's rows per file; n x 1 arrays are flattened."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def load(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1)
                for at in range(0, len(a), 1 << 20):
                    part = a[at : at + (1 << 20)]
                    yield pd.DataFrame({"path": path, "i": np.arange(at, at + len(part)), "value": part.astype(float)})

    return files.mapInPandas(load, "path string, i long, value double")


def write_trials(df: DataFrame, path: str, keys: list[str], max_columns: int = 4, share: float = 0.75) -> list[str]:
    """Split a trial table by columns: arrays go to ``path/large``, then, while more than ``max_columns`` are left and
    the largest fifth of them holds over ``share`` of the bytes, the largest one. Returns the moved columns."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    rest = [c for c in df.columns if c not in arrays and c not in keys]
    sizes = df.agg(*[F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in rest]).first().asDict() if rest else {}
    moved = list(arrays)
    while len(rest) > max_columns:
        ordered = sorted(rest, key=lambda c: (-sizes[c], c))
        top = ordered[: max(1, len(rest) // 5)]
        if sum(sizes[c] for c in top) <= share * max(sum(sizes[c] for c in rest), 1):
            break
        moved.append(ordered[0])
        rest.remove(ordered[0])
    df.select(*keys, *rest).write.mode("overwrite").parquet(f"{path}/main")
    if moved:
        df.select(*keys, *moved).write.mode("overwrite").parquet(f"{path}/large")
    return moved


def read_trials(spark: SparkSession, path: str, keys: list[str], full: bool = False) -> DataFrame:
    """The main part of a split trial table, with the large columns if ``full``."""
    main = spark.read.parquet(f"{path}/main")
    return main.join(spark.read.parquet(f"{path}/large"), keys, "left") if full else main


def fetch_errors(catalog: DataFrame, messages: DataFrame, steps: list[str], keys: list[str]) -> DataFrame:
    """(keys, step, message): a row per step whose status is '2', with its message if there is one."""
    failed = catalog.unpivot(keys, steps, "step", "status").where(F.col("status") == "2").drop("status")
    return failed.join(messages, [*keys, "step"], "left")


def _local(path: str) -> str:
    return re.sub("^file:/+", "file:///", path)


def read_interleaved(spark: SparkSession, path: str, n_chan: int, samples: int = 1_000_000) -> DataFrame:
    """(path, sample, channel, v): little-endian int16 samples, channels interleaved, numbered from 0 in each file under ``path``.

    Files of any length are read in parts of ``samples`` samples, each by its own
    task; bytes after the last whole sample are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    whole = F.floor(F.col("length") / (2 * n_chan))
    parts = files.where(whole > 0).select("path", whole.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(samples).cast("long"))).alias("first"))

    def split(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for name, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = fs.FileSystem.from_uri(_local(name))
                with system.open_input_file(inner) as f:
                    m = np.frombuffer(f.read_at(2 * n_chan * min(samples, n - first), 2 * n_chan * first), "<i2").astype(np.int32)
                rows = len(m) // n_chan
                cols = [pa.array([name]).take(pa.array(np.zeros(len(m), np.int64))), pa.array(first + np.repeat(np.arange(rows), n_chan)), pa.array(np.tile(np.arange(n_chan, dtype=np.int32), rows)), pa.array(m)]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "sample", "channel", "v"])

    return parts.repartition("path", "first").mapInArrow(split, "path string, sample long, channel int, v int")


def write_interleaved(df: DataFrame, file: str, order: str, channels: list[str], path: str) -> DataFrame:
    """(file, n): one ``.bin`` file of int16 samples per value of ``file``, by ``order``; a recording's samples are written by one task."""

    def put(pdf):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        name = str(pdf[file].iloc[0])
        system, inner = fs.FileSystem.from_uri(_local(path))
        system.create_dir(inner, recursive=True)
        own = pdf.sort_values(order)[channels].to_numpy().astype("<i2")
        with system.open_output_stream(f"{inner}/{name}.bin") as f:
            f.write(np.ascontiguousarray(own).tobytes())
        return pd.DataFrame({"file": [name], "n": [len(own)]})

    return df.groupBy(file).applyInPandas(put, "file string, n long")


def apply_gain(samples: DataFrame, gains: DataFrame, volts_per_bit: float) -> DataFrame:
    """``volts`` from the raw value and the channel's gain (a row per channel)."""
    return samples.join(gains, "channel").withColumn("volts", F.col("v") * volts_per_bit / F.col("gain"))


def read_keyvalue(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta): lines ``key=value`` of each file as a map; a leading ~ of a key is dropped."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_replace(F.substring_index(x, "=", 1), "^~", "").alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    return text.select("path", F.map_from_entries(pairs).alias("meta"))


def unpack_bits(samples: DataFrame, word: str, lines: list[int]) -> DataFrame:
    """A 0/1 column ``line<k>`` per digital line of a word."""
    return samples.withColumns({f"line{k}": F.shiftright(F.col(word), k).bitwiseAND(F.lit(1)).cast("int") for k in lines})


def upsert_catalog(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys, by date and number where there are such columns."""
    both = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    order = [c for c in ("subject", "expDate") if c in both.columns] + [F.col("expNum").cast("double") for _ in range("expNum" in both.columns)]
    return both.orderBy(*order) if order else both


def delete_rows(catalog: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``catalog`` without the rows whose keys are listed; keys are compared whole."""
    return catalog.join(gone.select(*keys).distinct(), keys, "left_anti")


def discover_new(listing: DataFrame, catalog: DataFrame, keys: list[str], server: str, size: str) -> DataFrame:
    """(keys, server, bytes): session folders not in the catalogue; of copies the one with the most bytes."""
    total = listing.groupBy(*keys, server).agg(F.sum(size).alias("bytes"))
    w = Window.partitionBy(*keys).orderBy(F.desc("bytes"), server)
    best = total.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.join(catalog.select(*keys).distinct(), keys, "left_anti")


def probe_status(listing: DataFrame, keys: list[str], file: str, age_days: Column, rules: dict[str, tuple[str, str | None]], young: int = 7) -> DataFrame:
    """(keys, status columns): '1' if a file matches the done pattern, '2' if one matches the error pattern, '0' while the session is young, else 'NaN'."""
    has = lambda pattern: F.max(F.col(file).rlike(pattern).cast("int")) == 1
    age = F.min(age_days)
    cols = []
    for name, (done, error) in rules.items():
        c = F.when(has(done), "1")
        if error:
            c = c.when(has(error), "2")
        cols.append(c.when(age < young, "0").otherwise("NaN").alias(name))
    return listing.groupBy(*keys).agg(*cols)


def named_cohort(catalog: DataFrame, members: list[tuple], keys: list[str]) -> DataFrame:
    """Rows of the catalogue whose keys are listed (a short literal list)."""
    rows = catalog.sparkSession.createDataFrame(members, ", ".join(f"{k} {catalog.schema[k].dataType.simpleString()}" for k in keys))
    return catalog.join(F.broadcast(rows.distinct()), keys, "left_semi")


def save_selection(df: DataFrame, keys: list[str], path: str) -> None:
    df.select(*keys).distinct().write.mode("overwrite").csv(path, header=True)


def load_selection(catalog: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Rows of the catalogue whose keys were saved."""
    schema = T.StructType([catalog.schema[k] for k in keys])
    return catalog.join(catalog.sparkSession.read.csv(path, schema=schema, header=True), keys, "left_semi")


def stage_queue(queue: DataFrame, candidates: DataFrame, key: str, tag: str = "tag") -> DataFrame:
    """The queue without done rows (tag 1) and with new candidates at tag 0; of equal keys the queue's row stays."""
    waiting = queue.where(F.col(tag) != 1).select(key, tag, F.lit(0).alias("_p"))
    both = waiting.unionByName(candidates.select(key, F.lit(0).cast(queue.schema[tag].dataType).alias(tag), F.lit(1).alias("_p")))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_p", tag))).where("_r = 1").drop("_p", "_r")


def write_versioned(df: DataFrame, path: str, stamp: str) -> str:
    """Write to ``path/version=stamp``; older versions stay, readers take the last."""
    out = f"{path}/version={stamp}"
    df.write.mode("overwrite").parquet(out)
    return out


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    last = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == last).drop("version")


def collect_fits(spark: SparkSession, root: str) -> DataFrame:
    """All sessions' saved fits as one table, from Parquet partitioned by session."""
    return spark.read.option("mergeSchema", "true").parquet(root)


def compare_trees(a: DataFrame, b: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, status): same, different or missing on one side, by MD5 of contents (``binaryFile`` tables with relative paths)."""
    left, right = a.select(path, F.md5(content).alias("_a")), b.select(path, F.md5(content).alias("_b"))
    both = left.join(right, path, "full")
    return both.select(path, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") == F.col("_b"), "same").otherwise("different").alias("status"))
