"""Streaming forms of incremental operators, as file-source jobs that end when the input is read.

Each job's result is written by foreachBatch; ``collect`` runs a stream with
``availableNow`` and gives back what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtspark.schemas import EVENTS
from evtspark.sources.catalog import upsert_catalog
from evtspark.staging import workspace


def event_stream(spark: SparkSession, sf_dir: str, files: str = "events.parquet", at_once: int = 1000) -> DataFrame:
    """The events table as a stream of its files, ``at_once`` a batch, ``ts`` as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).option("maxFilesPerTrigger", at_once).parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def collect(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is; the rows of all batches (append, update) or of the last one (complete)."""
    spark = stream.sparkSession
    folder = workspace(spark)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out") if mode == "complete" else spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").drop("batch")
    return out


def gap_sessions(stream: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    """Runs of events whose gaps are under ``gap``; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def window_counts(stream: DataFrame, by: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """(by, start, n, rms) per tumbling or sliding window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")).select(*by, F.col("w.start").alias("start"), "n", "rms")


def hysteresis(stream: DataFrame, key: str | list[str], low: float, high: float) -> DataFrame:
    """(key, ts, state): flips between above ``high`` (1) and below ``low`` (-1); ``key`` is one column or several, as session and channel.

    A key's last state and last time are kept between batches. Its rows of one batch
    are taken by time; rows before the last time of an earlier batch come too late
    and change nothing.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    keys = [key] if isinstance(key, str) else key
    kinds = {k: stream.schema[k].dataType.simpleString() for k in keys}

    def step(own, batches, state):
        last, seen = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        times = rows["ts"].astype("datetime64[us]").astype("int64")
        if seen is not None:
            rows, times = rows[times >= seen], times[times >= seen]
        out = []
        for ts, v in zip(rows["ts"], rows["value"], strict=True):
            now = 1 if v > high else -1 if v < low else last
            if now != last and last != 0:
                out.append((*own, ts, now))
            last = now
        state.update((last, int(times.max()) if len(times) else seen))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "ts", "state"])

    schema = ", ".join(f"{k} {t}" for k, t in kinds.items())
    return stream.groupBy(*keys).applyInPandasWithState(step, f"{schema}, ts timestamp, state int", "last int, seen long", "append", GroupStateTimeout.NoTimeout)


def interval_join(points: DataFrame, trials: DataFrame, key: str, span: str, late: str) -> DataFrame:
    """Points within ``span`` after a trial's start, both sides watermarked."""
    p = points.withWatermark("ts", late).select(F.col(key).alias("_k"), F.col("event_id").alias("point"), F.col("ts").alias("_t"))
    t = trials.withWatermark("ts", late).select(key, F.col("event_id").alias("trial"), F.col("ts").alias("_t0"))
    return p.join(t, F.expr(f"_k = {key} AND _t >= _t0 AND _t <= _t0 + INTERVAL {span}")).select("trial", "point")


def discover(stream: DataFrame, keys: list[str], catalog_path: str) -> None:
    """Upsert every batch of newly seen sessions into the catalogue, version by version."""
    spark = stream.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        new = batch.groupBy(*keys).agg(F.count("*").alias("n_files"))
        old = spark.read.parquet(f"{catalog_path}/v={n - 1}") if n else new.limit(0)
        upsert_catalog(old, new, keys).write.mode("overwrite").parquet(f"{catalog_path}/v={n}")

    stream.writeStream.option("checkpointLocation", f"{catalog_path}-checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
