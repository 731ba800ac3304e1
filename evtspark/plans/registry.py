"""Where the plan modules register their queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The events table as points: session, unit, seconds since 2024-01-01, value.
PTS = """pts AS (SELECT event_id AS id, user_id AS session, event_type AS unit,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE AS t, value AS v FROM events)"""
REFS = "refs AS (SELECT * FROM pts WHERE unit = 'purchase')"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a point and signal table."""
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - base) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("event_type").alias("unit"), t.alias("t"), F.col("value").alias("v")
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("unit = 'purchase'")


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def first_component(name: str, start: str, key: str, n: int, steps: int = 24) -> str:
    """SQL of ``name``(key, v): first eigenvector of ``start``'s n by n matrices ``m`` (lists by rows), its largest part positive, by squaring."""
    row = lambda e: f"m[({e}) * {n} + 1 : ({e}) * {n} + {n}]"
    return f"""{name}_p AS (SELECT {key}, 0 AS k, m FROM {start} UNION ALL SELECT {key}, k + 1, list_transform(sq, lambda x: x / list_sum(list_transform(range(0, {n}), lambda i: sq[i * {n + 1} + 1])))
  FROM (SELECT {key}, k, list_transform(range(0, {n * n}), lambda e: list_dot_product({row(f"e // {n}")}, {row(f"e % {n}")})) AS sq FROM {name}_p WHERE k < {steps}) q),
 {name}_d AS (SELECT {key}, m, list_transform(range(0, {n}), lambda i: m[i * {n + 1} + 1]) AS d FROM {name}_p WHERE k = {steps}),
 {name} AS (SELECT {key}, list_transform(range(0, {n}), lambda i: m[i * {n} + list_position(d, list_max(d))] / sqrt(list_max(d))) AS v FROM {name}_d)"""
