"""Streams of several batches: state goes on, late rows are dropped, sessions are upserted."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evtspark.schemas import EVENTS
from evtspark.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def batches(spark, tmp_path):
    """Writes each list of (minutes, user, type, value) as a file; files are read one a batch, in order of writing."""

    def write(*parts):
        import os
        import shutil

        from pyspark.sql.types import StructType

        schema = EVENTS if isinstance(EVENTS, StructType) else spark.createDataFrame([], EVENTS).schema
        for k, rows in enumerate(parts):
            named = [{"event_id": 100 * k + i, "ts": START + dt.timedelta(minutes=m), "user_id": u, "event_type": e, "value": float(v), "props": None} for i, (m, u, e, v) in enumerate(rows)]
            spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in named], schema).coalesce(1).write.parquet(f"file://{tmp_path}/b{k}")
            part = next(f for f in os.listdir(tmp_path / f"b{k}") if f.endswith(".parquet"))
            (tmp_path / "in").mkdir(exist_ok=True)
            shutil.copy(tmp_path / f"b{k}" / part, tmp_path / "in" / f"part{k}.parquet")
            os.utime(tmp_path / "in" / f"part{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
        return jobs.event_stream(spark, f"file://{tmp_path}/in", "*.parquet", at_once=1)

    return write


def test_hysteresis_keeps_state_and_time_per_session_and_channel(batches):
    stream = batches(
        [(0, 1, "x", 90), (1, 1, "x", 50), (0, 1, "y", 10), (0, 2, "x", 90)],
        [(2, 1, "x", 10), (2, 1, "y", 50), (3, 2, "x", 95)],
        [(1, 1, "x", 95), (4, 1, "x", 90), (5, 1, "y", 90)],  # the first comes too late
    )
    flips = jobs.collect(jobs.hysteresis(stream, ["user_id", "event_type"], 20.0, 80.0)).collect()
    assert sorted((r.user_id, r.event_type, (r.ts.replace(tzinfo=None) - START).seconds // 60, r.state) for r in flips) == [(1, "x", 2, -1), (1, "x", 4, 1), (1, "y", 5, 1)]


def test_gap_sessions_end_and_late_rows_go(batches):
    stream = batches(
        [(0, 1, "x", 1), (20, 1, "x", 1), (0, 2, "x", 1)], [(600, 1, "x", 1)], [(605, 1, "x", 1)], [(30, 1, "x", 1), (610, 1, "x", 1)], [(2000, 2, "x", 1)], [(2001, 2, "x", 1)],
    )
    out = jobs.collect(jobs.gap_sessions(stream, ["user_id"], "1 hour", "2 hours"), "append").collect()
    assert sorted((r.user_id, (r.start.replace(tzinfo=None) - START).total_seconds() // 60, r.n) for r in out) == [(1, 0, 2), (1, 600, 3), (2, 0, 1)]


def test_discovery_upserts_batch_by_batch(spark, batches, tmp_path):
    stream = batches([(0, 1, "x", 1), (1, 1, "x", 1), (2, 2, "x", 1)], [(3, 2, "x", 1), (4, 3, "y", 1)])
    path = f"file://{tmp_path}/catalog"
    jobs.discover(stream, ["user_id", "event_type"], path)
    read = lambda v: sorted((r.user_id, r.event_type, r.n_files) for r in spark.read.parquet(f"{path}/v={v}").where(F.col("user_id").isNotNull()).collect())
    assert read(0) == [(1, "x", 2), (2, "x", 1)] and read(1) == [(1, "x", 2), (2, "x", 1), (3, "y", 1)]
