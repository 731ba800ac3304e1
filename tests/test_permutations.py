"""Shuffles as arrays and by rows: the same results, at many shuffles, and by a plain loop."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from evtspark.operators import stats as st


def h(row, s):
    x = (row * 7919 + 104729) * (s * 2 + 1) * 31 + s * 15485863
    return math.fmod(x, 1000003)


def rows_of(n=400, seed=2):
    rng = random.Random(seed)
    return [(rng.choice("xy"), k * 3 - 50, rng.randrange(3), rng.random() < 0.4, float(rng.randrange(30)) if rng.random() > 0.05 else None) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, row long, cond int, side boolean, v double")


def all_forms(spark, rows, n):
    df = frame(spark, rows)
    raster = df.withColumn("bin", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("n", F.pmod(F.xxhash64("row", "bin"), F.lit(7)) * (1 + F.col("side").cast("int")))
    return {
        "difference": st.difference_test(df, ["k"], "row", F.col("side"), "v", n), "u": st.combined_condition_u(df.na.fill(0.0, ["v"]), ["k"], ["cond"], F.col("side"), "v", "row", n),
        "latencies": st.resample_latencies(df, ["k"], "row", "v", n), "response": st.response_test(raster, ["k"], "row", F.col("side"), "n", n), "trimmed": st.response_test(raster, ["k"], "row", F.col("side"), "n", n, trim=0.1),
    }


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_arrays_and_rows_agree(spark, monkeypatch):
    rows = rows_of()
    packed = {k: told(v) for k, v in all_forms(spark, rows, 25).items()}
    monkeypatch.setattr(st, "DRAWN", 500)
    assert {k: told(v) for k, v in all_forms(spark, rows, 25).items()} == packed
    monkeypatch.setattr(st, "PACKED_ROWS", 10)
    assert {k: told(v) for k, v in all_forms(spark, rows, 25).items()} == packed
    assert packed["response"] != packed["trimmed"]
    assert all(not told(v) for v in all_forms(spark, [], 5).values())


def test_difference_by_a_plain_loop(spark):
    rows = rows_of()
    got = {r.k: r for r in st.difference_test(frame(spark, rows), ["k"], "row", F.col("side"), "v", 200).collect()}
    for k in "xy":
        own = sorted((r[1], r[3], r[4]) for r in rows if r[0] == k)
        n = sum(r[1] for r in own)

        def stat(label):
            mean = lambda side: [v for (_, _, v), a in zip(own, label, strict=True) if a == side and v is not None]  # noqa: B023, E731
            return abs(sum(mean(True)) / len(mean(True)) - sum(mean(False)) / len(mean(False)))

        observed, null = stat([r[1] for r in own]), []
        for s in range(1, 201):
            first = set(sorted(range(len(own)), key=lambda i: (h(own[i][0], s), own[i][0]))[:n])  # noqa: B023
            null.append(stat([i in first for i in range(len(own))]))
        assert got[k].observed == pytest.approx(observed) and got[k].p == pytest.approx(sum(x > observed for x in null) / 200, abs=0.011)


def test_many_shuffles_cost_little_more(spark):
    """2,000 shuffles of 20,000 rows; a planted difference is told from none."""
    rng = random.Random(5)
    rows = [(k, i, 0, i % 3 == 0, rng.gauss(0.3 if k == "x" and i % 3 == 0 else 0, 1)) for k in "xyz" for i in range(6000)]
    df = frame(spark, rows).cache()
    took = {}
    for n in (20, 20, 2000):
        began = time.time()
        got = {r.k: r.p for r in st.difference_test(df, ["k"], "row", F.col("side"), "v", n).collect()}
        took[n] = time.time() - began
    df.unpersist()
    assert got["x"] < 0.001 and took[2000] < 12 * max(took[20], 0.5)
