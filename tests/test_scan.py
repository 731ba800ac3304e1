"""Scans in slices give what one window per key gives, hot and null keys, ties of slices and odd times included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evtspark.operators import signal as sg
from evtspark.operators.scan import in_slices, scan

SCHEMA = "k string, t double, id int, v double"


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def signal(spark):
    draw = random.Random(5)
    rows = [(key, draw.choice([draw.uniform(-40, 400), 12.0]), i, draw.choice([None, draw.gauss(0, 2)])) for i, key in enumerate(["hot"] * 1500 + ["few"] * 3 + [None] * 200)]
    rows += [("odd", None, 9001, 1.0), ("odd", float("nan"), 9002, 2.0), ("odd", float("inf"), 9003, -3.0), ("odd", 5.0, 9004, None), ("odd", float("-inf"), 9005, 4.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("bucket", [7.0, 1000.0])
def test_scan_is_a_window(signal, bucket):
    w = Window.partitionBy("k").orderBy("t", "id")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    parts = {"a": ("last", v), "b": ("max", v), "c": ("max_before", v), "d": ("sum", F.col("id")), "e": ("lag", v), "f": ("lead", v)}
    got = scan(signal, ["k"], ["t", "id"], bucket, parts)
    want = signal.select(
        "*", F.last(v, True).over(up_to).alias("a"), F.max(v).over(up_to).alias("b"), F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"),
        F.sum("id").over(up_to).alias("d"), F.lag(v).over(w).alias("e"), F.lead(v).over(w).alias("f"),
    )
    assert rows_of(got) == rows_of(want)


def test_scan_names(signal):
    with pytest.raises(ValueError, match="kinds are"):
        scan(signal, ["k"], ["t"], 1.0, {"a": ("median", F.col("v"))})
    assert scan(signal.where("false"), ["k"], ["t", "id"], 5.0, {"a": ("sum", F.col("id"))}).count() == 0


@pytest.mark.parametrize("rows", [5, 64, 100000])
def test_frames_in_slices(signal, rows):
    def op(df, by):
        return sg.moving_average(df, by, ["t", "id"], "v", 5)

    got = in_slices(signal, ["k"], ["t", "id"], op, 2, 2, 20.0, rows)
    near = lambda df: rows_of(df.withColumn("smooth", F.round("smooth", 9)))
    assert near(got.select(*signal.columns, "smooth")) == near(op(signal, ["k"]))
    with pytest.raises(ValueError, match="shorter"):
        in_slices(signal, ["k"], ["t"], op, 9, 0, 20.0, 3)


def test_operators_in_slices(signal):
    by, order = ["k"], ["t", "id"]
    for make in (
        lambda **b: sg.fill_forward(signal, by, order, "v", **b),
        lambda **b: sg.schmitt(signal, by, order, "v", -1.0, 1.5, **b),
        lambda **b: sg.movement_onsets(signal.na.fill(0.0, ["v"]), by, order, "v", win=3, threshold=0.1, quiet=4, **b),
    ):
        plain, sliced = make(), make(bucket=9.0)
        assert sorted(plain.columns) == sorted(sliced.columns)
        assert rows_of(sliced.select(plain.columns)) == rows_of(plain)
    timed = signal.where("t between -1e9 and 1e9")
    assert rows_of(sg.sessionize(timed, by, "t", 0.4, bucket=9.0)) == rows_of(sg.sessionize(timed, by, "t", 0.4))


@pytest.mark.parametrize("bucket", [None, 9.0])
def test_first_stops_by_a_plain_loop(spark, bucket):
    draw = random.Random(8)
    rows = []
    for key in ("a", "b", None):
        for _ in range(300):
            start = draw.randrange(500) * 1.0
            rows += [(key, start, start + draw.randrange(6))] * draw.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "k string, a double, z double")
    want = []
    for key in ("a", "b", None):
        first, group = None, -1
        for _, a, z in sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]):
            if first is None or a > first:
                first, group = z, group + 1
            want.append(repr((key, a, z, group)))
    got = [repr(tuple(r)) for r in sg.merge_ranges(df, ["k"], "a", "z", extend=False, bucket=bucket).select("k", "a", "z", "range_group").collect()]
    assert sorted(got) == sorted(want)
    plain = sg.merge_ranges(df, ["k"], "a", "z").select("k", "a", "z", "range_group")
    assert rows_of(sg.merge_ranges(df, ["k"], "a", "z", bucket=9.0).select("k", "a", "z", "range_group")) == rows_of(plain)


def test_one_key_is_many_tasks(spark):
    """A session of a million rows: equal rows, and no group of the scan holds more than a slice of it."""
    df = spark.range(1_000_000).select(F.lit("s").alias("k"), (F.col("id") / 100).alias("t"), "id", F.when(F.xxhash64("id") % 50 == 0, F.col("id") % 7).alias("v"))
    made = sg.fill_forward(df, ["k"], ["t", "id"], "v", bucket=100.0)
    whole = sg.fill_forward(df, ["k"], ["t", "id"], "v")
    total = lambda x: x.agg(F.count("*"), F.count("v"), F.sum(F.xxhash64("id", "v") % 1000003)).first()
    assert total(made) == total(whole)


def test_alignment_from_the_end(spark):
    """A train whose beginning has nothing in common with the other is aligned from its end."""
    draw = random.Random(3)
    steps = [draw.uniform(0.5, 4.0) for _ in range(200)]
    common = [1000.0 + sum(steps[:i]) for i in range(200)]
    noise = [float(i) + draw.uniform(0, 0.4) for i in range(100, 400)]
    x = [("s", t) for t in noise[::2] + common]
    y = [("s", t + 2.5) for t in [n + 0.7 * i % 3 for i, n in enumerate(noise[:90])] + common]
    a, b = (spark.createDataFrame(r, "k string, t double") for r in (x, y))
    pairs = sg.robust_align(a, b, ["k"], threshold=0.01, max_skips=260).collect()
    xs, ys = sorted(t for _, t in x), sorted(t for _, t in y)
    good = [p for p in pairs if abs(ys[p.i2] - xs[p.i1] - 2.5) < 1e-6]
    assert len([p for p in good if xs[p.i1] >= 1000]) == 200
    assert sg.robust_align(a, b, ["k"], threshold=0.01, max_skips=0).count() == 0


def test_tuning_by_fold(spark):
    from evtspark.operators import fits

    curve = lambda x, s: 1.0 + s * 2.718281828 ** (-0.5 * ((x - 4.0) / 1.5) ** 2)
    rows = [("u", 0, float(x), curve(x, 3.0)) for x in range(9)] + [("u", 1, float(x), curve(x, 3.0) + (0.3 if x % 2 else -0.3)) for x in range(9)]
    rows += [("u", 2, float(x), 2.0) for x in range(9)] + [("flat", 0, float(x), 1.0) for x in range(9)] + [("u", None, 1.0, 9.0), ("u", 0, None, 9.0)]
    got = {(r.u, r.f): r for r in fits.fit_tuning(spark.createDataFrame(rows, "u string, f int, x double, y double"), ["u"], "x", "y", fold="f").collect()}
    assert set(got) == {("u", 0), ("u", 1), ("u", 2), ("flat", 0)}
    assert abs(got["u", 0].centre - 4.0) < 0.05 and got["u", 0].ve > 0.99
    fit, own = [curve(x, 3.0) for x in range(9)], [r[3] for r in rows if r[:2] == ("u", 1)]
    mean = lambda v: sum(v) / len(v)
    var = lambda v: mean([(x - mean(v)) ** 2 for x in v])
    assert abs(got["u", 1].ve - (1 - var([a - b for a, b in zip(own, fit, strict=True)]) / var(own))) < 0.02
    assert got["u", 1].centre == got["u", 0].centre and got["u", 2].ve is None and got["flat", 0].centre is None


def test_maps_and_json(spark):
    from evtspark.functions import scalars as sc

    df = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 5, 'c', 6) AS y, CAST(NULL AS map<string,int>) AS n, '{\"q\":1}' AS good, '{\"q\":' AS bad")
    r = df.select(sc.merge_maps(F.col("x"), F.col("y")).alias("xy"), sc.merge_maps(F.col("n"), F.col("y"), F.col("x")).alias("nyx"), sc.merge_maps(F.col("x"), F.col("n")).alias("xn"),
                  sc.load_json(F.col("good"), "q int").alias("g"), sc.load_json(F.col("bad"), "q int").alias("w"), sc.dump_json(F.struct(F.lit(None).cast("int").alias("e"), F.lit(2).alias("f"))).alias("s")).first()
    assert r.xy == {"a": 1, "b": 5, "c": 6} and r.nyx == {"a": 1, "b": 2, "c": 6} and r.xn == {"a": 1, "b": 2}
    assert r.g.q == 1 and (r.w is None or r.w.q is None) and r.s == '{"e":null,"f":2}'


def test_flat_columns_have_no_correlation(spark):
    """What centring leaves of a constant is no spread, large levels included."""
    from evtspark.operators.summary import corr_matrix

    rows = [("a", r, "u", 0.1 if r < 4 else 0.7) for r in range(6)] + [("a", r, "w", 1e5 + r % 2) for r in range(6)]
    other = [("a", r, "x", 1.0 + r * r) for r in range(4)] + [("a", r, "y", 3.3) for r in range(6)]
    a, b = (spark.createDataFrame(x, "k string, r int, c string, v double") for x in (rows, other))
    got = {(x.a, x.b): x.r for x in corr_matrix(a, b, "r", "c", "c", "v", by=["k"], blocks=1).collect()}
    assert got["u", "x"] is None and got["u", "y"] is None and got["w", "y"] is None
    assert abs(got["w", "x"] - 0.428571429) < 1e-6  # 0, 1, 0, 1 against 1, 2, 5, 10


def test_component_weights_by_svd(spark):
    import numpy as np

    from evtspark.operators import fits

    draw = np.random.default_rng(4)
    m = draw.poisson(2.0, (30, 5)) * np.array([1, 2, 3, 1, 0])
    rows = [("u", i, j, float(m[i, j])) for i in range(30) for j in range(5) if (i, j) not in ((3, 0), (7, 2))] + [("silent", 0, 0, 0.0)]
    m[3, 0] = m[7, 2] = 0
    got = fits.pc1_weights(spark.createDataFrame(rows, "k string, trial int, bin int, n double"), ["k"], "trial", "n").collect()
    want = np.abs(np.linalg.svd(m)[0][:, 0])
    weights = {(r.k, r.trial): r.weight for r in got}
    assert len(got) == 31 and weights["silent", 0] == 0.0
    assert np.allclose([weights["u", i] for i in range(30)], want)


def test_missing_metrics_of_units(spark):
    """A unit not known to be somatic is noise; other missing metrics hold no rule."""
    from evtspark.operators import selection as sel

    metrics = [*sel.NOISE, *sel.GOOD]
    fine = {"nPeaks": 1, "nTroughs": 1, "isSomatic": 1, "spatialDecaySlope": -0.01, "waveformDuration_peakTrough": 400, "waveformBaselineFlatness": 0.1, "nSpikes": 900,
            "fractionRPVs_estimatedTauR": 0.0, "rawAmplitude": 50, "percentageSpikesMissing_gaussian": 1, "signalToNoiseRatio": 1, "presenceRatio": 1}
    rows = [[float(fine[m]) for m in metrics]] + [[None if m == gone else float(fine[m]) for m in metrics] for gone in ("isSomatic", "nPeaks", "nSpikes")]
    rows.append([float("nan") if m == "isSomatic" else float(fine[m]) for m in metrics])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i int", *(f"{m} double" for m in metrics)]))
    got = [r.quality for r in sel.unit_quality(df).orderBy("i").collect()]
    assert got == ["good", "noise", "good", "mua", "noise"]
