"""Values of operators that SQL does not express, against plain Python and planted cases."""

import math
import random
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from evtspark.operators import fits as fi
from evtspark.operators import match as ma
from evtspark.operators import raster as ra
from evtspark.operators import regions as rg
from evtspark.operators import signal as sg
from evtspark.operators import stats as st
from evtspark.operators import summary as su
from evtspark.operators import timejoin as tj
from evtspark.plans import catalogue
from tests.oracle import difference


def test_greedy_match_takes_the_plain_greedy_pairs(spark):
    rng = random.Random(4)
    rows = [(d, a, b, round(rng.random(), 2) if rng.random() > 0.02 else None) for d in ("x", "y") for a in range(25) for b in range(30)]
    got = ma.greedy_match(spark.createDataFrame(rows, "days string, a long, b long, r double"), ["days"], "a", "b", "r").collect()
    want = set()
    for d in ("x", "y"):
        left, right, step = set(), set(), 0
        for _, a, b, r in sorted((x for x in rows if x[0] == d and x[3] is not None), key=lambda x: (-x[3], x[1], x[2])):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((d, a, b, step))
                step += 1
    assert {tuple(r) for r in got} == want
    assert ma.greedy_match(spark.createDataFrame([], "days string, a long, b long, r double"), ["days"], "a", "b", "r").count() == 0


def test_corr_matrix_takes_common_rows(spark):
    rng = np.random.default_rng(5)
    a = [(k, r, float(rng.normal())) for k in range(20) for r in range(15) if rng.random() > 0.2]
    b = [(k, r, float(rng.normal())) for k in range(17) for r in range(15) if rng.random() > 0.2] + [(99, r, 1.0) for r in range(15)]
    frame = lambda rows: spark.createDataFrame(rows, "c long, row long, v double")
    got = {(r.a, r.b): r.r for r in su.corr_matrix(frame(a), frame(b), "row", "c", "c", "v", blocks=3).collect()}
    left, right = ({k: {r: v for c, r, v in rows if c == k} for k in {x[0] for x in rows}} for rows in (a, b))
    for i, x in left.items():
        for j, y in right.items():
            both = sorted(x.keys() & y.keys())
            if len(both) > 2 and j != 99:
                assert math.isclose(got[i, j], np.corrcoef([x[r] for r in both], [y[r] for r in both])[0, 1], abs_tol=1e-9)
    assert all(got[i, 99] is None for i in left)


def test_neighbours_with_and_without_buckets(spark):
    rng = random.Random(6)
    left = [(rng.randrange(3), k, rng.choice([None, float(rng.randint(0, 400)), rng.random() * 400])) for k in range(200)]
    right = [(rng.randrange(4), 1000 + k, float(t)) for k, t in enumerate(rng.sample(range(400), 60))]
    frames = spark.createDataFrame(left, "s long, id long, t double"), spark.createDataFrame(right, "s long, rid long, t double")
    for equal in (False, True):
        for bucket in (None, 30.0):
            got = {r.id: (r.before and r.before.rid, r.after and r.after.rid) for r in tj.neighbours(*frames, ["s"], allow_equal=equal, bucket=bucket).collect()}
            for s, i, t in left:
                own = [(x, r) for z, r, x in right if z == s and t is not None]
                before = max(((x, r) for x, r in own if (x <= t if equal else x < t)), default=(0, None))[1]
                after = min(((x, r) for x, r in own if (x > t if equal else x >= t)), default=(0, None))[1]
                assert got[i] == (before, after)


def test_tails_of_t_and_f(spark):
    """Table values of Student's t and Fisher's F."""
    from pyspark.sql import functions as F

    rows = [(5.0, 0.5, 10 / (10 + 2.228139**2), 0.05), (0.5, 0.5, 1 / (1 + 12.706205**2), 0.05), (10.0, 1.0, 20 / (20 + 2 * 3.492828), 0.05), (15.0, 2.5, 30 / (30 + 5 * 3.699019), 0.01), (2.0, 3.0, 0.0, 0.0), (2.0, 3.0, 1.0, 1.0), (500.0, 0.5, 1000 / (1000 + 1.962339**2), 0.05)]
    got = spark.createDataFrame(rows, "a double, b double, x double, p double").select(st.beta_share("a", "b", "x").alias("got"), "p").collect()
    assert all(math.isclose(r.got, r.p, abs_tol=2e-6) for r in got), got
    pairs = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.5), ("a", 3.0, 2.5), ("b", 1.0, 1.0)], "k string, x double, y double")
    out = {r.k: r for r in st.paired_t(pairs, ["k"], "x", "y").collect()}
    t = out["a"].t
    assert math.isclose(out["a"].p, 1 - t / math.sqrt(2 + t * t), rel_tol=1e-9) and out["b"].p is None  # two degrees of freedom
    groups = spark.createDataFrame([("a", g, v) for g, v in (("x", 1.0), ("x", 2.0), ("y", 4.0), ("y", 5.5))], "k string, g string, v double")
    f = st.one_way_anova(groups, ["k"], "g", "v").first()
    assert math.isclose(f.p, 1 - math.sqrt(f.f) / math.sqrt(2 + f.f), rel_tol=1e-9)  # F with 1 and 2 degrees of freedom is t squared


def test_fit_line_finds_a_planted_line(spark):
    rng = np.random.default_rng(7)
    d = np.array([1.0, -2.0, 2.0]) / 3
    pts = np.array([4.0, 5.0, 6.0]) + np.outer(rng.normal(0, 10, 200), d) + rng.normal(0, 0.01, (200, 3))
    df = spark.createDataFrame([("k", *map(float, p)) for p in pts], "k string, x double, y double, z double")
    line = rg.fit_line(df, ["k"], ["x", "y", "z"])
    got = line.first()
    v = np.linalg.svd(pts - pts.mean(0))[2][0]
    assert np.allclose(np.abs(got.direction @ v), 1, atol=1e-9) and np.allclose(got.centre, pts.mean(0))
    rest = rg.project(df, line, ["k"], ["x", "y", "z"]).collect()
    out = pts - pts.mean(0)
    want = np.sqrt(np.maximum((out**2).sum(1) - (out @ v) ** 2, 0))
    assert np.allclose(sorted(r.distance for r in rest), sorted(want), atol=1e-6)


def test_interleaved_files_round_trip(spark, tmp_path):
    """Several files, read in parts of a few samples; each has its own numbers from 0."""
    from evtspark.sources import catalog as so

    rng = np.random.default_rng(8)
    rows = [(f"rec{f}", k, int(rng.integers(-32768, 32768)), int(rng.integers(-9, 9))) for f in range(3) for k in range(10 * f + 1)]
    df = spark.createDataFrame(rows, "file string, k long, a int, b int")
    assert so.write_interleaved(df, "file", "k", ["a", "b"], f"file://{tmp_path}/raw").count() == 3
    got = so.read_interleaved(spark, f"file://{tmp_path}/raw", 2, samples=4).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.sample, r.channel, r.v) for r in got) == sorted((f"{f}.bin", k, c, v) for f, k, *own in rows for c, v in enumerate(own))


def test_first_n_fills_short_keys(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 3), (None, 5)], "k string, v int")
    got = sorted(((r.k or "", r.rank, r.v) for r in ma.first_n(rows, ["k"], ["v"], 2, pad=True).collect()))
    assert got == [("", 1, 5), ("", 2, None), ("a", 1, 1), ("a", 2, 2)]
    assert ma.first_n(rows.limit(0), ["k"], ["v"], 2, pad=True).count() == 0


def test_kernel_significance_fits_the_kernel_on_what_is_left(spark):
    rng = np.random.default_rng(8)
    names = ["p@+000", "p@+001", "q@+000"]
    x = rng.normal(size=(80, 3))
    y = {"1": x @ [1.0, -2.0, 0.0] + rng.normal(size=80), "2": x @ [0.0, 0.0, 3.0] + rng.normal(size=80)}
    design = spark.createDataFrame([("s", k % 2, k, f, float(x[k, j])) for k in range(80) for j, f in enumerate(names)], "s string, fold long, bin long, feature string, value double")
    counts = spark.createDataFrame([("s", k % 2, k, u, float(v[k])) for u, v in y.items() for k in range(80)], "s string, fold long, bin long, unit string, y double")
    got = {(r.unit, r.event): r.ve for r in fi.kernel_significance(design, counts, ["s"], "unit", [0.5], ["p", "q", "none"]).collect()}
    ridge = lambda a, b: np.linalg.solve(a.T @ a + 0.5 * np.eye(a.shape[1]), a.T @ b)
    for e, own in (("p", [0, 1]), ("q", [2])):
        other = [j for j in range(3) if j not in own]
        for u, v in y.items():
            rest = v - x[:, other] @ ridge(x[::2][:, other], v[::2])
            test = rest[1::2] - x[1::2][:, own] @ ridge(x[::2][:, own], rest[::2])
            assert math.isclose(got[u, e], 1 - test @ test / (rest[1::2] @ rest[1::2]), abs_tol=1e-9)
    assert got["1", "none"] is None and got["1", "p"] > 0.5 > got["1", "q"]


def test_decoding_by_repeated_stratified_folds(spark):
    y = np.array([0.0] * 12 + [1.0] * 18)
    for repeat in range(3):
        fold = fi.stratified_folds(y, 5, repeat)
        for k in range(5):
            assert 2 <= (y[fold == k] == 0).sum() <= 3 and (fold == k).sum() == 6
    assert (fi.stratified_folds(y, 5, 0) != fi.stratified_folds(y, 5, 1)).any()
    rng = np.random.default_rng(3)
    rows = [("s", e, u, b, float(y[e] * (u == 0) * (b > 1) * 4 + rng.normal())) for e in range(30) for u in range(2) for b in range(4)]
    raster = spark.createDataFrame([*rows, ("few", 0, 0, 0, 1.0)], "s string, event long, unit long, bin long, n double")
    trials = spark.createDataFrame([("s", e, float(v)) for e, v in enumerate(y)] + [("few", 0, 1.0)], "s string, event long, y double")
    got = {(r.s, r.window): r for r in fi.windowed_decoding(raster, trials, ["s"], "event", "unit", "y", 2, 2, 4).collect()}
    assert got["s", 2].accuracy > 0.9 > got["s", 0].accuracy and got["s", 0].majority == 0.6 and got["s", 0].n == 30
    assert got["few", 0].accuracy is None and got["few", 0].n == 1


def test_lagged_noise_finds_the_planted_lag(spark):
    rng = np.random.default_rng(9)
    noise = rng.normal(size=(6, 40))
    later = np.c_[rng.normal(size=(6, 2)), noise[:, :-2]] + 0.1 * rng.normal(size=(6, 40))
    rows = [("s", u, t, t % 2, b, float(m[t, b])) for u, m in ((0, noise), (1, later)) for t in range(6) for b in range(40)] + [("s", 2, t, t % 2, b, 1.0) for t in range(6) for b in range(40)]
    resp = spark.createDataFrame(rows, "s string, unit long, trial long, stim long, bin long, v double")
    lags = [-3, -2, -1, 0, 1, 2, 3]
    got = {(r.a, r.b): r for r in su.lagged_noise_corr(resp, ["s"], "unit", ["trial"], ["stim"], "bin", "v", lags).collect()}
    assert set(got) == {(0, 1), (1, 0)} and got[1, 0].lag == 2 and got[0, 1].lag == -2
    rest = [m - np.stack([m[t % 2 :: 2].mean(0) for t in range(6)]) for m in (noise, later)]
    r = lambda k: np.corrcoef(rest[1][:, k:].ravel(), rest[0][:, : 40 - k].ravel())[0, 1]
    assert math.isclose(got[1, 0].r, r(2), abs_tol=1e-9) and math.isclose(got[1, 0].gain, r(2) - r(0), abs_tol=1e-9)


def test_mean_weights_by_azimuth(spark):
    w = spark.createDataFrame([("u", 1, 0.2), ("u", 2, 0.4), ("u", 3, 0.9)], "unit string, trial int, weight double")
    t = spark.createDataFrame([(1, -30.0), (2, -30.0), (3, None)], "trial int, azimuth double")
    got = {r.azimuth: r.weight for r in fi.mean_weights(w, t, ["unit"], "trial", "azimuth").collect()}
    assert math.isclose(got[-30.0], 0.3) and got[None] == 0.9


def test_bilateral_shifts_add_up_where_planted(spark):
    rows = []
    for place, shift in ((-1, -1.0), (1, 0.4), (0, -0.6)):
        for on in (False, True):
            for vis in (-1.0, -0.5, 0.0, 0.5, 1.0):
                for aud in (-1.0, 1.0):
                    z = 0.2 + 2 * vis + 0.7 * aud + shift * on
                    rows.append(("m", place, on, vis, aud, 1000 / (1 + math.exp(-z)), 1000.0))
    cells = spark.createDataFrame([*rows, ("alone", -1, True, 0.5, 1.0, 3.0, 9.0)], "k string, place int, laser boolean, vis double, aud double, n_right double, n double")
    (got,) = fi.bilateral_additivity(cells, ["k"], "place", "laser", [1.0]).collect()
    for name, want in (("left", -1.0), ("right", 0.4), ("both", -0.6)):
        assert math.isclose(got[name], want, abs_tol=1e-3), name
    assert math.isclose(got.loss_sum, got.loss_both, abs_tol=1e-5)
    free = {r.model: r.loss for r in fi.glm_compare(cells.where("place = 0 AND NOT laser"), cells.where("place = 0 AND laser"), ["k"], [1.0]).collect()}
    assert free["none"] > free["bias"] >= free["all"] - 1e-9


def test_robust_align_passes_over_a_lost_event(spark):
    t = np.cumsum(np.random.default_rng(2).uniform(1, 5, 40))
    a = spark.createDataFrame([("s", float(x)) for x in t], "s string, t double")
    b = spark.createDataFrame([("s", float(x) + 100) for k, x in enumerate(t) if k != 20], "s string, t double")
    got = {(r.i1, r.i2) for r in sg.robust_align(a, b, ["s"]).collect()}
    assert got == {(k, k - (k > 20)) for k in range(40) if k != 20}


def test_lasso_is_at_its_optimum_and_rank_is_cut(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 4))
    y = {"1": x @ [2.0, 0.0, -1.0, 0.0] + 0.3 * rng.normal(size=120), "2": x @ [0.0, 1.0, 0.0, 0.0] + 0.3 * rng.normal(size=120)}
    design = spark.createDataFrame([("s", k % 2, k, f"p@{j:+04d}", float(x[k, j])) for k in range(120) for j in range(4)], "s string, fold long, bin long, feature string, value double")
    counts = spark.createDataFrame([("s", k % 2, k, u, float(v[k])) for u, v in y.items() for k in range(120)], "s string, fold long, bin long, unit string, y double")

    def fit(**how):
        rows = fi.ridge_fit(design, counts, ["s"], "unit", [0.1], **how).collect()
        return {u: np.array([r.coef for r in sorted(rows, key=lambda r: r.feature) if r.unit == u]) for u in y}

    for u, b in fit(kind="lasso").items():
        slope = x[::2].T @ (y[u][::2] - x[::2] @ b)  # within alpha * rows of zero, at it where a coefficient is not zero
        assert np.all(np.abs(slope) <= 6 + 1e-6) and np.allclose(slope[b != 0], 6 * np.sign(b[b != 0]), atol=1e-6) and (b == 0).any()
    low = np.stack(list(fit(rank=1).values()), 1)
    assert np.linalg.matrix_rank(low, tol=1e-9) == 1


def test_predictor_table_has_scores_by_unit(spark):
    trials = spark.createDataFrame([("s", e) for e in range(4)], "s string, event long")
    rates = spark.createDataFrame([("s", e, "a", float(v)) for e, v in enumerate((1, 2, 3, 6))] + [("s", e, "b", 2.0) for e in range(4)], "s string, event long, unit string, rate double")
    got = [(r.a, r.b) for r in fi.predictor_table(trials, rates, ["s"], "event", "unit", ["a", "b"]).orderBy("event").collect()]
    z = np.array([1, 2, 3, 6]) - 3.0
    a = np.array([x for x, _ in got])
    assert np.allclose(a / a[3], z / z[3]) and a[3] > 0 and [b for _, b in got] == [0.0] * 4


def test_motion_periods_per_key(spark):
    """Two keys of different levels: each has its own thresholds; short periods go, short pauses are bridged."""
    rng = np.random.default_rng(15)
    want, rows = {"a": [(2.0, 4.0), (6.0, 7.5)], "b": [(0.0, 1.0), (5.0, 9.99)]}, []
    for k, scale in (("a", 1.0), ("b", 40.0)):
        for i in range(1000):
            t = i / 100
            moving = any(x <= t < z for x, z in want[k]) or (k == "a" and i == 850)  # one sample alone
            pause = k == "a" and i == 300
            level = rng.choice([4.0, 6.0, 8.0, 10.0]) if moving and not pause else 2.0 * (rng.random() < 0.01)
            rows.append((k, t, float(scale * (level + rng.uniform(0, 0.1) * (not pause)))))
    df = spark.createDataFrame(rows, "k string, t double, v double")
    found = {r.k: (r.low, r.high) for r in sg.motion_thresholds(df, ["k"], "v").collect()}
    assert 0 < found["a"][0] < found["a"][1] < 1.5 and 0 < found["b"][0] < found["b"][1] < 60 and found["b"][0] > 20 * found["a"][0]
    got = {}
    for r in sg.motion_periods(df, ["k"], "t", "v", min_on=0.2, min_off=0.015).orderBy("k", "start").collect():
        got.setdefault(r.k, []).append((r.start, r.stop))
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == 2 and all(abs(a - x) < 0.2 and abs(z - y) < 0.2 for (a, z), (x, y) in zip(got[k], want[k], strict=True)), got
    one = spark.createDataFrame([("c", 0.0, 1.0), ("c", 1.0, 1.0)], "k string, t double, v double")
    assert sg.motion_periods(one, ["k"], "t", "v").count() == 0 and sg.motion_periods(one.limit(0), ["k"], "t", "v").count() == 0


def test_bootstrapped_index_is_near_its_limit(spark):
    rng = np.random.default_rng(16)
    rows = [("s", i, k, float(rng.normal(m, 1))) for k, m in (("visual", 1), ("auditory", 2), ("coherent", 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, i long, kind string, y double")
    limit, drawn = fi.enhancement_index(df, ["s"], "kind", "y").first()["index"], fi.enhancement_bootstrap(df, ["s"], "kind", "y", ["i"]).first()["index"]
    assert abs(limit - drawn) < 0.06 and drawn > 1


def test_overlaps_are_counted_by_range(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.choice("ab"), None if rng.random() < 0.05 else rng.randrange(12), rng.randrange(5)) for _ in range(150)]
    df = spark.createDataFrame(rows, "k long, g string, x int, w int")
    want = sum(a[0] < b[0] and a[1] == b[1] and None not in (a[2], b[2]) and a[2] < b[2] + b[3] and b[2] < a[2] + a[3] for a in rows for b in rows)
    assert [r.n for r in tj.count_overlaps(df, ["g"], "k", F.col("x"), F.col("x") + F.col("w")).collect()] == [want]
    assert [r.n for r in tj.count_overlaps(df.limit(0), ["g"], "k", F.col("x"), F.col("x") + F.col("w")).collect()] == [0]


def test_crowded_sites_are_met_as_one_row(spark):
    """100,000 sites of one place and 20,000 rows beside it: two billion pairs when they meet one by one."""
    local = spark.range(20000).select(F.col("id").alias("k"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    target = spark.range(100000).select(F.col("id").alias("site"), F.lit(0).alias("x"), F.lit(0).alias("y")).union(spark.createDataFrame([(7, 32, 0)], "site long, x int, y int"))
    began = time.time()
    assert [tuple(r) for r in ma.match_sites(local, target, "k").groupBy("site").count().collect()] == [(7, 20000)]
    assert time.time() - began < 20


def test_equal_counts_by_slices(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b"]), rng.choice(["u", "u", "v", None]), rng.randrange(300), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, c string, h long, k long")
    for cap in (None, 11):
        want = ma.equalise_counts(df, ["g"], "c", F.struct("h", "k"), cap)
        got = ma.equalise_counts(df, ["g"], "c", F.struct("h", "k"), cap, width=10.0)
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in want.collect())
        assert sorted(got.columns) == ["c", "g", "h", "k"]


def test_rank_corr_of_counted_values(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 300).astype(float), rng.normal(size=300).round(1) * 1e3
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    rows = [("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("b", 1.0, float(q)) for q in y[:9]]
    got = {r.k: r.rho for r in st.rank_corr(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert abs(got["a"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9 and got["b"] is None
    counts = spark.createDataFrame([("a", 2.0, 3), ("a", -1.0, 2), ("a", 7.0, 1), (None, 2.0, 1)], "k string, v double, _n long")
    assert {(r.k, r.v): r["rank"] for r in st.average_ranks(counts, ["k"], "v").collect()} == {("a", -1.0): 1.5, ("a", 2.0): 4.0, ("a", 7.0): 6.0, (None, 2.0): 1.0}


def test_smoothing_does_not_multiply_rows(spark):
    rng = random.Random(8)
    rows = [(g, b, rng.randrange(5) if rng.random() < 0.9 else None) for g in "ab" for b in sorted(rng.sample(range(20), 12))]
    df = spark.createDataFrame(rows, "g string, bin int, n int")
    for causal in (False, True):
        w = dict(ra.gaussian_kernel(1.0, causal))
        made = ra.smooth_counts(df, ["g"], 1.0, causal)
        got = {(r.g, r.bin): r.smooth for r in made.collect()}
        assert len(got) == len(rows)
        for g, b, _ in rows:
            assert abs(got[g, b] - sum(n * w.get(b - c, 0.0) for h, c, n in rows if h == g and n is not None)) < 1e-9
        assert "Generate" not in made._jdf.queryExecution().toString()


def test_blocks_leave_the_best_and_the_sums(spark, monkeypatch):
    monkeypatch.setattr(su, "BLOCK_COLUMNS", 7)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (25, 8)).astype(float)  # few values: equal correlations and constant columns
    x[3] = 1.0
    cells = [("k", c, r, float(x[c, r])) for c in range(25) for r in range(8) if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "g string, c long, r int, v double")
    pick = lambda m: sorted((r.a, r.b, r.rank) for r in ma.top_n(m.withColumn("r", F.round("r", 9)), ["g", "a"], "r", 3, "b").collect())
    few = su.corr_matrix(df, df, "r", "c", "c", "v", by=["g"], best=(3, 9))
    assert pick(few) == pick(su.corr_matrix(df, df, "r", "c", "c", "v", by=["g"]))
    assert few.count() <= 25 * 3 * 4
    halves = [df.where("r < 4"), df.where("r >= 4")]
    whole = [su.corr_matrix(h, h, "r", "c", "c", "v", by=["g"]) for h in halves]
    want, got = (m.first().stability for m in (su.correlation_stability(*whole, ["g"]), su.stability_of_columns(*halves, "r", "c", "v", ["g"])))
    assert abs(want - got) < 1e-9
    assert su.stability_of_columns(*halves, "r", "c", "v", ["g"], min_pairs=1000).first().stability is None


def test_wide_blocks_give_their_pairs_by_and_by(spark, monkeypatch):
    monkeypatch.setattr(su, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(su, "LIST_COLUMNS", 20)
    monkeypatch.setattr(su, "STRIPE", 3)
    rng = np.random.default_rng(23)
    keys, far = [None, *range(31)], 2**60 + 1  # ids that a float does not hold
    first = [(k, f"c{c}", r, float(rng.normal())) for k in keys for c in range(22) for r in range(6) if rng.random() < 0.9]
    second = [(k, far + c if c else None, r, float(rng.normal())) for k in keys[:-1] for c in range(25) for r in range(6) if rng.random() < 0.9]
    frame = lambda rows, kind: spark.createDataFrame(rows, f"k int, c {kind}, r int, v double")
    a, b = frame(first, "string"), frame(second, "long")
    sides = [su.packed_columns(s, ["k"], "c", "r", "v") for s in (a, b)]
    assert su._wide_blocks(sides, ["k"]) == 2  # of 20 columns, not 7 of BLOCK_COLUMNS
    assert su._wide_blocks([s.where("k = 3") for s in sides], ["k"]) == 7  # one key for all cores
    monkeypatch.setattr(su, "BLOCK_CELLS", 30)
    assert su._wide_blocks(sides, ["k"]) in (5, 6)  # some 25 columns of 5.4 cells
    left, right = {}, {}
    for rows, side in ((first, left), (second, right)):
        for k, c, r, v in rows:
            if k is None or k > 28:
                side.setdefault((k, c), {})[r] = v
    a, b = (s.where("k IS NULL OR k > 28") for s in (a, b))
    want = {(k, c, e) for k, c in left for q, e in right if k == q and left[k, c].keys() & right[q, e].keys()}
    for blocks in (None, 1, 2):
        got = {(r.k, r.a, r.b): r.r for r in su.corr_matrix(a, b, "r", "c", "c", "v", by=["k"], blocks=blocks).collect()}
        assert got.keys() == want
        for (k, c, e), r in got.items():
            both = sorted(left[k, c].keys() & right[k, e].keys())
            if len(both) > 2:
                assert math.isclose(r, np.corrcoef([left[k, c][i] for i in both], [right[k, e][i] for i in both])[0, 1], abs_tol=1e-9)


def test_next_label_is_as_in_sql_for_any_label(spark, tmp_path):
    rng = np.random.default_rng(24)
    labels = [None, -11, -1, 0, 0, 1, 8, 9, 10, 19, 29]
    rows = [(k, [float(x) for x in rng.normal(size=64)], label) for k, label in enumerate(labels * 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("a23_corr_matrix", "t2_top_n_matches"):
        assert (found := difference(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.ORACLE_SQL[name])) is None, found


def test_features_are_made_once_for_all_passes(spark):
    seen = spark.sparkContext.accumulator(0)

    def made(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(80).select(F.udf(made, "double")("id").alias("f"), (F.col("id") % 3 % 2).cast("int").alias("y"), (F.col("id") % 2).alias("fold"))
    assert fi.neurometric_fit(rows, ["f"], "y", "fold").first().n == 40
    assert seen.value == 80


def test_copies_of_columns_stand_side_by_side(spark, monkeypatch):
    """Equal r come in runs, and a column with many copies fills no block."""
    monkeypatch.setattr(su, "COPIES", 8, raising=False)
    monkeypatch.setattr(su, "BLOCK_COLUMNS", 32)
    monkeypatch.setattr(su, "LIST_COLUMNS", 64)
    rng = np.random.default_rng(24)
    kinds = rng.normal(size=(13, 10))
    of = {copy * 1000 + kind: kind for kind in range(13) for copy in range(6 if kind else 100)}
    rows = [(c, r, float(kinds[k, r])) for c, k in of.items() for r in range(10)]
    a, b = (spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "c long, r int, v double") for _ in range(2))
    got = su.corr_matrix(a, b, "r", "c", "c", "v").collect()
    want = np.corrcoef(kinds)
    assert sorted((x.a, x.b) for x in got) == sorted((i, j) for i in of for j in of)
    assert all(math.isclose(x.r, want[of[x.a], of[x.b]], abs_tol=1e-9) for x in got)
    runs = sum(round(x.r, 6) != round(y.r, 6) for x, y in zip(got, got[1:], strict=False))
    assert runs < len(got) / 6
    packed = su._with_copies(su.packed_columns(a, [], "c", "r", "v"), [])
    sizes = [x["count"] for x in su._dealt(packed, packed, 6, ("_h", "_part"))[0].where("_j = 0").groupBy("_i").count().collect()]
    assert sum(sizes) == len(of) and max(sizes) < 64


def test_lists_of_partners_give_the_greedy_pairs(spark, monkeypatch):
    monkeypatch.setattr(ma, "LISTED", 2)
    monkeypatch.setattr(ma, "LISTED_ROWS", 0)
    monkeypatch.setattr(ma, "LIST_COLUMNS", 16)
    monkeypatch.setattr(su, "STRIPE", 5)
    rng = np.random.default_rng(7)
    cells = [(k, side, c, r, float(x)) for k in ("x", None) for side, n in ((0, 40), (1, 33)) for c in range(n) for r, x in enumerate(np.ones(9) if c == 3 else rng.normal(size=9)) if rng.random() < 0.95]
    df = spark.createDataFrame(cells, "days string, side int, c long, row int, v double")
    first, second = df.where("side = 0"), df.where("side = 1")
    asked = su.corr_matrix(first, second, "row", "c", "c", "v", by=["days"]).where("days IS NOT NULL")
    want = {tuple(r) for r in ma.greedy_match(asked, ["days"], "a", "b", "r").collect()}
    got = {tuple(r) for r in ma.greedy_match_columns(first, second, ["days"], "row", "c", "v").collect()}
    assert len(want) == 32 and {r for r in got if r[0]} == want and len(got) == 64
    few = su.best_of_both(*(su.packed_columns(s, ["days"], "c", "row", "v") for s in (first, second)), ["days"], 2, 2)
    assert few.count() <= 2 * 2 * (40 + 33)


def test_largest_takes_the_smaller_column_of_equals():
    r = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf], [-np.inf, 0.1, -np.inf, 0.2, -np.inf], [0.3, 0.3, 0.3, 0.3, 0.3]])
    assert [x.tolist() for x in su._largest(r, 2)] == [[0, 0, 1, 1, 2, 2], [0, 1, 1, 3, 0, 1]]
    assert su._largest(r, 9)[0].tolist() == [0] * 4 + [1] * 2 + [2] * 5


def test_lagged_noise_deals_many_keys_to_a_group(spark):
    rng = np.random.default_rng(12)
    rows = [(k, u, t, t % 2, b, float(rng.integers(-2, 3))) for k in range(40) for u in range(3) for t in range(4) for b in range(-3, 3) if rng.random() < 0.9]
    resp = spark.createDataFrame(rows, "s long, unit long, trial long, stim long, bin long, v double")
    lags = [-2, -1, 0, 1]
    made = lambda blocks: {(r.s, r.a, r.b): r for r in su.lagged_noise_corr(resp, ["s"], "unit", ["trial"], ["stim"], "bin", "v", lags, blocks).collect()}
    one, three = made(1), made(3)
    assert one.keys() == three.keys() and all(one[k].lag == three[k].lag and math.isclose(one[k].r, three[k].r, abs_tol=1e-9) for k in one)
    mean = {}
    for k, u, t, s, b, v in rows:
        mean.setdefault((k, u, s, b), []).append(v)
    rest = {(k, u, t, b): v - np.mean(mean[k, u, s, b]) for k, u, t, s, b, v in rows}
    for (k, a, b), x in one.items():
        pairs = [(v, rest[k, b, t, i - x.lag]) for (q, u, t, i), v in rest.items() if q == k and u == a and (k, b, t, i - x.lag) in rest]
        assert math.isclose(x.r, np.corrcoef(np.array(pairs).T)[0, 1], abs_tol=1e-9)
    plan = su.lagged_noise_corr(resp, ["s"], "unit", ["trial"], ["stim"], "bin", "v", lags, 1)._jdf.queryExecution().toString()
    assert "_deal" in plan and "Generate" not in plan


def test_decoding_deals_many_sessions_to_a_group(spark):
    rng = np.random.default_rng(13)
    raster = [(s, e, u, b, float(rng.normal())) for s in range(50) for e in range(7) for u in range(2) for b in range(3) if rng.random() < 0.9]
    frame = spark.createDataFrame(raster, "s long, event long, unit long, bin long, n double")
    trials = spark.createDataFrame([(s, e, float((s + e) % 2)) for s in range(50) for e in range(7)], "s long, event long, y double")
    made = fi.windowed_decoding(frame, trials, ["s"], "event", "unit", "y", 2, 1, 3)
    assert "_deal" in made._jdf.queryExecution().toString()
    got = {(r.s, r.window): r for r in made.collect()}
    assert len(got) == 100
    for (s, w), r in got.items():
        alone = {}
        for _, e, u, b, n in (x for x in raster if x[0] == s and w <= x[3] < w + 2):
            alone.setdefault((e, u), []).append(n)
        events = sorted({e for e, _ in alone})
        x = np.array([[1.0] + [np.mean(alone[e, u]) if (e, u) in alone else 0.0 for u in range(2)] for e in events])
        y, right = np.array([(s + e) % 2 == 1 for e in events]), 0
        for repeat in range(5):
            fold = fi.stratified_folds(y, 5, repeat)
            for k in range(5):
                a = fold != k
                v = np.linalg.solve(x[a].T @ x[a] + np.eye(3), x[a].T @ (2.0 * y[a] - 1))
                right += ((x[~a] @ v > 0) == y[~a]).sum()
        assert r.n == len(events) and math.isclose(r.accuracy, right / 5 / len(events))
