"""Choice models, predictor selection and unit matching, against plain Python and planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtspark.operators import choice as ch
from evtspark.operators import unitmatch as um

TRIALS = "subject string, i long, vis double, aud double, response int, feedback int, fold int"


def make_trials(subject, n, log_odds, seed, levels=(-0.8, -0.4, -0.1, 0.0, 0.1, 0.4, 0.8)):
    """Trials whose choices follow log_odds(vis, aud, choice before, outcome before)."""
    rng, rows, before = random.Random(seed), [], (0, 0)
    for i in range(n):
        v, a = rng.choice(levels), rng.choice((-60.0, 0.0, 60.0))
        p = 1 / (1 + math.exp(-log_odds(v / 0.8, a / 60, *before)))
        side = 1 if rng.random() < p else -1
        outcome = 1 if side * (v + a / 100) > 0 else -1
        rows.append((subject, i, v, a, 2 if side == 1 else 1, outcome, rng.randrange(4)))
        before = (side, outcome)
    return rows


def cells_of(spark, rows, fold="fold"):
    return ch.choice_cells(spark.createDataFrame(rows, TRIALS), ["subject"], ["i"], "vis", "aud", "response", "feedback", fold)


def test_cells_hold_the_choice_before(spark):
    rows = [("s", 0, 1.0, 0.0, 2, 1, 0), ("s", 1, -2.0, 5.0, 1, -1, 0), ("s", 2, 1.0, None, 0, 0, 1), ("s", 3, 1.0, 0.0, 2, 1, 1), ("t", 0, 0.0, 0.0, 1, None, 0), ("t", 1, 0.0, 0.0, 1, 1, 0)]
    got = {(r.subject, r.vis, r.aud, r.prev_choice, r.prev_outcome, r.fold, r.n_right, r.n) for r in cells_of(spark, rows).collect()}
    assert got == {("s", 0.5, 0.0, 0, 0, 0, 1.0, 1.0), ("s", -1.0, 1.0, 1, 1, 0, 0.0, 1.0), ("s", 0.5, 0.0, 0, 0, 1, 1.0, 1.0), ("t", 0.0, 0.0, 0, 0, 0, 0.0, 1.0), ("t", 0.0, 0.0, -1, 0, 0, 0.0, 1.0)}


def side(x, right, left, power=1.0):
    return right * abs(x) ** power if x > 0 else -left * abs(x) ** power


PLANTED = {
    "split": (lambda v, a, c, o: 0.3 + side(v, 3, 2, 0.7) + side(a, 1.5, 1.0), {"bias": 0.3, "vis_right": 3, "vis_left": 2, "power": 0.7, "aud_right": 1.5, "aud_left": 1.0}),
    "split_outcomes": (lambda v, a, c, o: side(v, 3, 3, 1.2) + side(a, 1, 1) + c * (0.8 if o == 1 else -0.6), {"power": 1.2, "prev_success": 0.8, "prev_failure": -0.6}),
    "split_win_stay": (lambda v, a, c, o: side(v, 2, 2, 1) + side(a, 1, 1) + 0.5 * c + 0.4 * c * o, {"prev_choice": 0.5, "prev_win": 0.4, "bias": 0}),
    "split_silent_rescaled": (lambda v, a, c, o: (0 if v * a < 0 else side(v, 3, 2, 1)) + side(a, 1, 1) * (1.6 if v * a < 0 else 1), {"conflict_aud": 1.6, "vis_right": 3, "vis_left": 2}),
    "split_rescaled": (lambda v, a, c, o: side(v, 2, 2, 1) * (1.5 if v * a > 0 else 0.5 if v * a < 0 else 1) + side(a, 1, 1) * (0.7 if v * a > 0 else 1), {"agree_vis": 1.5, "conflict_vis": 0.5, "vis_right": 2}),
}


@pytest.mark.parametrize("model", PLANTED)
def test_forms_are_recovered(spark, model):
    odds, want = PLANTED[model]
    fit = ch.fit_choice_models(cells_of(spark, make_trials("s", 60_000, odds, 3)), ["subject"], [model, "bias"]).collect()
    own = next(r for r in fit if r.model == model)
    for name, value in want.items():
        assert own.params[name] == pytest.approx(value, abs=0.25 if name.split("_")[0] in ("agree", "conflict") else 0.15), (name, own.params)
    assert own.train_loss < next(r for r in fit if r.model == "bias").train_loss and own.test_loss is None


def test_fits_are_stationary_and_folds_equal_a_plain_loop(spark):
    """Every form: no parameter can be moved for less loss; a fold's fit is the fit of the other folds' cells; predictions as expressions give the same losses."""
    rows = make_trials("s", 3000, PLANTED["split"][0], 5) + make_trials("t", 2000, PLANTED["split_outcomes"][0], 6)
    cells = cells_of(spark, rows)
    names = list(ch.MODELS)
    fits = ch.fit_choice_models(cells, ["subject"], names, folds=4)
    got = {(r.subject, r.model, r.fold): r for r in fits.collect()}
    assert len(got) == 2 * 5 * len(names)
    for k in (0, 3):
        alone = ch.fit_choice_models(cells.where(F.col("fold") != k), ["subject"], names)
        for r in alone.collect():
            assert got[r.subject, r.model, k].train_loss == pytest.approx(r.train_loss, abs=1e-6) and got[r.subject, r.model, k].n_train == r.n_train
    told = ch.choice_probability(cells, fits, ["subject"])
    bits = -(F.col("n_right") * F.log2("p_right") + (F.col("n") - F.col("n_right")) * F.log2(1 - F.col("p_right")))
    for r in told.where("fold = _fold").groupBy("subject", "model", "fold").agg((F.sum(bits) / F.sum("n")).alias("loss")).collect():
        assert got[r.subject, r.model, r.fold].test_loss == pytest.approx(r.loss, abs=1e-7), r
    whole = told.where("_fold = -1").where("NOT (model = 'split_single' AND vis <> 0 AND aud <> 0)").groupBy("subject", "model").agg((F.sum(bits) / F.sum("n")).alias("loss"))
    base = {(r.subject, r.model): r.loss for r in whole.collect()}
    assert all(base[s, m] == pytest.approx(got[s, m, -1].train_loss, abs=1e-7) for s, m in base)
    moves = spark.createDataFrame([(p, step) for step in (0.02, -0.02) for p in ("bias", "vis_right", "aud_left", "power", "prev_success", "agree_vis", "conflict_aud")], "moved string, by double")
    entries = F.transform(F.map_entries("params"), lambda e: F.struct(e["key"].alias("key"), (e["value"] + F.when(e["key"] == F.col("moved"), F.col("by")).otherwise(0.0)).alias("value")))
    moved = fits.where("fold = -1").crossJoin(moves).withColumn("params", F.map_from_entries(entries)).withColumn("subject", F.concat_ws("/", "subject", "moved", "by"))
    spread = cells.crossJoin(moves).withColumn("subject", F.concat_ws("/", "subject", "moved", "by"))
    worse = ch.choice_probability(spread, moved, ["subject"]).where("NOT (model = 'split_single' AND vis <> 0 AND aud <> 0)").groupBy("subject", "model").agg((F.sum(bits) / F.sum("n")).alias("loss")).collect()
    assert len(worse) == 14 * len(base) and all(r.loss >= base[r.subject.split("/")[0], r.model] - 1e-7 for r in worse)
    best = {r.subject: r.model for r in ch.compare_choice_models(fits, ["subject"]).where("place = 1").collect()}
    assert best["t"] in ("split_outcomes", "split_win_stay") and best["s"] != "bias"


def test_closed_forms_and_fixed_parameters(spark):
    rows = make_trials("s", 2000, PLANTED["split"][0], 8)
    cells = cells_of(spark, rows)
    fits = ch.fit_choice_models(cells, ["subject"], ["bias", "pairs", "split"])
    got = {r.model: r for r in fits.collect()}
    n, right, pairs = len(rows), sum(r[4] == 2 for r in rows), {}
    for r in rows:
        pairs.setdefault((r[2], r[3]), []).append(r[4] == 2)
    entropy = lambda k, n: -sum(x * math.log2(x / n) for x in (k, n - k) if x)
    assert got["bias"].params["bias"] == pytest.approx(math.log(right / (n - right)), abs=1e-6) and got["bias"].train_loss == pytest.approx(entropy(right, n) / n, abs=1e-9)
    assert got["pairs"].train_loss == pytest.approx(sum(entropy(sum(p), len(p)) for p in pairs.values()) / n, abs=1e-6)
    assert ch.choice_entropy(cells, ["subject"]).first().bits == pytest.approx(-got["bias"].train_loss, abs=1e-9)
    shifted = [(s, i, v, a, 2 if random.Random(i).random() < 0.3 else r, f, k) for s, i, v, a, r, f, k in rows]
    moved = ch.fit_choice_models(cells_of(spark, shifted), ["subject"], ["split"], fixed=fits, free=["bias"]).first()
    assert {k: v for k, v in moved.params.items() if k != "bias"} == pytest.approx({k: v for k, v in got["split"].params.items() if k != "bias"}) and moved.params["bias"] > got["split"].params["bias"] + 0.3
    same = ch.fit_choice_models(cells, ["subject"], ["split"], fixed=fits, free=[]).first()
    assert same.params == pytest.approx(got["split"].params) and same.train_loss == pytest.approx(got["split"].train_loss)


def test_a_key_with_one_side_and_an_empty_table(spark):
    one = ch.fit_choice_models(cells_of(spark, [("s", k, 0.5, 0.0, 2, 1, k % 2) for k in range(10)]), ["subject"], ["split", "levels"], folds=2).collect()
    assert len(one) == 6 and all(r.train_loss < 0.1 and math.isfinite(r.params["bias"]) for r in one)
    assert ch.fit_choice_models(cells_of(spark, []), ["subject"], ["split"]).count() == 0


# -- predictors --------------------------------------------------------------------------------------------


def plain_logistic(x, y, penalty=1.0):
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
    return w


def sessions(spark, n=600):
    rng = np.random.default_rng(9)
    rows = []
    for s in ("s", "t"):
        v, a, neurons = rng.choice([0, 0.25, 0.5, 1.0], (n, 2)), rng.choice([0.0, 1.0], (n, 2)), rng.normal(size=(n, 6))
        neurons[:, 5] = 0.01 * neurons[:, 5]  # does not vary enough
        eta = 2 * (v[:, 0] ** 0.5 - v[:, 1] ** 0.5) + 0.8 * (a[:, 0] - a[:, 1]) + (2.0 * neurons[:, 3] + 1.0 * neurons[:, 1] if s == "s" else 0)
        y = rng.random(n) < 1 / (1 + np.exp(-eta))
        rows += [(s, i, float(y[i]), i % 3 == 0, *map(float, v[i]), *map(float, a[i]), *map(float, neurons[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "session string, trial long, choice double, test boolean, visR double, visL double, audR double, audL double, n0 double, n1 double, n2 double, n3 double, n4 double, n5 double")


STIM, NEUR = ["visR", "visL", "audR", "audL"], [f"n{k}" for k in range(6)]


@pytest.mark.parametrize("selector", ["forward", "lasso"])
def test_neurometric_models(spark, selector):
    rows, df = sessions(spark)
    got = {(r.session, r.model, r.part): r for r in ch.neurometric_models(df, ["session"], "choice", "test", STIM, ["visR", "visL"], NEUR, "trial", selector, thresholds=(0.3,)).collect()}
    assert len(got) == 16
    neur = got["s", "neur", "test"]
    assert (neur.taken[:2] == ["n3", "n1"] if selector == "forward" else set(neur.taken) >= {"n3", "n1"}) and "n5" not in neur.taken
    assert got["s", "all", "test"].log_loss < min(got["s", m, "test"].log_loss for m in ("bias", "stim", "neur"))
    assert 0.2 <= got["t", "stim", "test"].power <= 1.0 and got["t", "all", "test"].power == got["t", "stim", "test"].power
    for (s, m, part), r in got.items():  # weights and measures again, row by row
        own = [x for x in rows if x[0] == s]
        names = [*(STIM if m in ("stim", "all") else []), *r.taken]
        cols = {c: np.array([x[4 + k] for x in own]) for k, c in enumerate(STIM + NEUR)}
        x = np.stack([cols[c] ** r.power if c in ("visR", "visL") else cols[c] for c in names] + [np.ones(len(own))], 1)
        y, test = np.array([q[2] for q in own]), np.array([q[3] for q in own])
        w = plain_logistic(x[~test], y[~test])
        assert [r.weights[c] for c in [*names, "bias"]] == pytest.approx(w.tolist(), abs=1e-6)
        rows_ = test if part == "test" else ~test
        eta, z = x[rows_] @ w, y[rows_]
        p = 1 / (1 + np.exp(-eta))
        wins = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in np.round(eta[z == 1], 12) for b in np.round(eta[z == 0], 12)]
        assert r.log_loss == pytest.approx(-np.mean(z * np.log(p) + (1 - z) * np.log(1 - p)), abs=1e-9) and r.auc == pytest.approx(np.mean(wins), abs=1e-3 if m == "bias" else 1e-6)
        assert r.accuracy == pytest.approx(np.mean((eta > 0) == (z == 1))) and r.balanced_accuracy == pytest.approx(np.mean([np.mean(eta[z == 1] > 0), np.mean(eta[z == 0] <= 0)])) and r.n == rows_.sum()


def test_forward_selection_is_the_plain_greedy_choice():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 5))
    y = (rng.random(150) < 1 / (1 + np.exp(-(1.5 * x[:, 2] - 1.2 * x[:, 4])))).astype(float)
    fold = np.arange(150) % 5
    taken, best = [], -np.inf
    while len(taken) < 5:
        share = {}
        for j in set(range(5)) - set(taken):
            m = np.c_[x[:, [*taken, j]], np.ones(150)]
            share[j] = np.mean([np.mean((m[fold == k] @ plain_logistic(m[fold != k], y[fold != k]) > 0) == (y[fold == k] == 1)) for k in range(5)])
        j = min(share, key=lambda j: (-share[j], j))
        if share[j] - best < 0.01:
            break
        best, taken = share[j], [*taken, j]
    assert ch.forward_selection(x, y, fold, list(range(5)), 0.01) == taken and taken[:2] == [2, 4]


def test_sparse_logistic_is_optimal():
    rng = np.random.default_rng(11)
    x = np.c_[rng.normal(size=(200, 8)), np.ones(200)]
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    w = ch.sparse_logistic(x, y, penalty=5.0)
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y)
    assert np.allclose(slope[w != 0], -5 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(slope[w == 0]) <= 5 + 1e-6).all() and 0 < (w != 0).sum() < 9


def test_one_class_and_no_neurons(spark):
    rows = [("s", k, 1.0, k % 2 == 0, 0.5, 0.0, 0.0, 0.0) for k in range(20)]
    df = spark.createDataFrame(rows, "session string, trial long, choice double, test boolean, visR double, visL double, audR double, audL double")
    got = ch.neurometric_models(df, ["session"], "choice", "test", STIM, ["visR"], [], "trial").collect()
    assert len(got) == 8 and all(r.log_loss is None and r.taken == [] for r in got)
    assert ch.neurometric_models(df.limit(0), ["session"], "choice", "test", STIM, ["visR"], [], "trial").count() == 0


# -- units over days ---------------------------------------------------------------------------------------


def day_responses(rng, days=4, units=25, stimuli=60, shared=12):
    """Units' tunings stay over days, in a shared space of stimuli; the order of units is dealt anew each day."""
    basis = np.linalg.qr(rng.normal(size=(stimuli, shared)))[0]
    tuning = basis @ rng.normal(size=(shared, units))
    out, truth = [], {}
    for d in range(days):
        names = rng.permutation(units)
        truth[d] = {int(n): k for k, n in enumerate(names)}
        x = tuning + 0.02 * rng.normal(size=tuning.shape)
        out += [(d, int(n), s, float(x[s, k])) for k, n in enumerate(names) for s in range(stimuli)]
    return out, truth


def plain_weights(rows, day_list, k):
    """Whitening by each day's SVD, an SVD of all days' whitened responses, and the pseudo-inverse."""
    m = {d: {} for d in day_list}
    for d, u, s, x in rows:
        m[d].setdefault(u, {})[s] = x
    x = {d: np.array([[m[d][u][s] for u in sorted(m[d])] for s in sorted(next(iter(m[d].values())))]) for d in day_list}
    white = []
    for d in day_list:
        u, _, vt = np.linalg.svd(x[d], full_matrices=False)
        white.append(u @ vt)
    whole = np.concatenate(white, 1)
    u = np.linalg.svd(whole - whole.mean(0), full_matrices=False)[0][:, :k]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(k)] < 0, -1, 1)
    return {d: dict(zip(sorted(m[d]), (np.linalg.pinv(u) @ x[d]).T, strict=True)) for d in day_list}


def test_units_are_matched_over_four_days(spark):
    rows, truth = day_responses(np.random.default_rng(12))
    df = spark.createDataFrame(rows, "day int, unit int, stim int, x double")
    w = um.shared_weights(df, "day", "unit", "stim", "x", 12)
    got, want = {}, plain_weights(rows, range(4), 12)
    for r in w.collect():
        got.setdefault((r.day, r.unit), {})[r.component] = r.weight
    assert len(got) == 100
    vec = lambda d, u: np.array([got[d, u][c] for c in range(12)])
    for d, e in ((0, 1), (2, 3)):  # correlations of weights, whatever turn equal components took
        for u in range(0, 25, 5):
            assert vec(d, u) @ vec(e, u) == pytest.approx(want[d][u] @ want[e][u], abs=0.02)
    places = spark.createDataFrame([(d, u, 0.0, 100.0 * k + (500.0 if (d, k) == (3, 7) else 0.0)) for d, own in truth.items() for u, k in own.items()], "day int, unit int, x double, depth double")
    pairs = um.match_days(w, "day", "unit", places)
    found = pairs.collect()
    assert {(r.day_a, r.day_b) for r in found} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert all(truth[r.day_a][r.a] == truth[r.day_b][r.b] and r.r > 0.5 and r.isolation > 0.05 and r.distance <= 50 for r in found)
    assert len(found) >= 0.9 * (6 * 25 - 3) and not any(truth[3].get(r.b) == 7 and r.day_b == 3 for r in found)
    tracks = um.track_units(pairs, [0, 1, 2, 3]).collect()
    assert len(tracks) >= 20 and all(len({truth[d][t[f"u{d}"]] for d in range(4)}) == 1 for t in tracks)
    assert um.match_days(w, "day", "unit", following=True).select("day_a", "day_b").distinct().count() == 3


def test_isolation_unique_targets_and_reliability(spark):
    w = [(d, u, c, x) for d in (0, 1) for u, v in {0: [1, 0, 0], 1: [1, 0.01, 0], 2: [0, 1, 0.2]}.items() for c, x in enumerate(v)]
    weights = spark.createDataFrame([(d, u, c, float(x)) for d, u, c, x in w], "day int, unit int, component int, weight double")
    got = um.match_days(weights, "day", "unit", isolation=0.05).collect()
    assert [(r.a, r.b) for r in got] == [(2, 2)]  # 0 and 1 are not told apart
    lone = um.match_days(weights.where("NOT (day = 1 AND unit > 0)"), "day", "unit").collect()
    assert lone == []  # no second best, no isolation
    both = um.match_days(weights.where("NOT (day = 1 AND unit = 1)"), "day", "unit", isolation=0.0).collect()
    assert sorted((r.a, r.b) for r in both) == [(0, 0), (2, 2)]  # units 0 and 1 have one match: the smaller stays
    rng = random.Random(13)
    tuned = [rng.random() for _ in range(20)]
    rows = [(0, u, s, r, {0: tuned[s], 1: rng.random(), 2: 0.01 * tuned[s]}[u] + 0.05 * rng.random() * (u < 2)) for u in range(3) for s in range(20) for r in range(6)]
    kept = um.reliable_units(spark.createDataFrame(rows, "day int, unit int, stim int, rep int, x double"), "day", "unit", "stim", "rep", "x", 0.1, 0.7).collect()
    assert [r.unit for r in kept] == [0] and kept[0].reliability > 0.9
    empty = spark.createDataFrame([], "day int, unit int, stim int, x double")
    assert um.match_days(um.shared_weights(empty, "day", "unit", "stim", "x"), "day", "unit").count() == 0


def plain_fingerprints(c1, c2, seeds):
    """The loop: all fingerprints' correlations are computed again for every pair added."""
    g, h = [a for a, _ in seeds], [b for _, b in seeds]
    left, right, out = [i for i in range(len(c1)) if i not in g], [j for j in range(len(c2)) if j not in h], []
    while left and right:
        best = max(((np.corrcoef(c1[i, g], c2[j, h])[0, 1], -i, -j) for i in left for j in right), key=lambda t: (round(t[0], 12), *t[1:]))
        g.append(-best[1])
        h.append(-best[2])
        left.remove(g[-1])
        right.remove(h[-1])
        up = np.triu_indices(len(g), 1)
        out.append((g[-1], h[-1], best[0], np.corrcoef(c1[np.ix_(g, g)][up], c2[np.ix_(h, h)][up])[0, 1]))
    return out


def test_fingerprints_equal_the_plain_loop(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(14, 40)) + rng.normal(size=(1, 40))
    order = rng.permutation(14)
    c1, c2 = np.corrcoef(x + 0.4 * rng.normal(size=x.shape)), np.corrcoef((x + 0.4 * rng.normal(size=x.shape))[order][:12])
    where = {int(o): j for j, o in enumerate(order[:12])}
    seeds = [(i, where[i]) for i in range(14) if i in where][:4]
    long = lambda c: spark.createDataFrame([(d, i, j, float(c[i, j])) for d in ("p", "q") for i in range(len(c)) for j in range(len(c))], "days string, a int, b int, r double")
    got = um.fingerprint_match(long(c1), long(c2), spark.createDataFrame([(d, *s) for d in ("p", "q") for s in seeds], "days string, a int, b int"), ["days"]).orderBy("days", "step").collect()
    want = plain_fingerprints(c1, c2, seeds)
    for d in ("p", "q"):
        own = [r for r in got if r.days == d]
        assert [(r.a, r.b) for r in own[:4]] == sorted(seeds) and [r.step for r in own] == list(range(-3, 9))
        for r, (a, b, f, p) in zip(own[4:], want, strict=True):
            assert (r.a, r.b) == (a, b) and r.fingerprint == pytest.approx(f, abs=1e-9) and r.population == pytest.approx(p, abs=1e-9)
    none = um.fingerprint_match(long(c1), long(c2), spark.createDataFrame([], "days string, a int, b int"), ["days"])
    assert none.count() == 0  # nothing to compare with


def test_cells_by_slices_are_those_of_one_window(spark):
    from evtspark.operators.stats import cv_split

    rng = np.random.default_rng(8)
    rows = [(s, i, float(rng.integers(-2, 3)), float(rng.integers(-1, 2)), int(rng.integers(0, 3)) if i != 7 else 9, int(rng.integers(-1, 2))) for s in ("s", "t") for i in range(300)]
    t = spark.createDataFrame(rows, TRIALS.removesuffix(", fold int"))
    folds = [cv_split(t, ["subject", "response"], "i", 5, **k) for k in ({}, {"width": 9000.0})]
    assert [x.dtypes for x in folds][0] == folds[1].dtypes and folds[0].count() == 598
    cells = [ch.choice_cells(f, ["subject"], ["i"], "vis", "aud", "response", "feedback", "fold", **k) for f, k in zip(folds, ({}, {"bucket": 40.0}), strict=True)]
    one, many = (sorted(tuple(r) for r in c.collect()) for c in cells)
    assert one == many and cells[0].dtypes == cells[1].dtypes
