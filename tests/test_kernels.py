"""Kernel regressions on Gram matrices, against plain numpy on the rows."""

import numpy as np
import pytest

from evtspark.operators import kernels as ke

LAGS = (-1, 0, 1)


def data(seed=3, bins=240):
    """Two kinds of events with kernels of three bins, three units of one shared time course."""
    rng = np.random.default_rng(seed)
    x = {}
    for e in ("p", "q"):
        for b in rng.choice(bins, 50, replace=False):
            for lag in LAGS:
                if 0 <= b + lag < bins:
                    x[(f"{e}@{lag:+04d}", int(b + lag))] = x.get((f"{e}@{lag:+04d}", int(b + lag)), 0) + 1.0
    feats = sorted({f for f, _ in x})
    m = np.array([[x.get((f, b), 0.0) for f in feats] for b in range(bins)])
    w = np.outer(rng.normal(size=len(feats)), (1.0, 0.5, -0.7))
    return feats, m, m @ w + 0.5 * rng.normal(size=(bins, 3))


def frames(spark, feats, m, y):
    fold = lambda b: (b // 20) % 2
    design = [("s", fold(b), b, f, float(m[b, i])) for b in range(len(m)) for i, f in enumerate(feats) if m[b, i]]
    counts = [("s", fold(b), b, u, float(y[b, k])) for b in range(len(m)) for k, u in enumerate("abc")]
    return spark.createDataFrame(design, "s string, fold int, bin int, feature string, value double"), spark.createDataFrame(counts, "s string, fold int, bin int, unit string, y double"), np.array([fold(b) for b in range(len(m))])


def told(df, feats, column="coef"):
    out = {(r.unit, r.feature): r for r in df.collect()}
    return np.array([[out[u, f][column] for u in "abc"] for f in feats]), out


def test_methods_on_the_gram_matrix(spark):
    feats, m, y = data()
    design, counts, fold = frames(spark, feats, m, y)
    a, b = fold == 0, fold == 1
    eye = np.eye(len(feats))
    weighted = lambda B: 1 - ((y[b] - m[b] @ B) ** 2).sum() / ((y[b] - y[b].mean(0)) ** 2).sum()

    B, rows = told(ke.gram_fit(design, counts, ["s"], "unit", "ridge", (0.01, 1.0, 100.0)), feats)
    want = {x: np.linalg.solve(m[a].T @ m[a] + x * eye, m[a].T @ y[a]) for x in (0.01, 1.0, 100.0)}
    best = max(want, key=lambda x: weighted(want[x]))
    r = next(iter(rows.values()))
    assert r.alpha == best and np.allclose(B, want[best]) and r.weighted_r2 == pytest.approx(weighted(want[best])) and r.rank is None

    for nonneg in (False, True):
        B, _ = told(ke.gram_fit(design, counts, ["s"], "unit", "elastic", (0.05,), l1_ratios=(0.7,), nonneg=nonneg), feats)
        slope = -m[a].T @ (y[a] - m[a] @ B) / a.sum() + 0.05 * 0.3 * B  # of all but the sizes
        on = B != 0
        assert np.allclose(slope[on], -0.05 * 0.7 * np.sign(B[on]), atol=1e-6) and ((slope[~on] >= -0.035 - 1e-6) if nonneg else (np.abs(slope[~on]) <= 0.035 + 1e-6)).all()
        assert not nonneg or (B >= 0).all()

    A = np.linalg.pinv(m[a].T @ m[a] + eye)
    W = np.linalg.svd((m[a].T @ y[a]).T @ A @ (m[a].T @ y[a]))[2][:1].T
    B, rows = told(ke.gram_fit(design, counts, ["s"], "unit", "reduced", ranks=(1,)), feats)
    assert np.allclose(B, A @ m[a].T @ y[a] @ W @ W.T) and np.linalg.matrix_rank(B, 1e-9) == 1 and next(iter(rows.values())).rank == 1
    B, rows = told(ke.gram_fit(design, counts, ["s"], "unit", "reduced_ridge", (0.5, 5.0), ranks=(1, 2)), feats)
    options = {}
    for k in (1, 2):
        V = A @ m[a].T @ y[a] @ np.linalg.svd((m[a].T @ y[a]).T @ A @ (m[a].T @ y[a]))[2][:k].T
        z = m[a] @ V
        options |= {(x, k): V @ np.linalg.solve(z.T @ z + x * np.eye(k), z.T @ y[a]) for x in (0.5, 5.0)}
    best = max(options, key=lambda s: weighted(options[s]))
    r = next(iter(rows.values()))
    assert (r.alpha, r.rank) == best and np.allclose(B, options[best])
    B, rows = told(ke.gram_fit(design, counts, ["s"], "unit", "reduced_elastic", (0.001,), ranks=(1,), l1_ratios=(0.5,)), feats)
    assert np.linalg.matrix_rank(B, 1e-9) == 1 and next(iter(rows.values())).weighted_r2 > 0.3
    B, rows = told(ke.gram_fit(design, counts, ["s"], "unit", "mean"), ["mean"])
    assert np.allclose(B[0], y[a].mean(0)) and rows["a", "mean"].r2 == pytest.approx(1 - ((y[b, 0] - y[a, 0].mean()) ** 2).sum() / ((y[b, 0] - y[b, 0].mean()) ** 2).sum())
    with pytest.raises(ValueError):
        ke.gram_fit(design, counts, ["s"], "unit", "other")


def test_kernels_in_time_by_condition_and_left_out(spark):
    feats, m, y = data(4)
    design, counts, fold = frames(spark, feats, m, y)
    a, b = fold == 0, fold == 1
    kernels = {"one": ["p"], "both": ["p", "q"]}
    ve = lambda y, p: 1 - np.var(y - p) / np.var(y)
    left, said = {}, {}
    for name, events in kernels.items():
        own = np.array([f.split("@")[0] in events for f in feats])
        rest = np.linalg.solve(m[a][:, ~own].T @ m[a][:, ~own] + 0.5 * np.eye((~own).sum()), m[a][:, ~own].T @ y[a])
        left[name] = y - m[:, ~own] @ rest
        kernel = np.linalg.solve(m[a][:, own].T @ m[a][:, own] + 0.5 * np.eye(own.sum()), m[a][:, own].T @ left[name][a])
        said[name] = m[:, own] @ kernel
    got = {(r.unit, r.kernel, r.lag): (r.ve, r.n) for r in ke.resolved_significance(design, counts, ["s"], "unit", 0.5, kernels, "p").collect()}
    assert len(got) == 3 * 2 * 3
    for (u, name, lag), (v, n) in got.items():
        on, k = b & (m[:, feats.index(f"p@{lag:+04d}")] != 0), "abc".index(u)
        assert v == pytest.approx(ve(left[name][on, k], said[name][on, k])) and n == on.sum()
    where = spark.createDataFrame([("s", i, "even" if i % 2 == 0 else "odd") for i in range(len(m))], "s string, bin int, cond string")
    for r in ke.condition_significance(design, counts, where, ["s"], "unit", 0.5, kernels, "cond").collect():
        on, k = b & (np.arange(len(m)) % 2 == (r.cond == "odd")), "abc".index(r.unit)
        assert r.ve == pytest.approx(ve(left[r.kernel][on, k], said[r.kernel][on, k]))
    out = {(r.unit, r.kernel): r.ve for r in ke.leave_out_comparison(design, counts, ["s"], "unit", 0.5, kernels).collect()}
    assert len(out) == 9
    for (u, name), v in out.items():
        kept, k = np.array([f.split("@")[0] not in kernels.get(name, []) for f in feats]), "abc".index(u)
        p = m[:, kept] @ np.linalg.solve(m[a][:, kept].T @ m[a][:, kept] + 0.5 * np.eye(kept.sum()), m[a][:, kept].T @ y[a]) if kept.any() else np.zeros_like(y)
        assert v == pytest.approx(ve(y[b, k], p[b, k]))
    assert all(out[u, "full"] > out[u, "one"] for u in "ab") and all(abs(out[u, "both"]) < 1e-9 for u in "abc")
