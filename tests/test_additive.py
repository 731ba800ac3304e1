"""Additive designs against least squares on their columns."""

import numpy as np
import pytest

from evtspark.operators import additive as ad

PLACES = (-60, 0, 60)
CONDITIONS = [(None, None), *((v, None) for v in PLACES), *((None, a) for a in PLACES), *((v, v) for v in PLACES), (-60, 60), (60, -60)]


def table(spark, f, noise=0.1, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(u, v, a, b, k, float(f(v, a, b) * (1 + (u == "t")) + noise * rng.normal())) for u in "st" for v, a in CONDITIONS for b in range(5) for k in (0, 1)]
    return rows, spark.createDataFrame(rows, "unit string, vis int, aud int, bin int, fold int, y double")


def columns(name):
    col = lambda g: [float(g(v, a)) for v, a in CONDITIONS]
    vis, aud = [col(lambda v, a, x=x: v == x) for x in PLACES], [col(lambda v, a, x=x: a == x) for x in PLACES]
    sound, agree = col(lambda v, a: a is not None), [col(lambda v, a, x=x: v == a == x) for x in PLACES]
    return {"vis_aud": [*vis, *aud], "vis": vis, "aud": aud, "aud_any": [sound], "vis_aud_any": [*vis, sound], "baseline": [], "nonlinear": [*vis, *aud, *agree]}[name] + [[1.0] * len(CONDITIONS)]


@pytest.mark.parametrize("ridge", [0.0, 0.7])
def test_designs_are_least_squares(spark, ridge):
    rows, df = table(spark, lambda v, a, b: (v == 60) * b + (a == 0) * 2 + (v == a == 60) * 3)
    got = {(r.unit, r.model): r.ve for r in ad.additive_designs(df, ["unit"], "vis", "aud", "bin", "y", ridge=ridge).collect()}
    assert got.keys() == {(u, m) for u in "st" for m in ad.DESIGNS}
    for (u, m), ve in got.items():
        y = np.zeros((2, len(CONDITIONS), 5))
        for unit, v, a, b, k, x in rows:
            if unit == u:
                y[k, CONDITIONS.index((v, a)), b] = x
        p = y[0]
        if m != "retest":
            x = np.array(columns(m)).T
            rows_, zeros = np.r_[x, ridge * np.eye(x.shape[1])], np.zeros((x.shape[1], 5))
            p = x @ np.linalg.lstsq(rows_ if ridge else x, np.r_[y[0], zeros] if ridge else y[0], rcond=None)[0]
        assert ve == pytest.approx(1 - np.var(y[1] - p) / np.var(y[1]), abs=1e-9), (u, m)


@pytest.mark.parametrize(("f", "want"), [
    (lambda v, a, b: (v == 60) * b + (a == 0) * 2, "vis_aud"), (lambda v, a, b: (v == -60) * b, "vis"), (lambda v, a, b: (a is not None) * b, "aud_any"),
    (lambda v, a, b: (v == 60) * b + (a is not None) * 2, "vis_aud_any"), (lambda v, a, b: (v == 60) + (a == 60) + 4 * (v == a == 60), "nonlinear"), (lambda v, a, b: float(b), "baseline"),
])
def test_the_planted_design_wins(spark, f, want):
    _, df = table(spark, f, 0.3)
    exact = ad.winning_design(ad.additive_designs(table(spark, f, 0.0)[1], ["unit"], "vis", "aud", "bin", "y"), ["unit"]).collect()
    assert all(r.ve == pytest.approx(1.0) for r in exact)
    best = {r.unit: r.ve for r in ad.winning_design(ad.additive_designs(df, ["unit"], "vis", "aud", "bin", "y"), ["unit"]).collect()}
    scores = {(r.unit, r.model): r.ve for r in ad.additive_designs(df, ["unit"], "vis", "aud", "bin", "y").collect()}
    assert all(scores[u, want] >= best[u] - 0.05 for u in "st")


def test_no_rows_and_no_variance(spark):
    _, df = table(spark, lambda v, a, b: 0.0, 0.0)
    assert all(r.ve is None for r in ad.additive_designs(df, ["unit"], "vis", "aud", "bin", "y").collect())
    assert ad.additive_designs(df.limit(0), ["unit"], "vis", "aud", "bin", "y").count() == 0
