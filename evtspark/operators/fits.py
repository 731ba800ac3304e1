"""Regressions and models: sums over rows in Spark, tiny solves per group in numpy.

A fit that needs only sums (ridge, reduced rank, additive models) never sees rows
outside Spark: the Gram matrix of a group is aggregated first. Models that are
fitted iteratively see one group's aggregated cells.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtspark.staging import stage

#: Rows of the small groups that one task's call solves, about, and cells of the designs that are solved at once.
DEALT_ROWS, SOLVED = 100_000, 4_000_000


def event_design(events: DataFrame, by: list[str], feature: str, bin_col: str, value: str, lags: tuple[int, int]) -> DataFrame:
    """(by, bin, feature, value): a row per event and lag; equal cells add up; cells of value 0 do not exist."""
    spread = events.withColumn("_lag", F.explode(F.sequence(F.lit(lags[0]), F.lit(lags[1]))))
    name = F.concat_ws("@", F.col(feature), F.format_string("%+04d", F.col("_lag")))
    return spread.select(*by, (F.col(bin_col) + F.col("_lag")).alias("bin"), name.alias("feature"), F.col(value).alias("value")).groupBy(*by, "bin", "feature").agg(F.sum("value").alias("value")).where("value <> 0")


def gram(design: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """(by, fold, f1, f2, g): sums of products of the features that meet in a bin."""
    keys = [*by, fold, "bin"]
    a = design.select(*keys, F.col("feature").alias("f1"), F.col("value").alias("_a"))
    b = design.select(*keys, F.col("feature").alias("f2"), F.col("value").alias("_b"))
    return a.join(b, keys).groupBy(*by, fold, "f1", "f2").agg(F.sum(F.col("_a") * F.col("_b")).alias("g"))


def fold_sums(design: DataFrame, counts: DataFrame, by: list[str], unit: str, fold: str = "fold") -> DataFrame:
    """(by, part, k, a, b, v): all that a linear fit needs of a fold: products of features (g), of features and units (x), squares (q), sums (s) and numbers (n) of a unit."""
    keys = [*by, fold]
    g = gram(design, by, fold).select(*keys, F.struct(F.lit("g").alias("k"), F.col("f1").alias("a"), F.col("f2").alias("b"), F.col("g").alias("v")).alias("e"))
    xy = design.join(counts, [*keys, "bin"]).groupBy(*keys, "feature", unit).agg(F.sum(F.col("value") * F.col("y")).alias("v"))
    xy = xy.select(*keys, F.struct(F.lit("x").alias("k"), F.col("feature").alias("a"), F.col(unit).cast("string").alias("b"), F.col("v").cast("double").alias("v")).alias("e"))
    yy = counts.groupBy(*keys, unit).agg(F.sum(F.col("y") * F.col("y")).cast("double").alias("_q"), F.sum("y").cast("double").alias("_s"), F.count("*").cast("double").alias("_n"))
    parts = [yy.select(*keys, F.struct(F.lit(k).alias("k"), F.col(unit).cast("string").alias("a"), F.lit("").alias("b"), F.col(f"_{k}").alias("v")).alias("e")) for k in ("q", "s", "n")]
    rows = g.unionByName(xy)
    for p in parts:
        rows = rows.unionByName(p)
    return rows.select(*by, F.col(fold).cast("int").alias("part"), "e.*")


def matrices(pdf):
    """(features, units, G, X, S) of one group's ``fold_sums``, the first axis being the fold."""
    import numpy as np

    feats = sorted(set(pdf.loc[pdf.k == "g", "a"]))
    units = sorted(set(pdf.loc[pdf.k == "n", "a"]))
    fi, ui = {f: i for i, f in enumerate(feats)}, {u: i for i, u in enumerate(units)}
    G, X = np.zeros((2, len(feats), len(feats))), np.zeros((2, len(feats), len(units)))
    S = {k: np.zeros((2, len(units))) for k in "qsn"}
    for r in pdf.itertuples():
        if r.k == "g":
            G[r.part, fi[r.a], fi[r.b]] = r.v
        elif r.k == "x" and r.a in fi:
            X[r.part, fi[r.a], ui[r.b]] = r.v
        elif r.k in S:
            S[r.k][r.part, ui[r.a]] = r.v
    return feats, units, G, X, S


def ridge_fit(design: DataFrame, counts: DataFrame, by: list[str], unit: str, alphas: list[float], fold: str = "fold", kind: str = "ridge", rank: int | None = None) -> DataFrame:
    """(by, unit, feature, coef, alpha, r2): fold 0 fits, fold 1 chooses alpha by R2.

    kind: ridge (a linear kernel gives the same), lasso or nonneg, by coordinate
    descent on the Gram matrix; ``rank`` cuts the ridge solution of a group's units
    to that rank (reduced-rank regression). ``counts(by, fold, bin, unit, y)``.
    """
    flat = fold_sums(design, counts, by, unit, fold)
    schema = ", ".join([*(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by), "unit string, feature string, coef double, alpha double, r2 double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        feats, units, G, X, S = matrices(pdf)
        best = None
        for alpha in alphas:
            if kind == "ridge":
                B = np.linalg.solve(G[0] + alpha * np.eye(len(feats)), X[0])
            else:
                B, n = np.zeros_like(X[0]), np.maximum(S["n"][0], 1)
                for _ in range(200):
                    for j in range(len(feats)):
                        rho = X[0][j] - G[0][j] @ B + G[0][j, j] * B[j]
                        new = np.sign(rho) * np.maximum(np.abs(rho) - alpha * n, 0) / max(G[0][j, j], 1e-12)
                        B[j] = np.maximum(new, 0) if kind == "nonneg" else new
            if rank is not None and len(units):
                V = np.linalg.svd(X[0].T @ np.linalg.pinv(G[0] + alpha * np.eye(len(feats))) @ X[0])[0][:, :rank]
                B = B @ V @ V.T
            rest = S["q"][1] - 2 * (B * X[1]).sum(0) + np.einsum("fu,fg,gu->u", B, G[1], B)
            total = S["q"][1] - S["s"][1] ** 2 / np.maximum(S["n"][1], 1)
            r2 = 1 - rest / np.where(total > 0, total, np.nan)
            if best is None or np.nanmean(r2) > best[0]:
                best = (np.nanmean(r2) if np.isfinite(r2).any() else -np.inf, alpha, B, r2)
        _, alpha, B, r2 = best
        out = pd.DataFrame([(u, f, B[i, j], alpha, r2[j]) for j, u in enumerate(units) for i, f in enumerate(feats)], columns=["unit", "feature", "coef", "alpha", "r2"])
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "unit", "feature", "coef", "alpha", "r2"]]

    return flat.groupBy(*by).applyInPandas(solve, schema)


def response_kernels(coefs: DataFrame) -> DataFrame:
    """Coefficients with their event and lag."""
    return coefs.withColumns({"event": F.substring_index("feature", "@", 1), "lag": F.substring_index("feature", "@", -1).cast("int")})


def predict(design: DataFrame, coefs: DataFrame, by: list[str]) -> DataFrame:
    """(by, fold, bin, unit, predicted)."""
    return design.join(coefs.select(*by, "unit", "feature", "coef"), [*by, "feature"]).groupBy(*by, "fold", "bin", "unit").agg(F.sum(F.col("value") * F.col("coef")).alias("predicted"))


def kernel_significance(design: DataFrame, counts: DataFrame, by: list[str], unit: str, alphas: list[float], events: list[str]) -> DataFrame:
    """(by, unit, event, alpha, ve): share of the squares on fold 1 that the model without the event leaves and the event's kernel explains.

    The model without the event is a ridge on fold 0, and the kernel a ridge on what
    that leaves there, both with the alpha of the best ``ve`` on average over units.
    All are blocks of one Gram matrix, so rows are read once for all events. An event
    without features has null alpha and ve; a unit without a rest has null ve.
    """
    schema = ", ".join([*(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by), "unit string, event string, alpha double, ve double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        feats, units, G, X, S = matrices(pdf)
        out = []
        for e in events:
            own = np.array([f.startswith(f"{e}@") for f in feats], bool)
            best = (-np.inf, None, np.full(len(units), np.nan))
            for alpha in alphas if own.any() else ():
                rest = np.linalg.solve(G[0][~own][:, ~own] + alpha * np.eye((~own).sum()), X[0][~own])
                left = [X[k][own] - G[k][own][:, ~own] @ rest for k in (0, 1)]  # the kernel's products with what is left
                kernel = np.linalg.solve(G[0][own][:, own] + alpha * np.eye(own.sum()), left[0])
                squares = S["q"][1] - 2 * (rest * X[1][~own]).sum(0) + np.einsum("fu,fg,gu->u", rest, G[1][~own][:, ~own], rest)
                after = squares - 2 * (kernel * left[1]).sum(0) + np.einsum("fu,fg,gu->u", kernel, G[1][own][:, own], kernel)
                ve = 1 - after / np.where(squares > 1e-12, squares, np.nan)
                mean = np.mean(ve[np.isfinite(ve)]) if np.isfinite(ve).any() else -np.inf
                if best[1] is None or mean > best[0]:
                    best = (mean, alpha, ve)
            out += [(u, e, best[1], v) for u, v in zip(units, best[2], strict=True)]
        made = pd.DataFrame(out, columns=["unit", "event", "alpha", "ve"]).astype({"alpha": float, "ve": float})
        for k in by:
            made[k] = pdf[k].iloc[0]
        return made[[*by, "unit", "event", "alpha", "ve"]]

    made = fold_sums(design, counts, by, unit).groupBy(*by).applyInPandas(solve, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("alpha", "ve")})


def additive_models(psth: DataFrame, by: list[str], vis: str, aud: str, value: str, fold: str = "fold") -> DataFrame:
    """(by, model, ve): designs on condition means (fold 0 fits, fold 1 tests): full, vis, aud, additive and baseline.

    The designs are those of a condition grid; a group holds one unit's grid.
    """
    rows = psth.select(*by, F.col(fold).alias("fold_"), F.col(vis).alias("v"), F.col(aud).alias("a"), F.col(value).alias("y"))
    schema = ", ".join([*(f"{k} {psth.schema[k].dataType.simpleString()}" for k in by), "model string, ve double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        train, test = pdf[pdf.fold_ == 0], pdf[pdf.fold_ == 1]
        vs, as_ = sorted(set(pdf.v)), sorted(set(pdf.a))

        def design(d, model):
            cols = [np.ones(len(d))]
            if model in ("vis", "additive"):
                cols += [(d.v == x).to_numpy(float) for x in vs[1:]]
            if model in ("aud", "additive"):
                cols += [(d.a == x).to_numpy(float) for x in as_[1:]]
            if model == "full":
                cols += [((d.v == x) & (d.a == y)).to_numpy(float) for x in vs for y in as_]
            return np.stack(cols, 1)

        out = []
        for model in ("full", "vis", "aud", "additive", "baseline"):
            ve = np.nan
            if len(train) and len(test) > 1:
                b = np.linalg.lstsq(design(train, model), train.y.to_numpy(float), rcond=None)[0]
                y = test.y.to_numpy(float)
                ve = 1 - np.var(y - design(test, model) @ b) / np.var(y) if np.var(y) > 0 else np.nan
            out.append((model, ve))
        made = pd.DataFrame(out, columns=["model", "ve"])
        for k in by:
            made[k] = pdf[k].iloc[0]
        return made[[*by, "model", "ve"]]

    return rows.groupBy(*by).applyInPandas(solve, schema)


def levenberg_marquardt(f, p0, x, y, steps: int = 60):
    """Least squares by damped Gauss-Newton with a numeric Jacobian; None if it does not get better."""
    import numpy as np

    p, lam = np.array(p0, float), 1e-2
    r = f(p, x) - y
    for _ in range(steps):
        J = np.stack([(f(p + e, x) - f(p - e, x)) / (2 * h) for e, h in ((np.eye(len(p))[k] * max(1e-5, abs(p[k]) * 1e-5), max(1e-5, abs(p[k]) * 1e-5)) for k in range(len(p)))], 1)
        try:
            step = np.linalg.solve(J.T @ J + lam * np.diag(np.diag(J.T @ J) + 1e-12), -J.T @ r)
        except np.linalg.LinAlgError:
            return None
        new = f(p + step, x) - y
        if new @ new < r @ r:
            done = r @ r - new @ new < 1e-12 * (r @ r)
            p, r, lam = p + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
    return p if np.isfinite(p).all() else None


def gaussian(p, x):
    import numpy as np

    return p[0] + p[1] * np.exp(-0.5 * ((x - p[2]) / (abs(p[3]) + 1e-9)) ** 2)


def split_gaussian(p, x):
    """Different widths on both sides of the centre."""
    import numpy as np

    s = np.where(x < p[2], abs(p[3]), abs(p[4])) + 1e-9
    return p[0] + p[1] * np.exp(-0.5 * ((x - p[2]) / s) ** 2)


def gaussian_2d(p, xy):
    import numpy as np

    return p[0] + p[1] * np.exp(-0.5 * (((xy[0] - p[2]) / (abs(p[4]) + 1e-9)) ** 2 + ((xy[1] - p[3]) / (abs(p[5]) + 1e-9)) ** 2))


def fit_tuning(curves: DataFrame, by: list[str], x: str, y: str, split: bool = False, fold: str | None = None) -> DataFrame:
    """(by, baseline, gain, centre, width, ve): Gaussian after linear upsampling; null where the fit fails. A group is one unit's curve.

    With ``fold`` a unit has a curve per fold: the one of the smallest fold is
    fitted, and there is a row per fold with that fit's variance explained of the
    fold's curve (null where it is flat). Points without a place or value go.
    """
    numbers = ["baseline", "gain", "centre", "width", "ve"]
    made = [*([fold] if fold else []), *numbers]
    schema = ", ".join([*(f"{k} {curves.schema[k].dataType.simpleString()}" for k in [*by, *made[:-5]]), *(f"{c} double" for c in numbers)])
    points = curves.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(fold).isNotNull() if fold else F.lit(True)))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        f = split_gaussian if split else gaussian
        parts = [(k, d.sort_values(x)) for k, d in pdf.groupby(fold)] if fold else [(None, pdf.sort_values(x))]
        xs, ys = (parts[0][1][c].to_numpy(float) for c in (x, y))
        p = None
        if len(xs) > 3 and np.ptp(ys) > 0:
            fx = np.linspace(xs[0], xs[-1], 100 * (len(xs) - 1) + 1)
            k = ys.argmax()
            p0 = [ys.min(), np.ptp(ys), xs[k], np.ptp(xs) / 4] + ([np.ptp(xs) / 4] if split else [])
            p = levenberg_marquardt(f, p0, fx, np.interp(fx, xs, ys))
        rows = []
        for k, d in parts:
            at, own = (d[c].to_numpy(float) for c in (x, y))
            fit = [None] * 5 if p is None else [p[0], p[1], p[2], abs(p[3]), 1 - np.var(own - f(p, at)) / np.var(own) if np.ptp(own) > 0 else None]
            rows.append([*(pdf[c].iloc[0] for c in by), *([k] if fold else []), *fit])
        return pd.DataFrame(rows, columns=[*by, *made]).astype({c: float for c in numbers})

    return points.groupBy(*by).applyInPandas(solve, schema)


def fit_rf(maps: DataFrame, by: list[str], x: str, y: str, z: str, degrees: float = 7.5) -> DataFrame:
    """(by, azimuth, elevation, sd_x, sd_y, ve): 2-D Gaussian per unit, in degrees. A group is one unit's map."""
    schema = ", ".join([*(f"{k} {maps.schema[k].dataType.simpleString()}" for k in by), "azimuth double, elevation double, sd_x double, sd_y double, ve double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        xs, ys, zs = (pdf[c].to_numpy(float) for c in (x, y, z))
        p, k = None, int(np.abs(zs - np.median(zs)).argmax())
        if len(zs) > 6 and np.ptp(zs) > 0:
            p = levenberg_marquardt(gaussian_2d, [np.median(zs), zs[k] - np.median(zs), xs[k], ys[k], 1.0, 1.0], (xs, ys), zs)
        row = [np.nan] * 5 if p is None else [p[2] * degrees, p[3] * degrees, abs(p[4]) * degrees, abs(p[5]) * degrees, 1 - np.var(zs - gaussian_2d(p, (xs, ys))) / np.var(zs)]
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), *row]], columns=[*by, "azimuth", "elevation", "sd_x", "sd_y", "ve"])

    return maps.groupBy(*by).applyInPandas(solve, schema)


def pc1_weights(raster: DataFrame, by: list[str], trial: str, value: str, bin_col: str = "bin") -> DataFrame:
    """(by, trial, weight): size of each trial's part in the first component of the trials by bins matrix.

    The matrix of bins by bins is summed over the trials; a group is its squared number
    of bins. Cells that lack are 0, repeated ones are added; weights of a unit
    without points are 0.
    """
    cells = raster.groupBy(*by, trial, bin_col).agg(F.sum(F.col(value).cast("double")).alias("_v")).where("_v <> 0")
    rows = cells.groupBy(*by, trial).agg(F.collect_list(F.struct(bin_col, "_v")).alias("_row"))
    pairs = rows.select(*by, "_row", F.explode("_row").alias("_a")).select(*by, "_a", F.explode("_row").alias("_b"))
    gram = pairs.groupBy(*by, F.col(f"_a.{bin_col}").alias("_i"), F.col(f"_b.{bin_col}").alias("_j")).agg(F.sum(F.col("_a._v") * F.col("_b._v")).alias("_g"))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        m = pdf.pivot(index="_i", columns="_j", values="_g").fillna(0.0)
        size, vectors = np.linalg.eigh(m.to_numpy(float))
        out = pd.DataFrame({bin_col: m.index, "_part": vectors[:, -1] / np.sqrt(size[-1])})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, bin_col, "_part"]]

    kind = lambda c: f"{c} {raster.schema[c].dataType.simpleString()}"
    first = gram.groupBy(*by).applyInPandas(solve, ", ".join([*map(kind, [*by, bin_col]), "_part double"]))
    found = cells.join(first, [*by, bin_col]).groupBy(*by, trial).agg(F.abs(F.sum(F.col("_v") * F.col("_part"))).alias("weight"))
    return raster.select(*by, trial).distinct().join(found, [*by, trial], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def mean_weights(weights: DataFrame, trials: DataFrame, by: list[str], trial: str, azimuth: str) -> DataFrame:
    """(by, azimuth, weight): a unit's tuning by the mean size of its trials' weights; trials without an azimuth are one key."""
    return weights.join(trials.select(trial, azimuth), trial).groupBy(*by, azimuth).agg(F.avg("weight").alias("weight"))


def enhancement_index(df: DataFrame, by: list[str], kind: str, value: str) -> DataFrame:
    """(by, index): (mean multi - mean vis - mean aud) / sqrt(var vis + var aud), the limit of resampling sums of both."""
    pick = lambda k: F.when(F.col(kind) == k, F.col(value))
    sd = F.sqrt(F.var_pop(pick("visual")) + F.var_pop(pick("auditory")))
    return df.groupBy(*by).agg(F.try_divide(F.avg(pick("coherent")) - F.avg(pick("visual")) - F.avg(pick("auditory")), sd).alias("index"))


def enhancement_bootstrap(df: DataFrame, by: list[str], kind: str, value: str, order: list[str], draws: int = 10_000, seed: int = 1) -> DataFrame:
    """(by, index): the same from ``draws`` sums of a visual and an auditory trial, drawn with repeats by a seeded hash; trials are numbered by ``order``."""
    from evtspark.operators.stats import shuffle_hash

    known = df.where(F.col(value).isNotNull())
    ranked = known.where(F.col(kind).isin("visual", "auditory")).select(*by, F.col(kind).alias("_kind"), F.col(value).alias("_y"), (F.row_number().over(Window.partitionBy(*by, kind).orderBy(*order)) - 1).cast("long").alias("_i"))
    count = lambda k: F.count(F.when(F.col(kind) == k, F.lit(1)))
    sizes = known.groupBy(*by).agg(count("visual").alias("_nv"), count("auditory").alias("_na"), F.avg(F.when(F.col(kind) == "coherent", F.col(value))).alias("_multi")).where("_nv > 0 AND _na > 0")
    drawn = sizes.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    for k, n, at in (("visual", "_nv", 2 * seed), ("auditory", "_na", 2 * seed + 1)):
        side = ranked.where(F.col("_kind") == k).select(*by, "_i", F.col("_y").alias(f"_{k}"))
        drawn = drawn.withColumn("_i", shuffle_hash(F.col("_d"), F.lit(at).cast("long")) % F.col(n)).join(side, [*by, "_i"]).drop("_i")
    both = F.col("_visual") + F.col("_auditory")
    return drawn.groupBy(*by).agg(F.try_divide(F.first("_multi") - F.avg(both), F.stddev_pop(both)).alias("index"))


def choice_glm(cells: DataFrame, by: list[str], exponents: list[float], free: tuple[str, ...] = ("bias", "visR", "visL", "audR", "audL"), fixed: DataFrame | None = None) -> DataFrame:
    """(by, bias, visR, visL, audR, audL, n_exp, loss): log-odds of right = bias + visR v^N [v>0] - visL |v|^N [v<0] + audR a [a>0] - audL |a| [a<0].

    ``cells(by, vis, aud, n_right, n)`` are counts per condition; Newton steps per
    key and exponent, the best exponent stays. Terms not ``free`` are 0, or what
    ``fixed`` (a fit of the same keys) says. loss is the mean -log2 p.
    """
    names = ["bias", "visR", "visL", "audR", "audL"]
    schema = ", ".join([*(f"{k} {cells.schema[k].dataType.simpleString()}" for k in by), *(f"{n} double" for n in names), "n_exp double, loss double"])
    rows = cells if fixed is None else cells.join(fixed.select(*by, *[F.col(n).alias(f"fixed_{n}") for n in names], F.col("n_exp").alias("fixed_n")), by)

    def solve(pdf):
        import numpy as np
        import pandas as pd

        v, a, k, n = (pdf[c].to_numpy(float) for c in ("vis", "aud", "n_right", "n"))
        start = np.array([pdf[f"fixed_{c}"].iloc[0] if f"fixed_{c}" in pdf else 0.0 for c in names], float)
        own = [i for i, c in enumerate(names) if c in free]
        best = None
        for e in [pdf["fixed_n"].iloc[0]] if "fixed_n" in pdf else exponents:
            s = np.abs(v) ** e
            X = np.stack([np.ones_like(v), s * (v > 0), -s * (v < 0), np.abs(a) * (a > 0), -np.abs(a) * (a < 0)], 1)
            b = start.copy()
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
                H = (X[:, own] * (n * p * (1 - p))[:, None]).T @ X[:, own] + 1e-6 * np.eye(len(own))
                step = np.linalg.solve(H, X[:, own].T @ (k - n * p) - 1e-6 * b[own])
                b[own] += np.clip(step, -5, 5)
                if np.abs(step).max() < 1e-9:
                    break
            p = np.clip(1 / (1 + np.exp(-np.clip(X @ b, -30, 30))), 1e-12, 1 - 1e-12)
            loss = -(k * np.log2(p) + (n - k) * np.log2(1 - p)).sum() / max(n.sum(), 1)
            if best is None or loss < best[1]:
                best = (b, loss, e)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), *best[0], best[2], best[1]]], columns=[*by, *names, "n_exp", "loss"])

    return rows.groupBy(*by).applyInPandas(solve, schema)


def glm_loss(cells: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """(by, loss): mean -log2 p of the cells under given parameters (columns of ``choice_glm``)."""
    s = lambda c: F.pow(F.abs(c), F.col("n_exp"))
    seen = F.when(F.col("vis") > 0, F.col("visR") * s(F.col("vis"))).otherwise(-F.col("visL") * s(F.col("vis")))
    heard = F.when(F.col("aud") > 0, F.col("audR") * F.abs("aud")).otherwise(-F.col("audL") * F.abs("aud"))
    p = F.greatest(F.least(1 / (1 + F.exp(-(F.col("bias") + seen + heard))), F.lit(1 - 1e-12)), F.lit(1e-12))
    told = cells.join(params.select(*by, "bias", "visR", "visL", "audR", "audL", "n_exp"), by).withColumn("_p", p)
    loss = -F.sum(F.col("n_right") * F.log2("_p") + (F.col("n") - F.col("n_right")) * F.log2(1 - F.col("_p"))) / F.sum("n")
    return told.groupBy(*by).agg(loss.alias("loss"))


def glm_compare(control: DataFrame, perturbed: DataFrame, by: list[str], exponents: list[float]) -> DataFrame:
    """(by, model, loss) on perturbed cells: control parameters as they are, with a free bias, and all free."""
    base = choice_glm(control, by, exponents)
    out = glm_loss(perturbed, base, by).select(*by, F.lit("none").alias("model"), "loss")
    for name, free in (("bias", ("bias",)), ("all", ("bias", "visR", "visL", "audR", "audL"))):
        out = out.unionByName(choice_glm(perturbed, by, exponents, free, base).select(*by, F.lit(name).alias("model"), "loss"))
    return out


def bilateral_additivity(cells: DataFrame, by: list[str], place: str, perturbed: str, exponents: list[float]) -> DataFrame:
    """(by, left, right, both, loss_sum, loss_both): whether the bias shifts of one-sided perturbations add up to that of both sides.

    ``place`` of a cell is -1, 1 or 0 for both; shifts are those of a free bias over the
    place's unperturbed cells. loss_sum is the loss on cells perturbed on both sides
    with the shifts of both places added to their control, loss_both that with all
    parameters free. Keys without all three places go.
    """
    part = lambda k, on: cells.where((F.col(place) == k) & (F.col(perturbed) == F.lit(on)))
    base = {k: choice_glm(part(k, False), by, exponents) for k in (-1, 1, 0)}
    out = None
    for k, name in ((-1, "left"), (1, "right"), (0, "both")):
        moved = choice_glm(part(k, True), by, exponents, ("bias",), base[k]).select(*by, F.col("bias").alias("_bias"))
        shift = moved.join(base[k], by).select(*by, (F.col("_bias") - F.col("bias")).alias(name))
        out = shift if out is None else out.join(shift, by)
    added = base[0].join(out, by).withColumn("bias", F.col("bias") + F.col("left") + F.col("right"))
    whole = choice_glm(part(0, True), by, exponents, fixed=base[0])
    for name, loss in (("loss_sum", glm_loss(part(0, True), added, by)), ("loss_both", whole)):
        out = out.join(loss.select(*by, F.col("loss").alias(name)), by)
    return out


def neurometric_fit(rows: DataFrame, features: list[str], label: str, fold: str, reg: float = 0.01, l1: float = 1.0) -> DataFrame:
    """(auc, accuracy, n) of an L1 logistic regression (MLlib) fitted on fold 0 and scored on the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = stage(rows.select(*features, label, fold))  # MLlib reads them again for every fit and score; texts need not be
    made = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip").transform(rows)
    train, test = made.where(F.col(fold) == 0), made.where(F.col(fold) != 0)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, elasticNetParam=l1, maxIter=50).fit(scaler.transform(train).withColumn(label, F.col(label).cast("double")))
    scored = model.transform(scaler.transform(test).withColumn(label, F.col(label).cast("double"))).select(F.col(label).alias("_y"), F.col("prediction").alias("_p"), vector_to_array("probability")[1].alias("_s"))
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    auc = BinaryClassificationEvaluator(rawPredictionCol="_s", labelCol="_y").evaluate(scored)
    return scored.agg(F.lit(auc).alias("auc"), F.avg((F.col("_y") == F.col("_p")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@lru_cache(maxsize=1024)
def _shuffled(n: int, repeat: int):
    import numpy as np

    return np.random.default_rng(repeat).permutation(n)


def stratified_folds(y, folds: int, repeat: int):
    """Fold of each row: the rows of a class, shuffled by the repeat's number as seed, are dealt in turn, on from where the class before ended."""
    import numpy as np

    order = _shuffled(len(y), repeat)
    order = order[np.argsort(y[order], kind="stable")]
    fold = np.empty(len(y), int)
    fold[order] = np.arange(len(y)) % folds
    return fold


def windowed_decoding(raster: DataFrame, trials: DataFrame, by: list[str], trial: str, unit: str, label: str, width: int, step: int, n_bins: int, reg: float = 1.0, folds: int = 5, repeats: int = 5) -> DataFrame:
    """(by, window, accuracy, majority, n): ridge classifier of the label from unit means in sliding windows, by repeated stratified folds.

    ``accuracy`` is the share of trials that are told right when left out, over all
    repeats, ``majority`` that of always saying the commoner label of the trials that
    were not left out. Both are null for fewer trials than folds. A session's window
    is solved as one table, its trials by its units; many of them are dealt to a group.
    """
    windows = F.filter(F.sequence(F.lit(0), F.lit(n_bins - width), F.lit(step)), lambda s: (s <= F.col("bin")) & (F.col("bin") < s + width))
    x = raster.withColumn("window", F.explode(windows)).groupBy(*by, "window", trial, unit).agg(F.avg("n").alias("x"))
    rows = stage(x.join(trials.select(*by, trial, F.col(label).cast("double").alias("label_")), [*by, trial]))
    schema = ", ".join([*(f"{k} {raster.schema[k].dataType.simpleString()}" for k in by), "window int, accuracy double, majority double, n int"])

    def solve(trial_, unit_, y, x):
        import numpy as np
        import pandas as pd

        some = ~(np.isnan(y) | np.isnan(x) | pd.isna(unit_))
        trial_, unit_, y, x = trial_[some], unit_[some], y[some], x[some]
        if not len(y):
            return np.nan, np.nan, 0
        at, unit_ = pd.factorize(trial_, sort=True)[0], pd.factorize(unit_, sort=True)[0]
        _, first, row = np.unique(at + 1j * y, return_index=True, return_inverse=True)  # a trial's labels are rows of their own
        shape = len(first), unit_.max() + 1
        total, many = (np.bincount(row * shape[1] + unit_, w, shape[0] * shape[1]).reshape(shape) for w in (x, None))
        y, X = y[first] > 0.5, np.c_[np.ones(len(first)), total / np.maximum(many, 1)]
        if len(y) < folds:
            return np.nan, np.nan, len(y)
        used = np.concatenate([stratified_folds(y, folds, repeat)[None] != np.arange(folds)[:, None] for repeat in range(repeats)])
        right, common, size = 0, 0, max(1, SOLVED // X.size)
        for low in range(0, len(used), size):
            a = used[low : low + size]
            t = (X * a[:, :, None]).transpose(0, 2, 1)
            w = np.linalg.solve(t @ X + reg * np.eye(X.shape[1]), (t @ (2.0 * y - 1))[:, :, None])[:, :, 0]
            told = w @ X.T
            for k in np.flatnonzero(((np.abs(told) < 1e-9) & ~a).any(1)):  # the sign of no more than rounding is that of the fold solved by itself
                v = np.linalg.solve(X[a[k]].T @ X[a[k]] + reg * np.eye(X.shape[1]), X[a[k]].T @ (2.0 * y[a[k]] - 1))
                told[k, ~a[k]] = X[~a[k]] @ v
            right += int((((told > 0) == y) & ~a).sum())
            common += int((((2 * (a & y).sum(1) > a.sum(1))[:, None] == y) & ~a).sum())
        return right / (repeats * len(y)), common / (repeats * len(y)), len(y)

    def dealt(pdf):
        import numpy as np
        import pandas as pd

        keys = [*by, "window"]
        own = [pdf[c].to_numpy() for c in (trial, unit)] + [pdf[c].to_numpy(float) for c in ("label_", "x")]
        groups = list(pdf.groupby(keys, dropna=False, sort=False).indices.values())
        out = pdf[keys].iloc[[g[0] for g in groups]].reset_index(drop=True)
        out[["accuracy", "majority", "n"]] = np.array([solve(*(c[g] for c in own)) for g in groups], float)
        return out.astype({"window": "int32", "n": "int32"})

    keys = [*by, "window"]
    deals = max(math.ceil(rows.count() / DEALT_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    made = rows.withColumn("_deal", F.pmod(F.xxhash64(*keys), F.lit(deals))).repartition(deals, "_deal").groupBy("_deal").applyInPandas(dealt, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("accuracy", "majority")})


def predictor_table(trials: DataFrame, rates: DataFrame, by: list[str], trial: str, unit: str, units: list) -> DataFrame:
    """``trials`` with a z-scored rate column per unit (0 where a unit is silent or constant)."""
    from evtspark.operators.summary import zscore

    z = zscore(rates, [*by, unit], "rate").groupBy(*by, trial).pivot(unit, units).agg(F.first("z", True))
    return trials.join(z, [*by, trial], "left").na.fill(0.0, [str(u) for u in units])
