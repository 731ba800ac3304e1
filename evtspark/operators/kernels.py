"""Kernel regressions beyond ridge, and what a kernel explains in time, by condition and against the model without it.

Fits see a group's Gram matrix (``fits.fold_sums``) and never rows; predictions and
explained variance are joins and aggregates over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.operators.fits import fold_sums, matrices

METHODS = ("mean", "ridge", "elastic", "reduced", "reduced_ridge", "reduced_elastic")


def elastic_weights(G, X, n, alphas: list[float], l1_ratio: float, nonneg: bool = False, sweeps: int = 1000):
    """{alpha: weights} of 1/2n squares + alpha (l1 |w| + (1 - l1)/2 w^2) by coordinate descent on the Gram matrix, from the largest alpha down, each begun at the one before."""
    import numpy as np

    B, out = np.zeros_like(X), {}
    for alpha in sorted(alphas, reverse=True):
        for _ in range(sweeps):
            most = 0.0
            for j in range(len(G)):
                rho = X[j] - G[j] @ B + G[j, j] * B[j]
                new = np.sign(rho) * np.maximum(np.abs(rho) - alpha * l1_ratio * n, 0) / np.maximum(G[j, j] + alpha * (1 - l1_ratio) * n, 1e-12)
                new = np.maximum(new, 0) if nonneg else new
                most, B[j] = max(most, float(np.abs(new - B[j]).max(initial=0))), new
            if most < 1e-10:
                break
        out[alpha] = B.copy()
    return out


def reduction(G, X, rank: int, reg: float):
    """(A, W): features to components and components to units, of the reduced-rank regression."""
    import numpy as np

    inverse = np.linalg.pinv(G + reg * np.eye(len(G)))
    W = np.linalg.svd(X.T @ inverse @ X)[2][:rank].T
    return inverse @ X @ W, W


def gram_fit(
    design: DataFrame, counts: DataFrame, by: list[str], unit: str, method: str, alphas: tuple[float, ...] = (1.0,), ranks: tuple[int, ...] = (1,),
    l1_ratios: tuple[float, ...] = (0.5,), reg: float = 1.0, nonneg: bool = False, fold: str = "fold",
) -> DataFrame:
    """(by, unit, feature, coef, alpha, rank, l1_ratio, r2, weighted_r2): fold 0 fits, fold 1 chooses among all settings by R2 weighted by the units' variance.

    Methods: 'mean' (feature 'mean', to be added to every bin), 'ridge', 'elastic',
    'reduced' (rank), and 'reduced_ridge' and 'reduced_elastic' (on the components of
    the reduced-rank regression). Of equal settings the first counts. A setting that a
    method has not is null; r2 is null for a unit that does not vary.
    """
    if method not in METHODS:
        raise ValueError(f"method: one of {METHODS}")
    schema = ", ".join([*(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by), "unit string, feature string, coef double, alpha double, rank int, l1_ratio double, r2 double, weighted_r2 double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        feats, units, G, X, S = matrices(pdf)
        n = np.maximum(S["n"][0], 1)

        def settings():
            if method == "ridge":
                for a in alphas:
                    yield a, None, None, np.linalg.solve(G[0] + a * np.eye(len(feats)), X[0])
            elif method == "elastic":
                for r in l1_ratios:
                    found = elastic_weights(G[0], X[0], n, list(alphas), r, nonneg)
                    yield from ((a, None, r, found[a]) for a in alphas)
            elif method != "mean":
                for k in ranks:
                    A, W = reduction(G[0], X[0], k, reg)
                    if method == "reduced":
                        yield None, k, None, A @ W.T
                        continue
                    g, x = A.T @ G[0] @ A, A.T @ X[0]
                    if method == "reduced_ridge":
                        yield from ((a, k, None, A @ np.linalg.solve(g + a * np.eye(len(g)), x)) for a in alphas)
                        continue
                    for r in l1_ratios:
                        found = elastic_weights(g, x, n, list(alphas), r, nonneg)
                        yield from ((a, k, r, A @ found[a]) for a in alphas)

        total = S["q"][1] - S["s"][1] ** 2 / np.maximum(S["n"][1], 1)
        best = None
        if method == "mean":
            mean = S["s"][0] / n
            feats, rest = ["mean"], S["q"][1] - 2 * mean * S["s"][1] + S["n"][1] * mean * mean
            best = (1 - rest.sum() / total.sum() if total.sum() > 0 else np.nan, (None, None, None, mean[None]), rest)
        else:
            for s in settings():
                B = s[3]
                rest = S["q"][1] - 2 * (B * X[1]).sum(0) + np.einsum("fu,fg,gu->u", B, G[1], B)
                score = 1 - rest.sum() / total.sum() if total.sum() > 0 else np.nan
                if best is None or score > best[0]:
                    best = (score, s, rest)
        score, (a, k, r, B), rest = best
        r2 = 1 - rest / np.where(total > 1e-12, total, np.nan)
        out = [(u, f, B[i, j], a, k, r, r2[j], score) for j, u in enumerate(units) for i, f in enumerate(feats)]
        made = pd.DataFrame(out, columns=["unit", "feature", "coef", "alpha", "rank", "l1_ratio", "r2", "weighted_r2"]).astype({"alpha": float, "rank": "Int32", "l1_ratio": float})
        for c in by:
            made[c] = pdf[c].iloc[0]
        return made[[*by, "unit", "feature", "coef", "alpha", "rank", "l1_ratio", "r2", "weighted_r2"]]

    made = fold_sums(design, counts, by, unit, fold).groupBy(*by).applyInPandas(solve, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("alpha", "l1_ratio", "r2", "weighted_r2")})


def _own(feats: list[str], events: list[str]):
    import numpy as np

    return np.array([f.rsplit("@", 1)[0] in events for f in feats], bool)


def kernel_parts(design: DataFrame, counts: DataFrame, by: list[str], unit: str, alpha: float, kernels: dict[str, list[str]]) -> DataFrame:
    """(by, unit, kernel, part, feature, coef): for each kernel, a name for some events, the ridge without its events ('rest') and the ridge of its events on what that leaves ('kernel'), both of fold 0."""
    schema = ", ".join([*(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by), "unit string, kernel string, part string, feature string, coef double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        feats, units, G, X, _ = matrices(pdf)
        names, out = np.array(feats), []
        for name, events in kernels.items():
            own = _own(feats, events)
            rest = np.linalg.solve(G[0][~own][:, ~own] + alpha * np.eye((~own).sum()), X[0][~own])
            kernel = np.linalg.solve(G[0][own][:, own] + alpha * np.eye(own.sum()), X[0][own] - G[0][own][:, ~own] @ rest)
            out += [(u, name, part, f, B[i, j]) for part, at, B in (("rest", ~own, rest), ("kernel", own, kernel)) for i, f in enumerate(names[at]) for j, u in enumerate(units)]
        made = pd.DataFrame(out, columns=["unit", "kernel", "part", "feature", "coef"])
        for c in by:
            made[c] = pdf[c].iloc[0]
        return made[[*by, "unit", "kernel", "part", "feature", "coef"]]

    return fold_sums(design, counts, by, unit).groupBy(*by).applyInPandas(solve, schema)


def kernel_predictions(design: DataFrame, counts: DataFrame, parts: DataFrame, by: list[str], unit: str) -> DataFrame:
    """(by, fold, bin, unit, kernel, y, left, told): the counts less the model without the kernel, and what the kernel says, bin by bin; bins without features have 0."""
    said = design.join(parts, [*by, "feature"]).groupBy(*by, "fold", "bin", "unit", "kernel").agg(*(F.sum(F.when(F.col("part") == p, F.col("value") * F.col("coef")).otherwise(0.0)).alias(f"_{p}") for p in ("rest", "kernel")))
    names = parts.select(*by, "unit", "kernel").distinct()
    rows = counts.select(*by, "fold", "bin", F.col(unit).cast("string").alias("unit"), F.col("y").cast("double").alias("y")).join(names, [*by, "unit"])
    rows = rows.join(said, [*by, "fold", "bin", "unit", "kernel"], "left").na.fill(0.0, ["_rest", "_kernel"])
    return rows.select(*by, "fold", "bin", "unit", "kernel", "y", (F.col("y") - F.col("_rest")).alias("left"), F.col("_kernel").alias("told"))


def grouped_ve(rows: DataFrame, by: list[str], actual: str, told: str) -> DataFrame:
    """(by, ve, n): 1 - variance of what is not told over the variance, per group; null where nothing varies."""
    return rows.groupBy(*by).agg((1 - F.try_divide(F.var_pop(F.col(actual) - F.col(told)), F.var_pop(actual))).alias("ve"), F.count(actual).alias("n"))


def lag_labels(design: DataFrame, by: list[str], event: str) -> DataFrame:
    """(by, fold, bin, lag): at which lags of an event a bin stands; a bin near two events has a row for each."""
    return design.where(F.substring_index("feature", "@", 1) == event).select(*by, "fold", "bin", F.substring_index("feature", "@", -1).cast("int").alias("lag")).distinct()


def resolved_significance(design: DataFrame, counts: DataFrame, by: list[str], unit: str, alpha: float, kernels: dict[str, list[str]], event: str) -> DataFrame:
    """(by, unit, kernel, lag, ve, n): what each kernel explains of what the model without it leaves, on fold 1, bin by bin around an event."""
    rows = kernel_predictions(design, counts, kernel_parts(design, counts, by, unit, alpha, kernels), by, unit).where("fold = 1")
    return grouped_ve(rows.join(lag_labels(design, by, event), [*by, "fold", "bin"]), [*by, "unit", "kernel", "lag"], "left", "told")


def condition_significance(design: DataFrame, counts: DataFrame, conditions: DataFrame, by: list[str], unit: str, alpha: float, kernels: dict[str, list[str]], condition: str) -> DataFrame:
    """(by, unit, kernel, condition, ve, n): the same by the condition of each bin, ``conditions(by, bin, condition)``."""
    rows = kernel_predictions(design, counts, kernel_parts(design, counts, by, unit, alpha, kernels), by, unit).where("fold = 1")
    return grouped_ve(rows.join(conditions.select(*by, "bin", condition), [*by, "bin"]), [*by, "unit", "kernel", condition], "left", "told")


def leave_out_comparison(design: DataFrame, counts: DataFrame, by: list[str], unit: str, alpha: float, kernels: dict[str, list[str]]) -> DataFrame:
    """(by, unit, kernel, ve): explained variance on fold 1 of the full model ('full') and of models fitted without each kernel's events."""
    schema = ", ".join([*(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by), "unit string, kernel string, feature string, coef double"])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        feats, units, G, X, _ = matrices(pdf)
        out = []
        for name, events in {"full": [], **kernels}.items():
            kept = ~_own(feats, events)
            B = np.linalg.solve(G[0][kept][:, kept] + alpha * np.eye(kept.sum()), X[0][kept])
            out += [(u, name, f, B[i, j]) for i, f in enumerate(np.array(feats)[kept]) for j, u in enumerate(units)]
            out += [(u, name, "", 0.0) for u in units]
        made = pd.DataFrame(out, columns=["unit", "kernel", "feature", "coef"])
        for c in by:
            made[c] = pdf[c].iloc[0]
        return made[[*by, "unit", "kernel", "feature", "coef"]]

    parts = fold_sums(design, counts, by, unit).groupBy(*by).applyInPandas(solve, schema).withColumn("part", F.lit("kernel"))
    rows = kernel_predictions(design, counts, parts, by, unit).where("fold = 1")
    return grouped_ve(rows, [*by, "unit", "kernel"], "y", "told").drop("n")
