"""Matching of units over days: by weights on shared response components, and by fingerprints over pairs matched before.

Components need a day's stimulus by stimulus matrix only: its units are summed into
it task by task, so that no day's units stand together anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtspark.operators.match import chain_matches
from evtspark.operators.summary import BLOCK_COLUMNS, corr_matrix
from evtspark.staging import stage


def reliable_units(responses: DataFrame, day: str, unit: str, stimulus: str, repeat: str, value: str, least_rate: float = 0.1, least: float = 0.01) -> DataFrame:
    """(day, unit, rate, reliability): units whose mean and whose correlation over stimuli of odd and even repeats are over the two limits."""
    part = lambda k: F.avg(F.when(F.pmod(F.col(repeat), F.lit(2)) == k, F.col(value)))
    means = responses.groupBy(day, unit, stimulus).agg(part(1).alias("_o"), part(0).alias("_e"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    told = means.groupBy(day, unit).agg((F.sum("_s") / F.sum("_n")).alias("rate"), F.corr("_o", "_e").alias("reliability"))
    return told.where((F.col("rate") > least_rate) & (F.col("reliability") > least) & ~F.isnan("reliability"))


def _added(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sums of the arrays ``row`` of each key, place by place."""
    nought = F.array_repeat(F.lit(0.0), size)
    return rows.groupBy(*keys).agg(F.aggregate(F.collect_list("row"), nought, lambda s, r: F.zip_with(s, r, lambda a, b: a + b)).alias("row"))


def shared_weights(responses: DataFrame, day: str, unit: str, stimulus: str, value: str, components: int = 75) -> DataFrame:
    """(day, unit, component, weight): what each unit's mean responses are on the components that all days share.

    A day's stimulus by unit matrix, whitened by its singular values, spans a space of
    stimuli; components are the principal directions of all days' spaces put
    together, over the mean stimulus, each with its largest part positive. Weights
    are the least squares of the components on the unit's responses. A stimulus
    without responses on a day counts 0. What is held at once has as many numbers as
    stimuli squared.
    """
    import numpy as np

    stimuli = [r[0] for r in responses.select(stimulus).where(F.col(stimulus).isNotNull()).distinct().orderBy(stimulus).collect()]
    spark, size = responses.sparkSession, len(stimuli)
    kinds = {c: responses.schema[c].dataType.simpleString() for c in (day, unit)}
    told = f"{unit} {kinds[unit]}, component int, weight double"
    if not size:
        return spark.createDataFrame([], f"{day} {kinds[day]}, {told}")
    index = spark.createDataFrame(list(enumerate(stimuli)), f"_i int, {stimulus} {responses.schema[stimulus].dataType.simpleString()}")
    cells = responses.where(F.col(value).isNotNull()).groupBy(day, unit, stimulus).agg(F.avg(value).cast("double").alias("_x")).join(F.broadcast(index), stimulus)
    packed = stage(cells.groupBy(day, unit).agg(F.collect_list(F.struct("_i", "_x")).alias("_m")))

    def dense(pdf):
        out = np.zeros((len(pdf), size))
        for k, own in enumerate(pdf["_m"]):
            for cell in own:
                out[k, cell["_i"]] = cell["_x"]
        return out

    def grams(frames: Iterator) -> Iterator:
        import pandas as pd

        total: dict = {}
        for pdf in frames:
            x = dense(pdf)
            for d, rows in pdf.groupby(day, dropna=False).indices.items():
                total[d] = total.get(d, 0) + x[rows].T @ x[rows]
        for d, g in total.items():
            yield pd.DataFrame({day: [d] * size, "_i": np.arange(size, dtype=np.int32), "row": list(g)})

    def project(pdf):
        import pandas as pd

        values, vectors = np.linalg.eigh(np.stack(pdf.sort_values("_i")["row"].to_list()))
        own = vectors[:, values > 1e-10 * max(values.max(), 1e-300)]
        return pd.DataFrame({"_i": np.arange(size, dtype=np.int32), "row": list(own @ own.T)})

    rows = "_i int, row array<double>"
    days = _added(packed.mapInPandas(grams, f"{day} {kinds[day]}, {rows}"), [day, "_i"], size)
    spaces = _added(days.groupBy(day).applyInPandas(project, rows), ["_i"], size)
    whole = np.zeros((size, size))
    for r in spaces.collect():  # as many rows as stimuli
        whole[r["_i"]] = r["row"]
    centred = whole - whole.mean(0)
    values, vectors = np.linalg.eigh(centred - centred.mean(1, keepdims=True))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-300)]
    shared = vectors[:, order]
    shared = shared * np.where(shared[np.abs(shared).argmax(0), np.arange(len(order))] < 0, -1, 1)

    def weigh(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            w = dense(pdf) @ shared
            k = w.shape[1]
            yield pd.DataFrame({day: pdf[day].repeat(k).to_numpy(), unit: pdf[unit].repeat(k).to_numpy(), "component": np.tile(np.arange(k, dtype=np.int32), len(pdf)), "weight": w.ravel()})

    return packed.mapInPandas(weigh, f"{day} {kinds[day]}, {told}")


def match_days(
    weights: DataFrame, day: str, unit: str, positions: DataFrame | None = None, x: str = "x", y: str = "depth",
    isolation: float = 0.05, least: float = 0.5, distance: float = 50.0, following: bool = False,
) -> DataFrame:
    """(day_a, day_b, a, b, r, isolation, distance): units of every two days, the earlier first, matched by the correlation of their weights.

    A unit's match is the other day's unit of largest r, of equals the smaller one. It
    stays if r is over ``least``, over the second best by more than ``isolation`` (so
    there is one), and, with ``positions(day, unit, x, y)``, no farther off than
    ``distance``; of units with one match the smallest stays. ``following``: only days
    that follow on one another.
    """
    days = sorted(r[0] for r in weights.select(day).where(F.col(day).isNotNull()).distinct().collect())
    most = max((r[0] for r in weights.groupBy(day).agg(F.countDistinct(unit)).select(F.col("count(DISTINCT " + unit + ")")).collect()), default=1)
    own = [(d, e) for k, d in enumerate(days) for e in (days[k + 1 : k + 2] if following else days[k + 1 :])]
    kind = weights.schema[day].dataType.simpleString()
    pairs = F.broadcast(weights.sparkSession.createDataFrame(own, f"day_a {kind}, day_b {kind}"))  # as many rows as pairs of days
    side = lambda c: weights.withColumnRenamed(day, c).join(pairs, c)
    r = corr_matrix(side("day_a"), side("day_b"), "component", unit, unit, "weight", by=["day_a", "day_b"], blocks=max(1, math.ceil(most / BLOCK_COLUMNS))).where("r IS NOT NULL")
    w = Window.partitionBy("day_a", "day_b", "a").orderBy(F.desc("r"), "b")
    best = r.withColumns({"_k": F.row_number().over(w), "_second": F.lead("r").over(w)}).where("_k = 1").withColumn("isolation", F.col("r") - F.col("_second"))
    best = best.where((F.col("isolation") > isolation) & (F.col("r") > least))
    if positions is None:
        best = best.withColumn("distance", F.lit(None).cast("double"))
    else:
        at = lambda d, u, p: positions.select(F.col(day).alias(d), F.col(unit).alias(u), F.col(x).alias(f"_x{p}"), F.col(y).alias(f"_y{p}"))
        best = best.join(at("day_a", "a", 1), ["day_a", "a"]).join(at("day_b", "b", 2), ["day_b", "b"])
        best = best.withColumn("distance", F.hypot(F.col("_x1") - F.col("_x2"), F.col("_y1") - F.col("_y2"))).where(F.col("distance") <= distance)
    once = F.row_number().over(Window.partitionBy("day_a", "day_b", "b").orderBy("a"))
    return best.withColumn("_once", once).where("_once = 1").select("day_a", "day_b", "a", "b", "r", "isolation", "distance")


def track_units(matches: DataFrame, days: list) -> DataFrame:
    """(u0, u1, ...): units matched from each of the days to the next."""
    step = lambda d, e: matches.where((F.col("day_a") == d) & (F.col("day_b") == e)).select("a", "b", F.col("r").alias("score"))
    return chain_matches([step(d, e) for d, e in zip(days, days[1:], strict=False)])


def fingerprint_match(first: DataFrame, second: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """(by, step, a, b, fingerprint, population): units of two days added to matched ones, one pair at a time.

    ``first`` and ``second`` (by, a, b, r) are the correlations of the units of a day,
    ``seeds`` (by, a, b) the pairs matched before, which are step 0 and less. A unit's
    fingerprint is its correlations with its day's matched units; each step takes the
    two units left whose fingerprints correlate most, of equals the smaller ones, and
    goes on while there are any. ``population`` correlates both days' correlations
    over all pairs of matched units so far. A correlation not given counts 0. A step
    adds to running sums and computes no fingerprint again. A group is a pair of days.
    """
    import numpy as np

    kind = first.schema["a"].dataType.simpleString()
    part = lambda df, k: df.select(*by, F.lit(k).alias("_side"), "a", "b", (F.col("r") if k else F.lit(0.0)).cast("double").alias("r"))
    rows = part(first, 1).unionByName(part(second, 2)).unionByName(part(seeds, 0))
    schema = ", ".join([*(f"{k} {first.schema[k].dataType.simpleString()}" for k in by), f"step int, a {kind}, b {kind}, fingerprint double, population double"])

    def corr(n, sx, sy, sxx, syy, sxy):
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
            return np.where(spread > 1e-18 * np.maximum(n * sxx, 1e-300) * np.maximum(n * syy, 1e-300), (n * sxy - sx * sy) / np.sqrt(np.maximum(spread, 1e-300)), np.nan)

    def solve(pdf):
        import pandas as pd

        seed = pdf[pdf["_side"] == 0].sort_values(["a", "b"])
        matrix, units = [], []
        for k, own in ((1, "a"), (2, "b")):
            d = pdf[pdf["_side"] == k]
            names = sorted({*d["a"], *d["b"], *seed[own]})
            at = {u: i for i, u in enumerate(names)}
            m = np.zeros((len(names), len(names)))
            m[d["a"].map(at).to_numpy(int), d["b"].map(at).to_numpy(int)] = d["r"].fillna(0.0)
            matrix.append(m)
            units.append((names, at))
        (m, n), ((na, ia), (nb, ib)) = matrix, units
        taken = [(ia[a], ib[b]) for a, b in zip(seed["a"], seed["b"], strict=True)]
        g, h = [t[0] for t in taken], [t[1] for t in taken]
        sx, sxx, sy, syy, sxy = m[:, g].sum(1), (m[:, g] ** 2).sum(1), n[:, h].sum(1), (n[:, h] ** 2).sum(1), m[:, g] @ n[:, h].T
        free = np.ones((len(na), len(nb)), bool)
        free[g], free[:, h] = False, False
        pairs = np.zeros(6)  # number and sums over all pairs of matched units

        def population(k):
            u, v = m[g[k], g[:k]], n[h[k], h[:k]]
            pairs[:] += (k, u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum())
            return float(corr(*pairs))

        out = []
        for k in range(len(g)):
            out.append((k - len(g) + 1, na[g[k]], nb[h[k]], np.nan, population(k)))
        while free.any():
            r = np.where(free, corr(len(g), sx[:, None], sy[None], sxx[:, None], syy[None], sxy), np.nan)
            if np.isnan(r).all():
                break
            i, j = np.unravel_index(np.nanargmax(np.round(r, 12)), r.shape)
            g.append(int(i))
            h.append(int(j))
            free[i], free[:, j] = False, False
            u, v = m[:, i], n[:, j]
            sx, sxx, sy, syy, sxy = sx + u, sxx + u * u, sy + v, syy + v * v, sxy + np.outer(u, v)
            out.append((len(out) - len(taken) + 1, na[i], nb[j], r[i, j], population(len(g) - 1)))
        made = pd.DataFrame(out, columns=["step", "a", "b", "fingerprint", "population"])
        for c in by:
            made[c] = pdf[c].iloc[0]
        return made[[*by, "step", "a", "b", "fingerprint", "population"]]

    made = rows.groupBy(*by).applyInPandas(solve, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("fingerprint", "population")})
