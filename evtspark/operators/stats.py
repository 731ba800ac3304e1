"""Permutation tests, ranks and classical tests; the row-heavy part is SQL.

Shuffles are deterministic: shuffle s orders rows by an integer hash of (row, s),
so that results do not depend on partitioning and other engines can repeat them.
A key of up to PACKED_ROWS rows is drawn from as arrays, blocks of shuffles at once,
so that its rows exist once however many the shuffles are. Of a larger key the orders
are counted by slices per shuffle, and only the slice that the labels end in is sorted.
Both give the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evtspark.operators.scan import first_rows, scan
from evtspark.operators.timejoin import peri_event_join
from evtspark.staging import stage

#: Rows of a key whose shuffles are drawn as arrays, and labels that are drawn at once.
PACKED_ROWS, DRAWN = 1_000_000, 4_000_000
#: Width of the slices that shuffled orders, under 1,000,003, are counted by, and slices that ranked values are dealt to.
ORDERS, VALUES = 1000.0, 1000


def shuffle_hash(row: Column, shuffle: Column) -> Column:
    """An integer that scatters (row, shuffle)."""
    return ((row * 7919 + 104729) * (shuffle * 2 + 1) * 31 + shuffle * 15485863) % 1000003


def shuffles(df: DataFrame, n: int, row: str) -> DataFrame:
    """``df`` for shuffle 0 (as it is) and 1..n, with ``order`` to sort by."""
    out = df.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return out.withColumn("order", F.when(F.col("shuffle") == 0, F.lit(0).cast("long")).otherwise(shuffle_hash(F.col(row), F.col("shuffle"))))


def drawn(df: DataFrame, by: list[str], n: int, row: str, picked: str) -> DataFrame:
    """``df`` for shuffles 1..n with ``_first``: whether a row is one of the ``picked`` that a shuffle draws from its key."""
    return first_rows(shuffles(df, n, row).where("shuffle > 0"), [*by, "shuffle"], ["order", row], picked, ORDERS)


def p_value(stats: DataFrame, by: list[str], stat: str) -> DataFrame:
    """(by, observed, p): share of the shuffles whose statistic is over the observed one."""
    obs = stats.where("shuffle = 0").select(*by, F.col(stat).alias("observed"))
    null = stats.where("shuffle > 0").join(obs, by)
    p = null.groupBy(*by).agg(F.avg((F.col(stat) > F.col("observed")).cast("double")).alias("p"))
    return obs.join(p, by)


def split_by_size(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys that fit arrays, dealt by key over a set number of tasks; rows of the others, if there are)."""
    rows = stage(rows)
    large = rows.groupBy(*by).count().where(F.col("count") > PACKED_ROWS).select(*by)
    if large.isEmpty():
        small, large = rows, None
    else:
        large = stage(large)
        small, large = rows.join(large, by, "left_anti"), rows.join(large, by, "left_semi")
    return small.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by), large


def draws(row: np.ndarray, true: np.ndarray, n: int, shuffles_: range, picked: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shuffles, labels): for blocks of shuffles, which rows are labelled, as many as truly are (or ``picked``); rows are sorted and differ, shuffle 0 is the truth."""
    k = int(true.sum()) if picked is None else picked
    size = max(1, DRAWN // max(n, 1))
    for low in range(shuffles_.start, shuffles_.stop, size):
        s = np.arange(low, min(low + size, shuffles_.stop), dtype=np.int64)[:, None]
        order = np.fmod((row * 7919 + 104729) * (s * 2 + 1) * 31 + s * 15485863, 1000003) * max(n, 1) + np.arange(n)
        label = order <= np.partition(order, k - 1, axis=1)[:, k - 1 : k] if 0 < k else np.zeros(order.shape, bool)
        label[s[:, 0] == 0] = true
        yield s[:, 0], label


def means(label: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Means of the labelled rows of every draw, missing values left out; nan without any."""
    some = ~np.isnan(value)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (label.astype(float) @ np.where(some, value, 0.0)) / (label.astype(float) @ some.astype(float))


def observed_and_p(pdf: pd.DataFrame, by: list[str], stat: np.ndarray) -> pd.DataFrame:
    null = stat[1:][~np.isnan(stat[1:])]
    p = (null > stat[0]).mean() if len(null) and not np.isnan(stat[0]) else None
    return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), None if np.isnan(stat[0]) else stat[0], p]], columns=[*by, "observed", "p"]).astype({"observed": float, "p": float})


def _kinds(df: DataFrame, by: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in by)


def _nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def response_test(raster: DataFrame, by: list[str], trial: str, stim: Column, value: str, n_shuffles: int, trim: float = 0.0) -> DataFrame:
    """(by, observed, p): max |mean| over bins of stimulus trials less that of blank ones, equal numbers of trials, labels shuffled.

    As many trials, the first by order, are 'stimulus' in a shuffle as truly are. With
    ``trim``, that share of the key's stimulus trials, rounded down, goes from either
    end of each side's trials by their mean over bins, of equals by trial.
    """
    trials = raster.select(*by, trial, stim.cast("int").alias("_s")).distinct()
    sizes = trials.groupBy(*by).agg(F.least(F.sum("_s"), F.sum(1 - F.col("_s"))).alias("_n"), F.floor(F.sum("_s") * trim).alias("_cut"))
    first = trials.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(trial))).join(sizes, by).where(F.col("_k") <= F.col("_n"))
    cells = raster.select(*by, trial, "bin", F.col(value).cast("double").alias("_v")).join(first.select(*by, trial, "_s", "_n", "_cut"), [*by, trial])
    small, large = split_by_size(cells, by)

    def solve(pdf):
        row, at = np.unique(pdf[trial].to_numpy(), return_inverse=True)
        bins, to = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
        x, some = np.zeros((len(row), len(bins))), np.zeros((len(row), len(bins)))
        v = pdf["_v"].to_numpy(float)
        known = ~np.isnan(v)
        np.add.at(x, (at[known], to[known]), v[known])
        np.add.at(some, (at[known], to[known]), 1.0)
        true = np.zeros(len(row), bool)
        true[at] = pdf["_s"].to_numpy() == 1
        n, cut = int(pdf["_n"].iloc[0]), int(pdf["_cut"].iloc[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            order = np.lexsort((np.arange(len(row)), x.sum(1) / some.sum(1)))
        stats = []
        for _, label in draws(row.astype(np.int64), true, len(row), range(n_shuffles + 1), n):
            top = []
            for side in (label, ~label):
                if cut:
                    place = np.cumsum(side[:, order], axis=1)
                    kept = np.zeros_like(side)
                    kept[:, order] = side[:, order] & (place > cut) & (place <= n - cut)
                    side = kept
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = np.abs((side.astype(float) @ x) / (side.astype(float) @ some))
                top.append(np.where(np.isnan(mean).all(1), np.nan, np.where(np.isnan(mean), -np.inf, mean).max(1)))
            stats.append(top[0] - top[1])
        return observed_and_p(pdf, by, np.concatenate(stats))

    out = _nulls(small.groupBy(*by).applyInPandas(solve, f"{_kinds(raster, by)}observed double, p double"), "observed", "p")
    return out if large is None else out.unionByName(_response_by_rows(large, by, trial, n_shuffles))


def _response_by_rows(cells: DataFrame, by: list[str], trial: str, n_shuffles: int) -> DataFrame:
    level = cells.groupBy(*by, trial, "_s", "_n", "_cut").agg(F.avg("_v").alias("_level"))
    tried = shuffles(level, n_shuffles, trial)
    place = F.row_number().over(Window.partitionBy(*by, "shuffle").orderBy("order", trial))
    tried = tried.withColumn("_label", F.when(F.col("shuffle") == 0, F.col("_s") == 1).otherwise(place <= F.col("_n")))
    tried = tried.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "shuffle", "_label").orderBy("_level", trial)))
    labels = tried.where((F.col("_place") > F.col("_cut")) & (F.col("_place") <= F.col("_n") - F.col("_cut"))).select(*by, trial, "shuffle", "_label")
    mean = cells.join(labels, [*by, trial]).groupBy(*by, "shuffle", "_label", "bin").agg(F.avg("_v").alias("_m"))
    top = mean.groupBy(*by, "shuffle").agg(F.max(F.when(F.col("_label"), F.abs("_m"))).alias("_a"), F.max(F.when(~F.col("_label"), F.abs("_m"))).alias("_b"))
    return p_value(top.withColumn("stat", F.col("_a") - F.col("_b")), by, "stat")


def average_ranks(counts: DataFrame, by: list[str], value: str, n: str = "_n") -> DataFrame:
    """(by, value, rank): the rank, ties averaged, of every value of a key; ``n`` has the number of its rows.

    Values are dealt out by size, so that no key's values are sorted in one task.
    """
    each = stage(counts.groupBy(*by, value).agg(F.sum(n).alias("_many")))
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    low, high = each.agg(F.min(finite), F.max(finite)).first()
    width = (high - low) / VALUES if low is not None and 0 < high - low < float("inf") else 1.0
    upto = scan(each, by, [value], width, {"_upto": ("sum", F.col("_many"))})
    return stage(upto.select(*by, value, (F.col("_upto") - (F.col("_many") - 1) / 2).alias("rank")))


def with_rank(df: DataFrame, ranks: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of its value; missing keys and values have theirs."""
    named = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, value])], F.col("rank").alias(name))
    same = F.lit(True)
    for i, k in enumerate([*by, value]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, same).drop(*[f"_k{i}" for i in range(len(by) + 1)])


def combined_condition_u(df: DataFrame, by: list[str], condition: list[str], side: Column, value: str, row: str, n_shuffles: int) -> DataFrame:
    """(by, u, p): within-condition U of side A, summed over conditions with both sides, over the number of rows; p = rank / (n + 1)."""
    keys = [*by, *condition]
    rows = df.select(*keys, F.col(row).cast("long").alias("_row"), F.col(value).cast("double").alias("_v"), side.cast("int").alias("_a"))
    small, large = split_by_size(rows, by)

    def solve(pdf):
        total, many = np.zeros(n_shuffles + 1), 0
        for _, part in pdf.groupby(condition, dropna=False):
            part = part.sort_values("_row", kind="stable")
            true, n = part["_a"].to_numpy() == 1, len(part)
            if true.all() or not true.any():
                continue
            _, at, count = np.unique(part["_v"].fillna(-np.inf).to_numpy(float), return_inverse=True, return_counts=True)
            rank = (np.cumsum(count) - (count - 1) / 2)[at]
            for s, label in draws(part["_row"].to_numpy(np.int64), true, n, range(n_shuffles + 1)):
                total[s] += label.astype(float) @ rank - true.sum() * (true.sum() + 1) / 2
            many += n
        if not many:
            return pd.DataFrame(columns=[*by, "u", "p"])
        u = total / many
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), u[0], ((u[1:] < u[0]).sum() + 1) / (n_shuffles + 1)]], columns=[*by, "u", "p"])

    out = small.groupBy(*by).applyInPandas(solve, f"{_kinds(df, by)}u double, p double")
    return out if large is None else out.unionByName(_u_by_rows(large, by, condition, n_shuffles))


def _u_by_rows(rows: DataFrame, by: list[str], condition: list[str], n_shuffles: int) -> DataFrame:
    value, row = "_v", "_row"
    both = stage(rows.groupBy(*by, *condition).agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"), F.sum("_a").alias("_na"), F.count("*").alias("_nn")).where("_lo = 0 AND _hi = 1"))
    keys = [*by, *condition]
    ranks = average_ranks(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value)
    ranked = stage(with_rank(rows.join(both, keys), ranks, keys, value, "_r"))
    true = ranked.withColumns({"shuffle": F.lit(0), "_in": F.col("_a") == 1})
    tried = true.unionByName(drawn(ranked, keys, n_shuffles, row, "_na").withColumn("_in", F.col("_first")).drop("order", "_first"))
    u = tried.groupBy(*keys, "shuffle", "_na", "_nn").agg(F.sum(F.when(F.col("_in"), F.col("_r"))).alias("_s"))
    u = u.withColumn("_u", F.col("_s") - F.col("_na") * (F.col("_na") + 1) / 2).groupBy(*by, "shuffle").agg((F.sum("_u") / F.sum("_nn")).alias("u"))
    obs = u.where("shuffle = 0").select(*by, F.col("u").alias("_o"))
    rank = u.where("shuffle > 0").join(obs, by).groupBy(*by, "_o").agg(F.sum((F.col("u") < F.col("_o")).cast("long")).alias("_below"), F.count("*").alias("_n"))
    return rank.select(*by, F.col("_o").alias("u"), ((F.col("_below") + 1) / (F.col("_n") + 1)).alias("p"))


def paired_pre_post(points: DataFrame, events: DataFrame, keys: list[str], by: list[str], unit: str, event: str, pre: float, post: float) -> DataFrame:
    """(by, unit, w_plus, z, n): Wilcoxon's signed ranks of after-rate less before-rate, tie-corrected normal score; zero differences go.

    Points and events meet by ``keys``; the test runs per ``by`` (some of them) and unit.
    """
    pairs = peri_event_join(points, events, keys, pre, post)
    n = pairs.groupBy(*by, event, unit).agg(F.sum((F.col("dt") >= 0).cast("double")).alias("_post"), F.sum((F.col("dt") < 0).cast("double")).alias("_pre"))
    d = n.withColumn("_d", F.col("_post") / post - F.col("_pre") / pre).where("_d <> 0")
    d = stage(d.groupBy(*by, unit, F.round(F.abs("_d"), 12).alias("_abs")).agg(F.count("*").alias("_n"), F.sum((F.col("_d") > 0).cast("long")).alias("_up")))
    ranked = with_rank(d, average_ranks(d, [*by, unit], "_abs"), [*by, unit], "_abs", "_r")
    t = F.col("_n").cast("double")  # rows of equal size; a long's cube ends at two million
    w = ranked.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*by, unit])).groupBy(*by, unit).agg(F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum("_n").alias("n"), F.sum(t * t * t - t).alias("_c"))
    n_ = F.col("n").cast("double")
    var = n_ * (n_ + 1) * (2 * n_ + 1) / 24 - F.col("_c") / 48
    return w.withColumn("z", F.try_divide(F.col("w_plus") - n_ * (n_ + 1) / 4, F.sqrt(F.when(var > 0, var)))).drop("_c")


def session_permutation_corr(units: DataFrame, traces: DataFrame, session: str, unit: str, bin_col: str, x: str, y: str) -> DataFrame:
    """(session, unit, own, p): correlation with the own session's trace, and the share of other sessions' traces with a larger one in size."""
    pairs = units.join(traces.select(F.col(session).alias("_other"), bin_col, y), bin_col)
    r = pairs.groupBy(session, unit, "_other").agg(F.corr(x, y).alias("_r")).where(F.col("_r").isNotNull() & ~F.isnan("_r"))
    own = r.where(F.col(session) == F.col("_other")).select(session, unit, F.col("_r").alias("own"))
    return own.join(r.where(F.col(session) != F.col("_other")), [session, unit]).groupBy(session, unit, "own").agg(F.avg((F.abs("_r") > F.abs("own")).cast("double")).alias("p"))


def difference_test(df: DataFrame, by: list[str], row: str, right: Column, value: str, n_shuffles: int) -> DataFrame:
    """(by, observed, p): |mean right - mean left| with labels shuffled."""
    rows = df.select(*by, F.col(row).cast("long").alias("_row"), F.col(value).cast("double").alias("_v"), right.cast("int").alias("_a"))
    small, large = split_by_size(rows, by)

    def solve(pdf):
        pdf = pdf.sort_values("_row", kind="stable")
        v, true = pdf["_v"].to_numpy(float), pdf["_a"].to_numpy() == 1
        stat = [np.abs(means(label, v) - means(~label, v)) for _, label in draws(pdf["_row"].to_numpy(np.int64), true, len(v), range(n_shuffles + 1))]
        return observed_and_p(pdf, by, np.concatenate(stat))

    out = _nulls(small.groupBy(*by).applyInPandas(solve, f"{_kinds(df, by)}observed double, p double"), "observed", "p")
    return out if large is None else out.unionByName(_difference_by_rows(large, by, n_shuffles))


def _difference_by_rows(rows: DataFrame, by: list[str], n_shuffles: int) -> DataFrame:
    sizes = stage(rows.groupBy(*by).agg(F.sum("_a").alias("_n")))
    true = rows.withColumns({"shuffle": F.lit(0), "_in": F.col("_a") == 1})
    tried = true.unionByName(drawn(rows.join(sizes, by), by, n_shuffles, "_row", "_n").withColumn("_in", F.col("_first")).drop("order", "_first", "_n"))
    stat = tried.groupBy(*by, "shuffle").agg(F.abs(F.avg(F.when(F.col("_in"), F.col("_v"))) - F.avg(F.when(~F.col("_in"), F.col("_v")))).alias("stat"))
    return p_value(stat, by, "stat")


def cv_split(df: DataFrame, by: list[str], row: str, folds: int, seed: int = 1, width: float | None = None) -> DataFrame:
    """``fold`` per class: rows dealt in turn in a seeded order; classes of one row go.

    With ``width`` (of ORDERS) the order is cut into slices that are sorted apart, for
    classes too long for one task's sort; ``row`` must differ within a class then.
    """
    order = shuffle_hash(F.col(row), F.lit(seed))
    if width is None:
        w = Window.partitionBy(*by).orderBy(order, row)
        out = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("_n > 1")
        return out.withColumn("fold", (F.row_number().over(w) - 1) % folds).drop("_n")
    sizes = df.groupBy(*by).count().where(F.col("count") == 1).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)])
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = scan(df.join(sizes, same, "left_anti").withColumn("_order", order), by, ["_order", row], width, {"_place": ("sum", F.lit(1).cast("long"))})
    return placed.withColumn("fold", ((F.col("_place") - 1) % folds).cast("int")).drop("_order", "_place")


def contiguous_folds(df: DataFrame, by: list[str], order: str, folds: int) -> DataFrame:
    """``fold``: contiguous chunks of the sorted groups."""
    return df.withColumn("fold", F.ntile(folds).over(Window.partitionBy(*by).orderBy(order)) - 1)


def rank_corr(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho): Spearman's correlation, of rows counted by their two values; null where one does not vary."""
    n = stage(df.groupBy(*by, F.col(x).alias("_vx"), F.col(y).alias("_vy")).agg(F.count("*").alias("_n")))
    both = with_rank(with_rank(n, average_ranks(n, by, "_vx"), by, "_vx", "_x"), average_ranks(n, by, "_vy"), by, "_vy", "_y")
    weighted = lambda *c: F.sum(math.prod((F.col(k) for k in c), start=F.col("_n").cast("double")))
    sums = both.groupBy(*by).agg(
        weighted().alias("n"), weighted("_x").alias("x"), weighted("_y").alias("y"), weighted("_x", "_x").alias("xx"), weighted("_y", "_y").alias("yy"), weighted("_x", "_y").alias("xy"),
        ((F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))).alias("varies"),
    )
    return sums.select(*by, F.when(F.col("varies"), F.expr("(xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n))")).alias("rho"))


def resample_latencies(df: DataFrame, by: list[str], row: str, latency: str, n_shuffles: int) -> DataFrame:
    """(by, shuffle, mean): means of the latencies that a shuffle's first half draws."""
    rows = df.select(*by, F.col(row).cast("long").alias("_row"), F.col(latency).cast("double").alias("_v"))
    small, large = split_by_size(rows, by)

    def solve(pdf):
        pdf = pdf.sort_values("_row", kind="stable")
        v = pdf["_v"].to_numpy(float)
        parts = [(s, means(label, v)) for s, label in draws(pdf["_row"].to_numpy(np.int64), np.zeros(len(v), bool), len(v), range(1, n_shuffles + 1), max(1, len(v) // 2))]
        out = pd.DataFrame({"shuffle": np.concatenate([np.empty(0), *(s for s, _ in parts)]).astype(np.int32), "mean": np.concatenate([np.empty(0), *(m for _, m in parts)])})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "shuffle", "mean"]]

    out = _nulls(small.groupBy(*by).applyInPandas(solve, f"{_kinds(df, by)}shuffle int, mean double"), "mean")
    if large is None:
        return out
    tried = shuffles(large, n_shuffles, "_row").where("shuffle > 0")
    place = F.percent_rank().over(Window.partitionBy(*by, "shuffle").orderBy("order", "_row"))
    return out.unionByName(tried.withColumn("_p", place).where("_p < 0.5").groupBy(*by, "shuffle").agg(F.avg("_v").alias("mean")))


@F.pandas_udf(DoubleType())
def beta_share(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction; a few rows, one per group."""
    a_, b_, x_ = (np.asarray(v, float) for v in (a, b, x))
    flip = x_ > (a_ + 1) / (a_ + b_ + 2)
    p, q, y = np.where(flip, b_, a_), np.where(flip, a_, b_), np.where(flip, 1 - x_, x_)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_gamma = np.vectorize(math.lgamma, otypes=[float])
        safe = lambda v: np.where(np.isfinite(v) & (v > 0), v, 1.0)
        front = np.exp(log_gamma(safe(p + q)) - log_gamma(safe(p)) - log_gamma(safe(q)) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 / (1 - (p + q) * y / (p + 1))
        value = d.copy()
        for m in range(1, 300):
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            for step in (even, odd):
                d, c = 1 / (1 + step * d), 1 + step / c
                value = value * c * d
        part = front * value
    part = np.where(y == 0, 0.0, part)
    out = np.where(flip, 1 - part, part)
    return pd.Series(np.where(np.isfinite(out), np.clip(out, 0, 1), np.nan))


def paired_t(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, t, n, p): paired t statistic with n - 1 degrees of freedom, and its two-sided p; null without spread."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*by).agg(F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"), F.count(d).alias("n"))
    free = (F.col("n") - 1).cast("double")
    return out.withColumn("p", F.when(F.col("t").isNotNull() & (free > 0), beta_share(free / 2, F.lit(0.5), free / (free + F.col("t") * F.col("t")))))


def one_way_anova(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, f, df_between, df_within, p) from sums of squares; p is the upper tail of F, null without degrees of freedom."""
    per = df.groupBy(*by, group).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    grand = per.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"), F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    joined = per.join(grand, by) if by else per.crossJoin(F.broadcast(grand))  # grand is one row without keys
    ss = joined.groupBy(*by, "_t", "_k").agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) * (F.col("_m") - F.col("_g"))).alias("_b"), F.sum(F.col("_n") * F.col("_v")).alias("_w"))
    f = F.try_divide(F.try_divide(F.col("_b"), F.col("_k") - 1), F.try_divide(F.col("_w"), F.col("_t") - F.col("_k")))
    out = ss.select(*by, f.alias("f"), (F.col("_k") - 1).alias("df_between"), (F.col("_t") - F.col("_k")).alias("df_within"))
    d1, d2 = F.col("df_between").cast("double"), F.col("df_within").cast("double")
    return out.withColumn("p", F.when(F.col("f").isNotNull() & (d1 > 0) & (d2 > 0), beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * F.col("f")))))
