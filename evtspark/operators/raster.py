"""Counts and rates of point events around reference events, and what is made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtspark.operators.timejoin import peri_event_join


def raster_counts(points: DataFrame, events: DataFrame, by: list[str], pre: float, post: float, bin_s: float, unit: str = "unit", event: str = "event", zeros: bool = True, rate: bool = False) -> DataFrame:
    """(by, event, unit, bin, n): points per bin around each event; bins count from -ceil(pre / bin) bins before it.

    Half-open bins; a point on the last edge is dropped. With ``zeros`` every unit
    of the key and every bin has a row.
    """
    n_pre, n_post = math.ceil(pre / bin_s), math.ceil(post / bin_s)
    pairs = peri_event_join(points, events, by, n_pre * bin_s, n_post * bin_s)
    index = F.floor((F.col("dt") + n_pre * bin_s) / bin_s).cast("int")
    n = pairs.withColumn("bin", index).where((F.col("bin") >= 0) & (F.col("bin") < n_pre + n_post)).groupBy(*by, event, unit, "bin").agg(F.count("*").alias("n"))
    if zeros:
        units = points.select(*by, unit).distinct()
        grid = events.select(*by, event).join(units, by).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_pre + n_post - 1))))
        n = grid.join(n, [*by, event, unit, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("rate", F.col("n") / bin_s) if rate else n


def bincount2d(df: DataFrame, x: str, y: str, x_bin: float, y_bin: float, x_min: float = 0.0, y_min: float = 0.0, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """2-D histogram: (x_bin, y_bin, n); a bin of 0 groups by the value itself."""
    cell = lambda c, step, low: F.floor((F.col(c) - low) / step) if step else F.col(c)
    return df.groupBy(*(by or []), cell(x, x_bin, x_min).alias("x_bin"), cell(y, y_bin, y_min).alias("y_bin")).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))


def psth(raster: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """Mean, population deviation, standard error and number over the trials of each group."""
    return raster.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n_trials"))


def subtract_baseline(raster: DataFrame, by: list[str], first_bin: int, value: str = "n") -> DataFrame:
    """``value`` less its mean over the bins before ``first_bin``."""
    base = F.avg(F.when(F.col("bin") < first_bin, F.col(value))).over(Window.partitionBy(*by))
    return raster.withColumn(value, F.col(value) - base)


def gaussian_kernel(sigma_bins: float, causal: bool = False, half: int | None = None) -> list[tuple[int, float]]:
    """(lag in bins, weight), normalised; causal kernels have no weight for the future."""
    half = half if half is not None else math.ceil(5 * sigma_bins)
    raw = [(k, math.exp(-0.5 * (k / sigma_bins) ** 2) if not (causal and k < 0) else 0.0) for k in range(-half, half + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw if w]


def smooth_counts(raster: DataFrame, by: list[str], sigma_bins: float, causal: bool = False, value: str = "n") -> DataFrame:
    """(by, bin, smooth): convolution of each group's bins with a Gaussian; missing bins count as 0."""
    weights = dict(gaussian_kernel(sigma_bins, causal))
    low, high = min(weights), max(weights)
    taps = F.array(*[F.lit(weights.get(k, 0.0)) for k in range(low, high + 1)])
    known = raster.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, "bin"]))
    # a bin's window holds the bins that reach it, so no row is multiplied
    near = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("bin").cast("int").alias("bin"), F.col(value).cast("double").alias("v"))))
    near = near.over(Window.partitionBy(*by).orderBy("bin").rangeBetween(-high, -low))
    cells = known.select(*by, "bin", near.alias("_near"), F.col("bin").cast("int").alias("_at"))
    part = lambda x: x["v"] * F.element_at(taps, F.col("_at") - x["bin"] + (1 - low))
    total = F.when(F.size("_near") > 0, F.aggregate("_near", F.lit(0.0), lambda acc, x: acc + part(x)))
    return cells.select(*by, "bin", total.alias("smooth"))


def depth_time_counts(points: DataFrame, by: list[str], depth: str, on: str, depth_step: float, time_step: float) -> DataFrame:
    """(by, depth_bin, time_bin, n, key): counts on a depth by time grid."""
    out = points.groupBy(*by, F.floor(F.col(depth) / depth_step).alias("depth_bin"), F.floor(F.col(on) / time_step).alias("time_bin")).agg(F.count("*").alias("n"))
    return out.withColumn("key", F.concat_ws("_", *[F.col(c).cast("string") for c in by], F.col("depth_bin").cast("string")))


def rf_map(counts: DataFrame, by: list[str], x: str, y: str, response: str, baseline: str | None = None) -> DataFrame:
    """(by, x, y, response, z): mean response per place, less the baseline's mean, and its distance in baseline deviations."""
    base = F.avg(baseline) if baseline else F.lit(0.0)
    z = F.abs(F.try_divide(F.avg(response) - F.avg(baseline), F.stddev_pop(baseline))) if baseline else F.lit(None).cast("double")
    return counts.groupBy(*by, x, y).agg((F.avg(response) - base).alias("response"), z.alias("z"))


def tuning_curve(raster: DataFrame, by: list[str], angle: str, value: str = "n") -> DataFrame:
    """(by, angle, tuning): the largest |mean over trials| over the bins."""
    return raster.groupBy(*by, angle, "bin").agg(F.avg(value).alias("_m")).groupBy(*by, angle).agg(F.max(F.abs("_m")).alias("tuning"))


def preferred(tuning: DataFrame, by: list[str], angle: str) -> DataFrame:
    """(by, preferred): the angle of the largest tuning, the smallest of equals."""
    return tuning.groupBy(*by).agg(F.max_by(angle, F.struct(F.col("tuning"), -F.col(angle))).alias("preferred"))


def selectivity(tuning: DataFrame, by: list[str], angle: str, fold: str) -> DataFrame:
    """(by, selectivity): (max - min) / (max + min) of fold 1 at the places of fold 0's extremes."""
    first = tuning.where(F.col(fold) == 0).groupBy(*by).agg(F.max_by(angle, F.struct(F.col("tuning"), -F.col(angle))).alias("_hi"), F.min_by(angle, F.struct("tuning", angle)).alias("_lo"))
    both = tuning.where(F.col(fold) == 1).join(first, by)
    hi, lo = F.max(F.when(F.col(angle) == F.col("_hi"), F.col("tuning"))), F.max(F.when(F.col(angle) == F.col("_lo"), F.col("tuning")))
    return both.groupBy(*by).agg(F.try_divide(hi - lo, hi + lo).alias("selectivity"))


def isi_histogram(points: DataFrame, by: list[str], on: str, per_decade: int = 5) -> DataFrame:
    """(by, bin, share): intervals between a key's events in logarithmic bins, normalised."""
    gaps = points.withColumn("_d", F.col(on) - F.lag(on, 1).over(Window.partitionBy(*by).orderBy(on))).where("_d > 0")
    n = gaps.groupBy(*by, F.floor(F.log10("_d") * per_decade).alias("bin")).agg(F.count("*").alias("_n"))
    return n.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
