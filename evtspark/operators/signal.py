"""Window operators over signals and event sequences.

A signal has the key columns ``by`` (session, channel), an order column and a
value; every operator is one window pass per key or an aggregate. With ``bucket``
the rows of a key are dealt out by slices of time of that length (``scan``), so
that a long key is not one task; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtspark.operators.scan import in_slices, scan
from evtspark.operators.timejoin import asof_join, peri_event_join

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def over(by: list[str], *order: str | Column):
    return Window.partitionBy(*by).orderBy(*order)


def valid_trials(trials: DataFrame, by: list[str], trial: str = "trial", repeat: str = "repeat_num", response: str = "response") -> DataFrame:
    """First presentations are valid; where one is unanswered, so is the run's first answered repeat, unless it is the last trial."""
    w = over(by, trial)
    runs = trials.withColumn("_run", F.sum((F.col(repeat) == 1).cast("int")).over(w.rowsBetween(START, 0)))
    run = Window.partitionBy(*by, "_run")
    answered = F.min(F.when((F.col(response) != 0) & ~F.col("_last"), F.col(trial))).over(run)
    first_silent = F.max(((F.col(repeat) == 1) & (F.col(response) == 0)).cast("int")).over(run) == 1
    runs = runs.withColumn("_last", F.col(trial) == F.max(trial).over(Window.partitionBy(*by)))
    return runs.withColumn("valid", (F.col(repeat) == 1) | F.coalesce(first_silent & (F.col(trial) == answered), F.lit(False))).drop("_run", "_last")


def fill_forward(df: DataFrame, by: list[str], order: list[str], col: str, bucket: float | None = None) -> DataFrame:
    """``col`` with nulls replaced by the last value before."""
    if bucket:
        return scan(df, by, order, bucket, {col: ("last", F.col(col))}).select(*df.columns)
    return df.withColumn(col, F.last(col, True).over(over(by, *order).rowsBetween(START, 0)))


def previous_trial(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """``prev_<col>``: the value one row before, 0 for the first."""
    return df.withColumns({f"prev_{c}": F.coalesce(F.lag(c, 1).over(over(by, *order)), F.lit(0)) for c in cols})


def post_flag(df: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """``post``: the row before is flagged; ``post_only``: and this one is not. The first row is neither."""
    before = F.coalesce(F.lag(flag, 1).over(over(by, *order)), F.lit(False))
    return df.withColumns({"post": before, "post_only": before & ~F.col(flag)})


def run_flag(df: DataFrame, by: list[str], order: list[str], cond: str, k: int, forward: bool = False) -> DataFrame:
    """``in_run``: ``cond`` holds for this and the k - 1 rows before (or after)."""
    frame = (0, k - 1) if forward else (-(k - 1), 0)
    return df.withColumn("in_run", F.sum(F.col(cond).cast("int")).over(over(by, *order).rowsBetween(*frame)) == k)


def switch_points(df: DataFrame, by: list[str], order: list[str], cond: str, a: int, b: int) -> DataFrame:
    """``switch``: 1 where a rows with ``cond`` end and b rows without begin, -1 for the mirror; ``block`` counts switches."""
    w, x = over(by, *order), F.coalesce(F.col(cond), F.lit(False)).cast("int")
    before = lambda n: F.sum(x).over(w.rowsBetween(-n, -1))
    rows_before = F.count(F.lit(1)).over(w.rowsBetween(START, -1))
    rows_after = F.count(F.lit(1)).over(Window.partitionBy(*by)) - rows_before
    ahead = lambda n: F.sum(x).over(w.rowsBetween(0, n - 1))
    down = (rows_before >= a) & (rows_after >= b) & (before(a) == a) & (ahead(b) == 0)
    up = (rows_before >= b) & (rows_after >= a) & (before(b) == 0) & (ahead(a) == a)
    out = df.withColumn("switch", F.when(down, 1).when(up, -1).otherwise(0))
    return out.withColumn("block", F.sum(F.abs("switch")).over(w.rowsBetween(START, 0)))


def schmitt(df: DataFrame, by: list[str], order: list[str], value: str, low: float | Column, high: float | Column, bucket: float | None = None) -> DataFrame:
    """``state``: 1 after rising above ``high``, -1 after falling below ``low``, 0 before either; ``flip``: the state changed between 1 and -1."""
    w = over(by, *order)
    level = F.when(F.col(value) > high, 1).when(F.col(value) < low, -1)
    if bucket:
        out = scan(df.withColumn("_level", level), by, order, bucket, {"state": ("last", F.col("_level"))})
        out = scan(out.withColumn("state", F.coalesce("state", F.lit(0))), by, order, bucket, {"_before": ("lag", F.col("state"))})
        return out.withColumn("flip", F.coalesce((F.col("state") != F.col("_before")) & (F.col("state") != 0) & (F.col("_before") != 0), F.lit(False))).drop("_level", "_before")
    out = df.withColumn("state", F.coalesce(F.last(level, True).over(w.rowsBetween(START, 0)), F.lit(0)))
    before = F.lag("state", 1).over(w)
    return out.withColumn("flip", F.coalesce((F.col("state") != before) & (F.col("state") != 0) & (before != 0), F.lit(False)))


def drop_short_states(df: DataFrame, by: list[str], order: list[str], min_rows: int) -> DataFrame:
    """States of fewer than ``min_rows`` rows take the state before them."""
    w = over(by, *order)
    runs = df.withColumn("_run", F.sum(F.coalesce((F.col("state") != F.lag("state", 1).over(w)), F.lit(True)).cast("int")).over(w.rowsBetween(START, 0)))
    long_ = F.when(F.count(F.lit(1)).over(Window.partitionBy(*by, "_run")) >= min_rows, F.col("state"))
    return runs.withColumn("_long", long_).withColumn("state", F.coalesce(F.last("_long", True).over(w.rowsBetween(START, 0)), F.lit(0))).drop("_run", "_long")


def edges(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """``edge``: 1 where the value passes above the threshold, -1 where it comes back, else 0."""
    up = (F.col(value) > threshold).cast("int")
    return df.withColumn("edge", F.coalesce(up - F.lag(up, 1).over(over(by, *order)), F.lit(0)))


def debounce(df: DataFrame, by: list[str], on: str, gap: float) -> DataFrame:
    """Rows not closer than ``gap`` to the row just before, whether that one stays or not."""
    before = F.lag(on, 1).over(over(by, on))
    return df.withColumn("_d", F.col(on) - before).where("_d IS NULL OR _d >= " + repr(float(gap))).drop("_d")


def drop_repeat_polarity(df: DataFrame, by: list[str], order: list[str], polarity: str) -> DataFrame:
    """Of consecutive rows of one polarity keep the first rising (1) and the last falling (-1)."""
    w, p = over(by, *order), F.col(polarity)
    out = df.withColumns({"_b": F.lag(polarity, 1).over(w), "_a": F.lead(polarity, 1).over(w)})
    keep = F.when(p == 1, F.coalesce(F.col("_b") != p, F.lit(True))).otherwise(F.coalesce(F.col("_a") != p, F.lit(True)))
    return out.where(keep).drop("_b", "_a")


def sessionize(df: DataFrame, by: list[str], on: str, gap: float, min_rows: int = 1, bucket: float | None = None) -> DataFrame:
    """(by, period, start, stop, n): runs of events whose gaps are at most ``gap``."""
    if bucket:
        # events of one time are one row to the scans
        times = df.groupBy(*by, on).agg(F.count("*").alias("_n"))
        cut = scan(times, by, [on], bucket, {"_before": ("lag", F.col(on))})
        cut = cut.withColumn("_new", F.coalesce((F.col(on) - F.col("_before")) > gap, F.lit(True)).cast("int"))
        cut = scan(cut, by, [on], bucket, {"period": ("sum", F.col("_new"))})
        return cut.groupBy(*by, "period").agg(F.min(on).alias("start"), F.max(on).alias("stop"), F.sum("_n").alias("n")).where(F.col("n") >= min_rows)
    w = over(by, on)
    cut = df.withColumn("_new", F.coalesce((F.col(on) - F.lag(on, 1).over(w)) > gap, F.lit(True)).cast("int"))
    cut = cut.withColumn("period", F.sum("_new").over(w.rowsBetween(START, 0)))
    return cut.groupBy(*by, "period").agg(F.min(on).alias("start"), F.max(on).alias("stop"), F.count("*").alias("n")).where(F.col("n") >= min_rows)


def closest_period(periods: DataFrame, by: list[str], target: float) -> DataFrame:
    """Of each key the period whose duration is closest to ``target``, its relative mismatch under 1; the first of equals."""
    miss = F.abs(F.col("stop") - F.col("start") - target) / target
    ranked = periods.withColumn("mismatch", miss).where("mismatch < 1").withColumn("_r", F.row_number().over(over(by, "mismatch", "start")))
    return ranked.where("_r = 1").drop("_r")


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """``smooth``: mean of the k rows around (k odd), fewer at the ends."""
    return df.withColumn("smooth", F.avg(value).over(over(by, *order).rowsBetween(-(k // 2), k // 2)))


def moving_median(df: DataFrame, by: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """``smooth``: median of the k rows around (k odd), fewer at the ends."""
    near = F.sort_array(F.collect_list(value).over(over(by, *order).rowsBetween(-(k // 2), k // 2)))
    n = F.size("_near")
    mid = lambda i: F.element_at("_near", i)
    out = df.withColumn("_near", near)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return out.withColumn("smooth", F.when(n > 0, (mid(low) + mid(high)) / 2)).drop("_near")


def velocity(df: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """``velocity``: difference quotient to the row before; null for the first."""
    w = over(by, on)
    return df.withColumn("velocity", F.try_divide(F.col(value) - F.lag(value, 1).over(w), F.col(on) - F.lag(on, 1).over(w)))


def unwrap_counter(value: Column, bits: int = 32) -> Column:
    """A counter read as unsigned, as signed."""
    return F.when(value > 2 ** (bits - 1), value - 2**bits).otherwise(value)


def wheel_degrees(value: Column, counts: int = 1024) -> Column:
    return value * 360.0 / (4 * counts)


def movement_onsets(df: DataFrame, by: list[str], order: list[str], value: str, win: int = 51, threshold: float = 0.0, quiet: int = 50, bucket: float | None = None) -> DataFrame:
    """Starts of sustained movement in one direction: ``direction`` 1 (falling) or 2 (rising) at the onset row, else null.

    In a direction a row is active if the mean of the ``win`` speeds from it on
    reaches the threshold and none points the other way; the onset is the row
    before the first active one after ``quiet`` rows that are not.
    """
    if bucket:
        return in_slices(df, by, order, lambda d, keys: movement_onsets(d, keys, order, value, win, threshold, quiet), quiet + 1, win + 1, bucket)
    w = over(by, *order)
    out = df.withColumn("_dv", F.col(value) - F.lag(value, 1).over(w))
    ahead = w.rowsBetween(0, win - 1)
    for name, sign in (("_l", -1), ("_r", 1)):
        speed = F.col("_dv") * sign
        active = (F.avg(speed).over(ahead) >= threshold) & (F.min(speed).over(ahead) >= 0) & (F.sum(speed).over(ahead) > 0)
        out = out.withColumn(name, F.coalesce(active, F.lit(False)).cast("int"))
        before = F.sum(name).over(w.rowsBetween(-quiet + 1, 0))
        n_before = F.count(F.lit(1)).over(w.rowsBetween(-quiet + 1, 0))
        out = out.withColumn(f"{name}_on", (F.lead(name, 1).over(w) == 1) & (before == 0) & (n_before == quiet))
    return out.withColumn("direction", F.when(F.col("_l_on"), 1).when(F.col("_r_on"), 2)).drop("_dv", "_l", "_r", "_l_on", "_r_on")


def first_crossing(signal: DataFrame, onsets: DataFrame, by: list[str], on: str, value: str, threshold: float, window: float) -> DataFrame:
    """(by, onset, t_cross, direction): first sample within ``window`` of an onset whose value is over ``threshold`` away from the onset's."""
    pairs = peri_event_join(signal, onsets, by, 0.0, window, on, "t0")
    far = pairs.where(F.abs(F.col(value) - F.col("v0")) > threshold)
    hit = far.groupBy(*by, "onset").agg(F.min_by(F.struct(on, value, "v0"), on).alias("h"))
    return hit.select(*by, "onset", F.col(f"h.{on}").alias("t_cross"), F.when(F.col(f"h.{value}") < F.col("h.v0"), 1).otherwise(2).alias("direction"))


def choice_movement(trials: DataFrame, onsets: DataFrame, by: list[str], stim: str = "t_stim", cross: str = "t_cross", on: str = "t") -> DataFrame:
    """Per trial: ``t_choice`` the last onset strictly before crossing, ``t_first`` the first strictly after the stimulus."""
    o = onsets.select(*by, F.col(on).alias("_o"))
    a = asof_join(trials.withColumn("_o", F.col(cross)), o, by, "_o", "previous").withColumn("t_choice", F.col("match")["_o"]).drop("match")
    b = asof_join(a.withColumn("_o", F.col(stim)), o, by, "_o", "next", allow_equal=True).withColumn("t_first", F.col("match")["_o"])
    return b.drop("match", "_o")


def frame_gaps(df: DataFrame, by: list[str], on: str, factor: float = 1.4) -> DataFrame:
    """(by, n_gaps, missed): intervals over ``factor`` medians, and the frames that they miss."""
    steps = df.withColumn("_d", F.col(on) - F.lag(on, 1).over(over(by, on))).where("_d IS NOT NULL")
    median = steps.groupBy(*by).agg(F.percentile("_d", 0.5).alias("_m"))
    gap = F.col("_d") > factor * F.col("_m")
    missed = F.sum(F.when(gap, F.round(F.try_divide(F.col("_d"), F.col("_m"))) - 1).otherwise(0))
    return steps.join(median, by).groupBy(*by).agg(F.sum(gap.cast("long")).alias("n_gaps"), missed.cast("long").alias("missed"))


def merge_ranges(df: DataFrame, by: list[str], start: str, stop: str, extend: bool = True, bucket: float | None = None) -> DataFrame:
    """``df`` with a group number per key: ranges that touch share one.

    ``extend``: a group reaches to its largest stop (true interval merging). Else a
    range joins the group before it while it starts at or before that group's
    first stop, and only ``by``, ``start`` and ``stop`` are returned with the number.
    Groups of that kind lie within merged intervals, so each interval is folded by
    itself, as a stream. Ranges have both ends, and do not stop before they start.
    """
    w = over(by, start, stop)
    if extend and not bucket:
        reach = F.max(stop).over(w.rowsBetween(START, -1))
        return df.withColumn("_n", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")).withColumn("range_group", F.sum("_n").over(w.rowsBetween(START, 0)) - 1).drop("_n")
    ranges = df.groupBy(*by, start, stop).agg(F.count("*").alias("_copies"))

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        """The running number of the groups that ``_new`` opens."""
        if bucket:
            rows = scan(rows, by, [start, stop], bucket, {name: ("sum", F.col("_new"))})
        else:
            rows = rows.withColumn(name, F.sum("_new").over(w.rowsBetween(START, 0)))
        return rows.withColumn(name, F.col(name) - 1).drop("_new")

    if bucket:
        reached = scan(ranges, by, [start, stop], bucket, {"_reach": ("max_before", F.col(stop))})
    else:
        reached = ranges.withColumn("_reach", F.max(stop).over(w.rowsBetween(START, -1)))
    whole = numbered(reached.withColumn("_new", F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("int")).drop("_reach"), "range_group")
    if extend:
        same = [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*by, start, stop]]
        return df.alias("d").join(whole.alias("r"), same, "left").select("d.*", "r.range_group")
    parts = whole.repartition(*by, "range_group").sortWithinPartitions(*by, "range_group", start, stop)
    opened = numbered(_first_stop_groups(parts, [*by, "range_group"], start, stop).drop("range_group"), "range_group")
    return opened.select(*by, start, stop, F.col("range_group").cast("int").alias("range_group"), F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_k")).drop("_k")


def _first_stop_groups(rows: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Sorted ``rows`` with ``_new``, 1 where a range starts after the first stop of the group before it or with new keys."""
    import pyarrow as pa

    def fold(batches):
        at = first = None
        for batch in batches:
            new = []
            columns = [batch.column(c).to_pylist() for c in (*keys, start, stop)]
            for *key, a, z in zip(*columns, strict=True):
                opens = key != at or a > first
                if opens:
                    at, first = key, z
                new.append(int(opens))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.int32())], [*batch.schema.names, "_new"])

    return rows.mapInArrow(fold, rows.withColumn("_new", F.lit(0)).schema)


def merged(df: DataFrame, by: list[str], start: str, stop: str, bucket: float | None = None) -> DataFrame:
    """One row per merged interval."""
    return merge_ranges(df, by, start, stop, bucket=bucket).groupBy(*by, "range_group").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n"))


def digitise(grid: DataFrame, intervals: DataFrame, by: list[str], on: str = "t", start: str = "t_on", stop: str = "t_off", bucket: float | None = None) -> DataFrame:
    """``grid`` with ``inside``, 1 where a time lies in [start, stop) of some interval (merged first)."""
    whole = merged(intervals, by, start, stop, bucket).withColumnRenamed(start, "_on")
    found = asof_join(grid.withColumn("_on", F.col(on)), whole, by, "_on", "previous", allow_equal=True, bucket=bucket).drop("_on")
    return found.withColumn("inside", F.coalesce(F.col(on) < F.col("match")[stop], F.lit(False)).cast("int")).drop("match")


def compact_repeats(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows except those inside a run of one value."""
    w = over(by, *order)
    out = df.withColumns({"_b": F.lag(value, 1).over(w), "_a": F.lead(value, 1).over(w)})
    return out.where(~F.coalesce((F.col("_b") == F.col(value)) & (F.col("_a") == F.col(value)), F.lit(False))).drop("_b", "_a")


def cumulative_drift(matches: DataFrame, by: list[str], day: str, shift: str) -> DataFrame:
    """(by, day, step, drift): median shift per day and its running sum."""
    per = matches.groupBy(*by, day).agg(F.percentile(shift, 0.5).alias("step"))
    return per.withColumn("drift", F.sum("step").over(over(by, day).rowsBetween(START, 0)))


def affine_clock(src: DataFrame, dst: DataFrame, by: list[str], on: str = "t", tolerance: float = 0.01) -> DataFrame:
    """(by, slope, intercept, accepted) from the first and last pulse of both clocks; slopes over ``tolerance`` off 1 are not accepted."""
    s = src.groupBy(*by).agg(F.min(on).alias("s0"), F.max(on).alias("s1"))
    d = dst.groupBy(*by).agg(F.min(on).alias("d0"), F.max(on).alias("d1"))
    slope = F.try_divide(F.col("d1") - F.col("d0"), F.col("s1") - F.col("s0"))
    out = s.join(d, by).withColumn("slope", slope).withColumn("intercept", F.col("d0") - F.col("slope") * F.col("s0"))
    return out.withColumn("accepted", F.coalesce(F.abs(F.col("slope") - 1) <= tolerance, F.lit(False))).drop("s0", "s1", "d0", "d1")


def pulse_thresholds(df: DataFrame, by: list[str], order: list[str], value: str, rows: int, low: float, high: float) -> DataFrame:
    """(by, lo, hi): mean + low and high standard deviations of each key's first ``rows`` rows."""
    first = df.withColumn("_r", F.row_number().over(over(by, *order))).where(F.col("_r") <= rows)
    mean, sd = F.avg(value), F.stddev_samp(value)
    return first.groupBy(*by).agg((mean + low * sd).alias("lo"), (mean + high * sd).alias("hi"))


def pulse_ramps(df: DataFrame, by: list[str], on: str, value: str, rows: int = 1000, low: float = 10.0, high: float = 60.0, plateau: float = 0.1) -> DataFrame:
    """(by, ramp_on, ramp_off): periods above the high threshold for over ``plateau`` seconds, entered and left through the low one."""
    bounds = pulse_thresholds(df, by, [on], value, rows, low, high)
    state = schmitt(df.join(bounds, by), by, [on], value, F.col("lo"), F.col("hi"))
    w = over(by, on)
    turns = state.where("flip OR state = 1").withColumn("_run", F.sum(F.col("flip").cast("int")).over(w.rowsBetween(START, 0)))
    up = turns.where("state = 1").groupBy(*by, "_run").agg(F.min(on).alias("ramp_on"), F.max(on).alias("ramp_off"))
    return up.where(F.col("ramp_off") - F.col("ramp_on") > plateau).drop("_run")


def shifted_correlation(trace: DataFrame, train: DataFrame, by: list[str], bin_col: str, x: str, y: str, lags: list[int]) -> DataFrame:
    """(by, lag, r): correlation of ``x`` at a bin with ``y`` lag bins later."""
    moved = train.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn(bin_col, F.col(bin_col) - F.col("lag"))
    return trace.join(moved, [*by, bin_col]).groupBy(*by, "lag").agg(F.corr(x, y).alias("r"))


def best_reference_channel(events: DataFrame, by: list[str], channel: str, expected: Column) -> DataFrame:
    """(by, channel, n): the channel whose event count is closest to ``expected``; the first of equals."""
    n = events.groupBy(*by, channel).agg(F.count("*").alias("n")).withColumn("_miss", F.abs(F.col("n") - expected))
    return n.withColumn("_r", F.row_number().over(over(by, "_miss", channel))).where("_r = 1").drop("_r", "_miss")


def detect_onsets_2d(frames: DataFrame, by: list[str], frame: str, pixels: str, n_cols: int, degrees: float = 7.5) -> DataFrame:
    """(by, frame, row, col, azimuth, elevation): where a pixel of a flattened grid turns on."""
    long_ = frames.select(*by, frame, F.posexplode(pixels).alias("pix", "on"))
    turned = long_.withColumn("_b", F.lag("on", 1).over(over([*by, "pix"], frame))).where("on AND NOT coalesce(_b, false)")
    row, col = F.floor(F.col("pix") / n_cols), F.col("pix") % n_cols
    return turned.select(*by, frame, row.alias("row"), col.alias("col"), (col * degrees).alias("azimuth"), (row * degrees).alias("elevation"))


def best_end_extension(trials: DataFrame, pulses: DataFrame, by: list[str], candidates: list[float], expected: int) -> DataFrame:
    """(by, pad, n_bad): the padding of trial ends with the fewest trials that lack the expected number of pulses; the smallest of equals.

    Pulses meet trials through the window join, its width the longest padded trial.
    """
    padded = trials.withColumn("pad", F.explode(F.array(*[F.lit(float(c)) for c in candidates])))
    longest = trials.agg(F.max(F.col("t_off") - F.col("t_on"))).first()[0] or 0.0
    pairs = peri_event_join(pulses, trials.withColumn("t0", F.col("t_on")), by, 0.0, longest + max(candidates))
    hits = pairs.withColumn("pad", F.explode(F.array(*[F.lit(float(c)) for c in candidates]))).where(F.col("t") <= F.col("t_off") + F.col("pad"))
    counts = hits.groupBy(*by, "trial", "pad").agg(F.count("*").alias("n"))
    bad = padded.join(counts, [*by, "trial", "pad"], "left").groupBy(*by, "pad").agg(F.sum((F.coalesce("n", F.lit(0)) != expected).cast("long")).alias("n_bad"))
    return bad.withColumn("_r", F.row_number().over(over(by, "n_bad", "pad"))).where("_r = 1").drop("_r")


def motion_thresholds(df: DataFrame, by: list[str], value: str, k: int = 5, min_share: float = 0.02, bins: int = 512) -> DataFrame:
    """(by, low, high): the lowest of ``k`` means of a key's samples with a fair share of them, and that plus the spread of its samples.

    Means are sought on a histogram of ``bins`` bins between the key's least and
    largest sample, begun at equal steps between them, so that a group is so many rows;
    each bin stands for its samples' mean. Keys without samples go.
    """
    import numpy as np

    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    span = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    cells = rows.join(span, by).groupBy(*by, F.coalesce(place, F.lit(0)).alias("_b")).agg(F.count("*").cast("double").alias("_n"), F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"))

    def solve(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_b")
        n, s, q = (pdf[c].to_numpy(float) for c in ("_n", "_s", "_q"))
        x = s / n
        centre = x[0] + (x[-1] - x[0]) * (np.arange(k) + 0.5) / k
        for _ in range(300):
            own = np.abs(x[:, None] - centre[None]).argmin(1)
            many = np.bincount(own, n, k)
            new = np.where(many > 0, np.bincount(own, s, k) / np.maximum(many, 1), centre)
            if np.abs(new - centre).max() < 1e-12:
                break
            centre = new
        kept = np.flatnonzero(many > min_share * n.sum())
        low = kept[centre[kept].argmin()]
        spread = np.sqrt(max(q[own == low].sum() / many[low] - centre[low] ** 2, 0.0))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), centre[low], centre[low] + spread]], columns=[*by, "low", "high"])

    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), "low double, high double"])
    return cells.groupBy(*by).applyInPandas(solve, schema)


def motion_periods(df: DataFrame, by: list[str], on: str, value: str, k: int = 5, min_share: float = 0.02, min_on: float = 0.01, min_off: float = 0.01) -> DataFrame:
    """(by, start, stop): periods of motion by hysteresis between a key's own two thresholds.

    A period ends with the first sample under the lower threshold, or with the last
    one there is; one that nothing under it comes before begins with the first sample.
    Periods of ``min_on`` or less go; then those a pause of ``min_off`` or less parts
    become one.
    """
    told = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(motion_thresholds(df, by, value, k, min_share), by)
    w = over(by, on)
    state = F.last(F.when(F.col(value) > F.col("high"), 1).when(F.col(value) < F.col("low"), -1), True).over(w.rowsBetween(START, 0))
    runs = told.withColumn("state", F.coalesce(state, F.lit(0)))
    first = F.first("state").over(w.rowsBetween(START, 0))
    ahead = F.first(F.when(F.col("state") != 0, F.col("state")), True).over(w.rowsBetween(0, END))
    runs = runs.withColumn("state", F.when((F.col("state") == 0) & (first == 0), ahead).otherwise(F.col("state")))
    runs = runs.withColumn("_run", F.sum(F.coalesce(F.col("state") != F.lag("state", 1).over(w), F.lit(True)).cast("int")).over(w.rowsBetween(START, 0)))
    periods = runs.groupBy(*by, "_run", "state").agg(F.min(on).alias("start"), F.max(on).alias("_last"))
    per = over(by, "_run")
    periods = periods.withColumn("stop", F.coalesce(F.lead("start").over(per), F.col("_last"))).where("state = 1").where(F.col("stop") - F.col("start") > min_on)
    timed = over(by, "start")
    parted = F.coalesce(F.col("start") - F.lag("stop").over(timed) > min_off, F.lit(True))
    joined = periods.withColumn("_new", parted).withColumn("_k", F.sum(F.col("_new").cast("int")).over(timed.rowsBetween(START, 0)))
    return joined.groupBy(*by, "_k").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_k")


def robust_align(t1: DataFrame, t2: DataFrame, by: list[str], on: str = "t", threshold: float = 0.5, search: int = 10, max_skips: int | None = None) -> DataFrame:
    """(by, i1, i2): positions of matching events of two clocks, by their intervals.

    Per key (an event train of a session): the offset of up to ``search`` events
    with the smallest interval mismatch over ten intervals is taken, then events
    around mismatching intervals are passed over on the side that lags. Where that
    passes over more than ``max_skips`` events (50 and a fortieth of the events, 500
    at most), the trains are aligned from their ends; a key that fails so as well has
    no rows.
    """
    schema = ", ".join([*(f"{k} {t1.schema[k].dataType.simpleString()}" for k in by), "i1 int", "i2 int"])

    def align(key, a, b):
        import numpy as np
        import pandas as pd

        x, y = np.sort(a[on].to_numpy(float)), np.sort(b[on].to_numpy(float))
        most = 50 + min(len(x) // 40, 450) if max_skips is None else max_skips

        def matched(x, y):
            """Pairs of positions, or None after too many events passed over."""

            def cost(s):
                u, v = np.diff(x[max(0, s) :])[:10], np.diff(y[max(0, -s) :])[:10]
                n = min(len(u), len(v))
                return np.abs(u[:n] - v[:n]).mean() if n >= 3 else np.inf

            s = min(range(-search, search + 1), key=lambda k: (cost(k), abs(k))) if len(x) > 1 and len(y) > 1 else 0
            i, j, out, skips = max(0, s), max(0, -s), [], 0
            while i < len(x) and j < len(y):
                if out:
                    du, dv = x[i] - x[out[-1][0]], y[j] - y[out[-1][1]]
                    if abs(du - dv) > threshold:
                        i, j, skips = (i + 1, j, skips + 1) if du < dv else (i, j + 1, skips + 1)
                        if skips > most:
                            return None
                        continue
                out.append((i, j))
                i, j = i + 1, j + 1
            return out

        out = matched(x, y)
        if out is None:
            back = matched(-x[::-1], -y[::-1]) or []
            out = [(len(x) - 1 - i, len(y) - 1 - j) for i, j in reversed(back)]
        made = pd.DataFrame(out, columns=["i1", "i2"]).astype("int32")
        for n, v in zip(by, key, strict=True):
            made[n] = v
        return made[[*by, "i1", "i2"]]

    return t1.groupBy(*by).cogroup(t2.groupBy(*by)).applyInPandas(align, schema)
