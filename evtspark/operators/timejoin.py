"""Joins of long event tables by time: as-of, interval and window joins, clock maps.

Times are doubles in seconds; NaN counts as missing. ``by`` lists the equality
columns. No join here compares all rows of a session with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _time(c: Column) -> Column:
    return F.when(F.isnan(c.cast("double")), None).otherwise(c.cast("double"))


def neighbours(left: DataFrame, right: DataFrame, by: list[str], on: str = "t", allow_equal: bool = False, bucket: float | None = None) -> DataFrame:
    """``left`` with the structs ``before`` and ``after``: the right rows next to it in time, found in one pass.

    before is strictly earlier and after at or after the left time; with
    ``allow_equal`` before is at or before and after strictly after. A missing time
    has neither. Of right rows with the same time any one is taken.

    One shuffle by key; with ``bucket`` (seconds) the rows of a key are dealt out
    by time as well, and only each bucket's first and last right row is carried
    over, so that one long session does not become one task.
    """
    names = right.columns
    payload = F.struct(*[F.col(c) for c in names])
    rank_right = 0 if allow_equal else 1
    slot = (lambda c: F.floor(c / F.lit(bucket))) if bucket else (lambda c: F.lit(0).cast("bigint"))
    empty = F.lit(None).cast(right.select(payload.alias("s")).schema["s"].dataType)
    l_rows = left.select(*by, _time(F.col(on)).alias("_t"), F.lit(1 - rank_right).alias("_k"), empty.alias("_r"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    l_type = l_rows.schema["_l"].dataType
    r_rows = right.where(_time(F.col(on)).isNotNull()).select(*by, _time(F.col(on)).alias("_t"), F.lit(rank_right).alias("_k"), payload.alias("_r"), F.lit(None).cast(l_type).alias("_l"))
    both = l_rows.unionByName(r_rows).withColumn("_b", slot(F.col("_t")))
    # two running frames, forwards and backwards: a frame that ends at the partition's end would be summed anew for every row
    w, back_w = Window.partitionBy(*by, "_b").orderBy("_t", "_k"), Window.partitionBy(*by, "_b").orderBy(F.desc("_t"), F.desc("_k"))
    running = (Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({"_prev": F.last("_r", True).over(w.rowsBetween(*running)), "_next": F.last("_r", True).over(back_w.rowsBetween(*running))})
    if bucket:
        edge = r_rows.withColumn("_b", slot(F.col("_t"))).groupBy(*by, "_b").agg(F.max_by("_r", "_t").alias("_last"), F.min_by("_r", "_t").alias("_first"))
        # a bucket without right rows still needs its neighbours'
        marks = l_rows.select(*by, slot(F.col("_t")).alias("_b")).distinct().join(edge, [*by, "_b"], "full")
        over, back_over = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by).orderBy(F.desc("_b"))
        marks = marks.select(
            *by, "_b", F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.last("_first", True).over(back_over.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
        )
        seen = seen.join(marks, [*by, "_b"], "left").withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    out = seen.where(F.col("_l").isNotNull())
    some = F.col("_t").isNotNull()
    return out.select("_l.*", F.when(some, F.col("_prev")).alias("before"), F.when(some, F.col("_next")).alias("after"))


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str = "t", mode: str = "nearest", tolerance: float | None = None,
    allow_equal: bool = False, bucket: float | None = None,
) -> DataFrame:
    """``left`` with a struct ``match`` of the right row that is previous, next or nearest in time, as ``neighbours`` has them.

    Of equally near rows the earlier wins. A missing time, or a match farther than
    ``tolerance``, gives null.
    """
    out = neighbours(left, right, by, on, allow_equal, bucket)
    t, before, after = _time(F.col(on)), F.col("before"), F.col("after")
    back, ahead = t - before[on].cast("double"), after[on].cast("double") - t
    if mode == "previous":
        match = before
    elif mode == "next":
        match = after
    else:
        match = F.when(after.isNull() | (back <= ahead), F.coalesce(before, after)).otherwise(after)
    if tolerance is not None:
        match = F.when(F.abs(match[on].cast("double") - t) <= tolerance, match)
    return out.withColumn("match", match).drop("before", "after")


def bucket_by_interval(
    points: DataFrame, intervals: DataFrame, by: list[str], start: str = "t_on", stop: str = "t_off", on: str = "t", closed: str = "left", bucket: float | None = None,
) -> DataFrame:
    """Points with the struct ``interval`` that holds them: [start, stop) by default, ``both`` for [start, stop].

    Intervals of one key do not overlap; points outside every interval are dropped.
    """
    right = intervals.withColumnRenamed(start, "_on")
    found = asof_join(points.withColumn("_on", F.col(on)), right, by, "_on", "previous", allow_equal=True, bucket=bucket).drop("_on")
    end = F.col("match")[stop]
    inside = (F.col(on) <= end) if closed == "both" else (F.col(on) < end)
    return found.where(F.col("match").isNotNull() & inside).withColumnRenamed("match", "interval")


def peri_event_join(points: DataFrame, events: DataFrame, by: list[str], pre: float, post: float, on: str = "t", event_time: str = "t0") -> DataFrame:
    """All pairs with event - pre <= point <= event + post, and ``dt`` = point - event.

    Both sides are bucketed by the window's length: a point has one bucket and an
    event at most two, so the equality join on (key, bucket) makes few misses.
    """
    width = F.lit(float(pre + post) or 1.0)
    p = points.withColumn("_b", F.floor(F.col(on) / width))
    e = events.withColumn("_b", F.explode(F.sequence(F.floor((F.col(event_time) - pre) / width), F.floor((F.col(event_time) + post) / width))))
    dt = F.col(on) - F.col(event_time)
    return p.join(e, [*by, "_b"]).where((F.col(on) >= F.col(event_time) - pre) & (F.col(on) <= F.col(event_time) + post)).drop("_b").withColumn("dt", dt)


def align_clock(events: DataFrame, clock_map: DataFrame, by: list[str], on: str = "t", src: str = "t_src", dst: str = "t_dst", bucket: float | None = None) -> DataFrame:
    """``t_aligned``: linear between the two surrounding reference points, shifted by the nearest one outside."""
    ref = clock_map.select(*by, F.col(src).alias("_s"), F.col(dst).alias("_d"))
    found = neighbours(events.withColumn("_s", F.col(on)), ref, by, "_s", allow_equal=True, bucket=bucket)
    s, a, z = F.col(on), F.col("before"), F.col("after")
    between = a["_d"] + (s - a["_s"]) * (z["_d"] - a["_d"]) / (z["_s"] - a["_s"])
    out = F.when(a.isNull(), s + z["_d"] - z["_s"]).when(z.isNull(), s + a["_d"] - a["_s"]).otherwise(between)
    return found.withColumn("t_aligned", out).drop("_s", "before", "after")


def sample_signal(signal: DataFrame, events: DataFrame, by: list[str], grid: list[float], on: str = "t", value: str = "v", event_time: str = "t0", baseline: str | None = None, bucket: float | None = None) -> DataFrame:
    """The signal at event + grid, linear between samples and held at the ends; ``baseline`` 'zero' or 'pre' is subtracted."""
    places = events.withColumn("lag", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn("_s", F.col(event_time) + F.col("lag"))
    ref = signal.select(*by, F.col(on).alias("_s"), F.col(value).alias("_v"))
    b = neighbours(places, ref, by, "_s", allow_equal=True, bucket=bucket)
    x, z = F.col("before"), F.col("after")
    out = F.when(x.isNull(), z["_v"]).when(z.isNull(), x["_v"]).otherwise(x["_v"] + (F.col("_s") - x["_s"]) * (z["_v"] - x["_v"]) / (z["_s"] - x["_s"]))
    b = b.withColumn("sample", out).drop("_s", "before", "after")
    w = Window.partitionBy(*by, event_time)
    if baseline == "zero":
        near = min(grid, key=abs)
        b = b.withColumn("sample", F.col("sample") - F.max(F.when(F.col("lag") == near, F.col("sample"))).over(w))
    elif baseline == "pre":
        b = b.withColumn("sample", F.col("sample") - F.avg(F.when(F.col("lag") < 0, F.col("sample"))).over(w))
    return b


def label_bins(bins: DataFrame, trials: DataFrame, by: list[str], on: str = "t", start: str = "t_on", stop: str = "t_off", label: str = "trial", bucket: float | None = None) -> DataFrame:
    """``bins`` with the number of the trial that holds each bin's time, null outside."""
    found = asof_join(bins.withColumn("_on", F.col(on)), trials.withColumnRenamed(start, "_on"), by, "_on", "previous", allow_equal=True, bucket=bucket).drop("_on")
    return found.withColumn(label, F.when(F.col(on) < F.col("match")[stop], F.col("match")[label])).drop("match")


def ranges_overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Whether two half-open ranges share a point."""
    return (a_start < b_stop) & (b_start < a_stop)


def count_overlaps(rows: DataFrame, by: list[str], key: str, start: Column, stop: Column) -> DataFrame:
    """One row (n): pairs of rows alike in ``by``, the first of the smaller key, whose half-open ranges share a point.

    Rows are counted by their range first, so that ranges that differ meet one
    another, not rows. Of all ordered pairs those of one key go; of the rest every
    second has the smaller key first.
    """
    known = rows.select(*by, F.col(key).alias("_key"), start.alias("_on"), stop.alias("_off"))
    known = known.where(" AND ".join(f"`{c}` IS NOT NULL" for c in known.columns))

    def ordered(keys: list[str], name: str) -> DataFrame:
        n = known.groupBy(*keys, "_on", "_off").agg(F.count("*").alias("_n"))
        a, b = n.alias("a"), n.alias("b")
        meet = ranges_overlap(F.col("a._on"), F.col("a._off"), F.col("b._on"), F.col("b._off"))
        for k in keys:
            meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.join(b, meet).agg(F.coalesce(F.sum(F.col("a._n") * F.col("b._n")), F.lit(0)).alias(name))

    both = ordered(by, "_all").crossJoin(F.broadcast(ordered([*by, "_key"], "_own")))  # one row each
    return both.select(F.expr("(_all - _own) div 2").alias("n"))
