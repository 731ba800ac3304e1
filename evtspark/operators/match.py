"""Matching rows across tables and days, ranking and reshaping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtspark.operators.scan import first_rows
from evtspark.operators.summary import LIST_COLUMNS, best_of_both, most_columns, packed_columns
from evtspark.staging import stage

#: Partners that a column lists when pairs are matched, at least and at most, and about how many rows a side lists in all between them.
LISTED, LISTED_MOST, LISTED_ROWS = 16, 64, 1_000_000


def is_member(a: DataFrame, b: DataFrame, value: str, pos: str) -> DataFrame:
    """``a`` with ``position``: the first position of its value in ``b``, null if there is none."""
    first = b.groupBy(value).agg(F.min(pos).alias("position"))
    return a.join(first, value, "left")


def match_sites(local: DataFrame, target: DataFrame, key: str, x: str = "x", y: str = "y", site: str = "site") -> DataFrame:
    """(key, site): exact position, else x - 32, x + 32, y - 15, y + 15; the first of these with exactly one site, else null."""
    moves = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(((0, 0), (-32, 0), (32, 0), (0, -15), (0, 15)))])
    tried = local.withColumn("m", F.explode(moves)).select(key, "m.step", (F.col(x) + F.col("m.dx")).alias(x), (F.col(y) + F.col("m.dy")).alias(y))
    places = target.groupBy(x, y).agg(F.count("*").alias("_n"), F.min(site).alias("_s"))  # a crowded place is met as one row
    hits = tried.join(places, [x, y]).groupBy(key, "step").agg(F.sum("_n").alias("_n"), F.min("_s").alias("_s")).where("_n = 1")
    found = hits.groupBy(key).agg(F.min_by("_s", "step").alias(site))
    return local.select(key).join(found, key, "left")


def voxel_lookup(points: DataFrame, voxels: DataFrame, key: str, axes: list[str], origin: list[float], step: float, label: str = "label") -> DataFrame:
    """(key, label): label of the voxel that holds each point, null outside."""
    cells = points.select(key, *[F.round((F.col(a) - o) / step).cast("int").alias(f"_{a}") for a, o in zip(axes, origin, strict=True)])
    named = voxels.select(*[F.col(c).cast("int").alias(f"_{a}") for c, a in zip("ijk", axes, strict=False)], label)
    return cells.join(named, [f"_{a}" for a in axes], "left").select(key, label)


def voxel_shares(points: DataFrame, voxels: DataFrame, key: str, axes: list[str], origin: list[float], step: float, radius: int, label: str = "label") -> DataFrame:
    """(key, label, share): labels of the voxels within ``radius`` voxels of each point."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    cells = points.select(key, *[F.round((F.col(a) - o) / step).cast("int").alias(f"_{a}") for a, o in zip(axes, origin, strict=True)])
    far = F.lit(0)
    for a in axes:
        cells = cells.withColumn("_o", F.explode(span)).withColumn(f"_{a}", F.col(f"_{a}") + F.col("_o")).withColumn(f"_d{a}", F.col("_o") * F.col("_o")).drop("_o")
        far = far + F.col(f"_d{a}")
    near = cells.where(far <= radius * radius)
    named = voxels.select(*[F.col(c).cast("int").alias(f"_{a}") for c, a in zip("ijk", axes, strict=False)], label)
    n = near.join(named, [f"_{a}" for a in axes]).groupBy(key, label).agg(F.count("*").alias("_n"))
    return n.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(key))).drop("_n")


def complete(units: DataFrame, metrics: DataFrame, by: list[str], defaults: dict[str, float]) -> DataFrame:
    """Every unit with its metrics, defaults where they are missing."""
    out = units.join(metrics, by, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def attach_scores(units: DataFrame, scores: DataFrame, by: list[str], event: str, value: str, events: list[str], prefix: str = "kernelVE_") -> DataFrame:
    """``units`` with a score column per event."""
    wide = scores.groupBy(*by).pivot(event, events).agg(F.first(value, True))
    return units.join(wide.select(*by, *[F.col(e).alias(f"{prefix}{e}") for e in events]), by, "left")


def pair_sessions(active: DataFrame, passive: DataFrame, by: list[str], key: str, duration: str, strict_over: float | None = None) -> DataFrame:
    """(key, passive): the same day's longest passive session, or with ``strict_over`` the only one longer than that."""
    p = passive.select(*by, F.col(key).alias("_p"), F.col(duration).alias("_d"))
    if strict_over is not None:
        one = p.where(F.col("_d") > strict_over).groupBy(*by).agg(F.count("*").alias("_n"), F.max("_p").alias("passive")).where("_n = 1").drop("_n")
    else:
        one = p.groupBy(*by).agg(F.max_by("_p", F.struct(F.col("_d"), -F.col("_p"))).alias("passive"))
    return active.join(one, by).select(key, "passive")


def nearest_prior_session(sessions: DataFrame, by: list[str], day: str, near: str, key: str) -> DataFrame:
    """(by, key): the latest session up to ``near``, else the earliest after it."""
    before = F.col(day) <= near
    prior = F.max_by(F.when(before, F.col(key)), F.when(before, F.struct(day, key)))
    first = F.min_by(key, F.struct(day, key))
    return sessions.groupBy(*by).agg(F.coalesce(prior, first).alias(key))


def chain_matches(pairs: list[DataFrame]) -> DataFrame:
    """Day-to-day pairs (a, b, score) as tracks (u0, u1, ...) present on every day; each b keeps its best a first."""
    out = None
    for k, p in enumerate(pairs):
        w = Window.partitionBy("b").orderBy(F.desc("score"), "a")
        step = p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("a").alias(f"u{k}"), F.col("b").alias(f"u{k + 1}"))
        out = step if out is None else out.join(step, f"u{k}")
    return out


def pair_distance(pairs: DataFrame, d1: DataFrame, d2: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """(a, b, distance): Euclidean distance of matched units."""
    left, right = d1.select(F.col(unit).alias("a"), F.col(x).alias("_x1"), F.col(y).alias("_y1")), d2.select(F.col(unit).alias("b"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.hypot(F.col("_x1") - F.col("_x2"), F.col("_y1") - F.col("_y2")).alias("distance"))


def with_controls(trials: DataFrame, session: str, perturbed: Column, condition: list[str]) -> DataFrame:
    """(condition, rows): the perturbed trials of each condition, and the unperturbed ones of its sessions."""
    hit = trials.where(perturbed)
    sessions = hit.select(*condition, session).distinct()
    controls = trials.where(~perturbed).drop(*condition).join(sessions, session).withColumn("control", F.lit(True))
    return hit.withColumn("control", F.lit(False)).unionByName(controls)


def top_n(df: DataFrame, by: list[str], score: str, n: int, tie: str) -> DataFrame:
    """The n best rows of each key by falling score; missing scores go."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    kept = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_n(df: DataFrame, by: list[str], order: list[str], n: int, pad: bool = False) -> DataFrame:
    """The first n rows of each key with their ``rank``; with ``pad``, keys of fewer rows are filled up to n with rows of nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    if not pad:
        return kept
    short = df.groupBy(*by).agg(F.count("*").cast("int").alias("_n")).where(F.col("_n") < n)
    return kept.unionByName(short.select(*by, F.explode(F.sequence(F.col("_n") + 1, F.lit(n))).alias("rank")), allowMissingColumns=True)


def equalise_counts(df: DataFrame, by: list[str], klass: str, order: Column, max_n: int | None = None, width: float | None = None) -> DataFrame:
    """As many rows of every class as the smallest has, the first by ``order`` (a seeded hash).

    With ``width`` the order is a struct that begins with a number; its slices of
    ``width`` are counted and only one of a class is sorted, for classes too long for one task's sort.
    """
    sizes = df.groupBy(*by, klass).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.min("_n").alias("_m"))
    w = Window.partitionBy(*by, klass).orderBy(order)
    limit = F.least(F.col("_m"), F.lit(max_n)) if max_n else F.col("_m")
    if width:
        sizes = stage(sizes.withColumn("_m", limit))
        first = df.withColumn("_order", order).withColumn("_at", F.expr("_order").getField(df.select(order.alias("_o")).schema["_o"].dataType.names[0]))
        first = first.join(sizes, by) if by else first.crossJoin(F.broadcast(sizes))
        return first_rows(first, [*by, klass], ["_at", "_order"], "_m", width).where("_first").select(*by, *[c for c in df.columns if c not in by])
    ranked = df.withColumn("_r", F.row_number().over(w))
    joined = ranked.join(sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))  # sizes is one row without keys
    return joined.where(F.col("_r") <= limit).drop("_r", "_m")


def order_trials(df: DataFrame, by: list[str], measure: str, tie: str, descending: bool = False) -> DataFrame:
    """``place``: the trial's rank in its group by the measure."""
    c = F.desc(measure) if descending else F.asc(measure)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)))


def best_model(scores: DataFrame, by: list[str], model: str, score: str) -> DataFrame:
    """(by, model, score): largest mean over repeats; the first name of equals."""
    mean = scores.groupBy(*by, model).agg(F.avg(score).alias(score))
    w = Window.partitionBy(*by).orderBy(F.desc(score), model)
    return mean.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unwrap_probes(sessions: DataFrame, flags: str, done: str = "1") -> DataFrame:
    """A row per probe whose part of the comma list is ``done``; ``probe`` counts from 0."""
    parts = sessions.select("*", F.posexplode(F.split(flags, ",")).alias("probe", "_f"))
    return parts.where(F.col("_f") == done).drop("_f")


def merge_probes(df: DataFrame, probe: str, unit: str, offset: int = 1000) -> DataFrame:
    """Unit numbers made unique over probes."""
    return df.withColumn(unit, F.col(unit) + offset * F.col(probe))


def concat_trials(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of trial tables with their session's name; missing columns are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("session_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def greedy_match(corr: DataFrame, by: list[str], a: str, b: str, score: str) -> DataFrame:
    """(by, a, b, step): pairs taken by falling score, each unit once per key (a pair of days); of equal scores the smaller a, then b.

    A pair that is the best left of both its units is one that the greedy order
    takes, whatever comes before, so all such pairs are taken in one round. Rounds
    are windows and joins by unit; their number grows slowly with a key's units.
    Missing scores go.
    """
    left = stage(corr.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*by, a, b, score))
    taken = None
    while not left.isEmpty():
        order = (F.desc(score), F.asc(a), F.asc(b))
        ranked = left.withColumn("_a", F.row_number().over(Window.partitionBy(*by, a).orderBy(*order)))
        ranked = ranked.withColumn("_b", F.row_number().over(Window.partitionBy(*by, b).orderBy(*order)))
        now = stage(ranked.where("_a = 1 AND _b = 1").select(*by, a, b, score))
        taken = now if taken is None else taken.unionByName(now)
        left = stage(left.join(now.select(*by, a), [*by, a], "left_anti").join(now.select(*by, b), [*by, b], "left_anti").select(*by, a, b, score))
    taken = left if taken is None else taken
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), a, b)) - 1
    return taken.select(*by, a, b, place.alias("step"))


def _without(df: DataFrame, by: list[str], on: str, taken: DataFrame, unit: str) -> DataFrame:
    """Rows of ``df`` whose key and ``on`` are no key and ``unit`` that is taken; a null key is a key."""
    gone = taken.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col(unit).alias("_gone"))
    same = F.col(on) == F.col("_gone")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(gone, same, "left_anti")


def greedy_match_columns(first: DataFrame, second: DataFrame, by: list[str], row: str, col: str, value: str) -> DataFrame:
    """(by, a, b, step): ``greedy_match`` by the correlations of two long matrices' columns, without a row per pair.

    Each column has a list of its best partners, best first. The pairs that are first in
    both lists are those that the greedy order takes, and leave the lists; once there are
    none, as lists have run out, the columns left are listed anew. A listing leaves the
    best pair at least, lists of LISTED and more leave few columns to the next.
    """
    sides = [stage(packed_columns(df.where(F.col(col).isNotNull()), by, col, row, value)) for df in (first, second)]
    w = Window.partitionBy(*by, "side", F.when(F.col("side") == 0, F.col("a")), F.when(F.col("side") == 1, F.col("b"))).orderBy(F.desc("r"), "a", "b")
    taken = None
    while True:
        most = most_columns(sides, by)
        left = stage(best_of_both(*sides, by, max(LISTED, min(LISTED_MOST, LISTED_ROWS // max(most, 1))), max(1, math.ceil(most / LIST_COLUMNS))))
        if taken is not None and left.isEmpty():
            break
        found = None
        while True:
            top = left.withColumn("_k", F.row_number().over(w)).where("_k = 1")
            now = stage(top.groupBy(*by, "a", "b").agg(F.count("*").alias("_n"), F.max("r").alias("r")).where("_n = 2").drop("_n"))
            if found is not None and now.isEmpty():
                break
            found = now if found is None else found.unionByName(now)
            left = stage(_without(_without(left, by, "a", now, "a"), by, "b", now, "b"))
        taken = found if taken is None else taken.unionByName(found)
        sides = [stage(_without(s, by, "c", found, unit)) for s, unit in zip(sides, "ab", strict=True)]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("r"), "a", "b")) - 1
    return taken.select(*by, "a", "b", place.alias("step"))
