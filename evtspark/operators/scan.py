"""Running values over keys too long for one task's sort.

A key's rows are cut into slices of time. Each slice is scanned by itself and
reduced to one row; those rows are scanned per key, and every slice goes on from
the state that the slices before it leave. A key may so be dealt out over all
tasks, where a plain window sorts it in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtspark.staging import stage

START, END = Window.unboundedPreceding, Window.unboundedFollowing
KINDS = ("last", "max", "max_before", "sum", "lag", "lead")


def time_slice(on: str | Column, bucket: float) -> Column:
    """The number of a time's slice of ``bucket`` units; nulls have the first of all, NaN the last, as they sort."""
    t = (F.col(on) if isinstance(on, str) else on).cast("double")
    return F.when(t.isNull(), F.lit(-(2**63))).when(F.isnan(t), F.lit(2**63 - 1)).otherwise(F.floor(t / F.lit(float(bucket))))


def _both(op: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(op(a, b))


def scan(df: DataFrame, by: list[str], order: list[str], bucket: float, parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a column per part, the same as of one window per key ordered by ``order``.

    A part is (kind, value): ``last`` the last value up to the row that is not null,
    ``max`` and ``sum`` over the rows up to it, ``max_before`` over those before it,
    ``lag`` and ``lead`` the value one row before and after. ``order`` begins with
    the time that slices are cut by and must leave no ties. A null key is a key.
    Sums of doubles may differ from one window's in their last digits.

    ``df`` is read twice; what is joined to it is one row per slice.
    """
    if unknown := {kind for kind, _ in parts.values()} - set(KINDS):
        raise ValueError(f"kinds are {', '.join(KINDS)}, not {', '.join(sorted(unknown))}")
    rows = df.withColumn("_slice", time_slice(order[0], bucket)).withColumns({f"_x_{n}": x for n, (_, x) in parts.items()})
    w = Window.partitionBy(*by, "_slice").orderBy(*order)
    place = F.struct(*order)
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(START, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(START, -1)
    local, totals, carried, joined = {}, [], [], {}
    for n, (kind, _) in parts.items():
        x, held = F.col(f"_x_{n}"), F.struct(F.col(f"_x_{n}").alias("v"))
        here, before, total = F.col(f"_l_{n}"), F.col(f"_c_{n}"), F.col(f"_t_{n}")
        if kind == "last":
            local[n], made = F.last(x, True).over(w.rowsBetween(START, 0)), F.max_by(x, F.when(x.isNotNull(), place))
            gone, joined[n] = F.last(total, True).over(earlier), F.coalesce(here, before)
        elif kind in ("max", "max_before"):
            local[n], made = F.max(x).over(w.rowsBetween(START, 0 if kind == "max" else -1)), F.max(x)
            gone, joined[n] = F.max(total).over(earlier), F.greatest(here, before)
        elif kind == "sum":
            local[n], made = F.sum(x).over(w.rowsBetween(START, 0)), F.sum(x)
            gone, joined[n] = F.sum(total).over(earlier), _both(lambda a, b: a + b, here, before)
        else:
            side, frame = (F.lag, earlier) if kind == "lag" else (F.lead, later)
            local[n], made = side(held, 1).over(w), (F.max_by if kind == "lag" else F.min_by)(held, place)
            gone, joined[n] = F.last(total, True).over(frame), F.coalesce(here, before)["v"]
        totals.append(made.alias(f"_t_{n}"))
        carried.append(gone.alias(f"_c_{n}"))
    keys = [*by, "_slice"]
    slices = rows.groupBy(*keys).agg(*totals).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *carried)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    seen = rows.withColumns({f"_l_{n}": c for n, c in local.items()})
    return seen.join(slices, same, "left").select(*[F.col(c) for c in df.columns if c not in parts], *[joined[n].alias(n) for n in parts])


def first_rows(df: DataFrame, by: list[str], order: list[str], quota: str, width: float) -> DataFrame:
    """``df`` with ``_first``: whether a row is one of its key's ``quota`` first by ``order``; the column ``quota`` is the same in all rows of a key.

    ``order`` begins with a number, whose slices of ``width`` are counted. Only the
    rows of the slice that a quota ends in are sorted; no other row is moved.
    """
    rows = df.withColumn("_slice", time_slice(order[0], width))
    n = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_n"), F.max(quota).alias("_m"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(START, 0))
    ends = n.withColumn("_upto", upto).where("_upto - _n <= _m AND _m < _upto")
    ends = stage(ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_slice").alias("_end"), (F.col("_m") - F.col("_upto") + F.col("_n")).alias("_rest")))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    told = rows.join(ends, same, "left")
    clear = told.where("_end IS NULL OR _slice <> _end").withColumn("_first", F.expr("_end IS NULL OR _slice < _end"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    split = told.where("_slice = _end").withColumn("_first", place <= F.col("_rest"))
    return clear.unionByName(split).select(*df.columns, "_first")


def in_slices(
    df: DataFrame, by: list[str], order: list[str], op: Callable[[DataFrame, list[str]], DataFrame], before: int, after: int, bucket: float, rows: int = 1_000_000,
) -> DataFrame:
    """``op(df, by)`` where a row's result hangs on at most ``before`` rows before and ``after`` rows after it in its key.

    ``op`` adds columns to rows or drops rows. It is given slices of ``rows`` rows
    with the rows around them, as groups of a longer key; what it makes of the rows
    around is dropped. Positions come from ``scan`` over slices of ``bucket``.
    """
    if max(before, after) > rows:
        raise ValueError("a slice must not be shorter than what its rows look at")
    placed = scan(df, by, order, bucket, {"_pos": ("sum", F.lit(1).cast("long"))})
    own, at = F.floor((F.col("_pos") - 1) / rows), (F.col("_pos") - 1) % rows
    wanted = F.array(own, F.when((at < after) & (own > 0), own - 1), F.when(at >= rows - before, own + 1))
    spread = placed.withColumn("_own", own).withColumn("_part", F.explode(F.array_compact(wanted)))
    return op(spread, [*by, "_part"]).where("_own = _part").drop("_pos", "_own", "_part")
