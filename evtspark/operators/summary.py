"""Aggregates over trials, units and sessions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtspark.staging import stage

#: Columns of a correlation matrix's block, and of a block that leaves only the best pairs or gives its pairs by and by, which is worked off in stripes.
BLOCK_COLUMNS, LIST_COLUMNS, STRIPE = 1024, 8192, 512

#: Cells that the columns of a block given by and by have in all.
BLOCK_CELLS = 1 << 22

#: Columns of the same cells that are dealt to a block together.
COPIES = 256


def session_performance(trials: DataFrame, by: list[str], kind: str, side: str, feedback: str, response: str) -> DataFrame:
    """Go and no-go counts, accuracy per kind ((feedback + 1) / 2) and bias over as many left as right trials, first ones."""
    w = Window.partitionBy(*by, side).orderBy("trial")
    rows = trials.withColumn("_k", F.row_number().over(w))
    sizes = trials.groupBy(*by).agg(F.least(F.sum((F.col(side) == 1).cast("int")), F.sum((F.col(side) == 2).cast("int"))).alias("_min"))
    acc = (F.col(feedback) + 1) / 2
    go = F.col(response) != 0
    rows = rows.join(sizes, by)
    kinds = {f"accuracy_{k}": F.avg(F.when(go & (F.col(kind) == k), acc)) for k in ("coherent", "visual", "auditory")}
    bias = F.avg(F.when(go & (F.col("_k") <= F.col("_min")), F.col(response) - 1.5))
    return rows.groupBy(*by).agg(F.sum(go.cast("long")).alias("n_go"), F.sum((~go).cast("long")).alias("n_nogo"), *[c.alias(n) for n, c in kinds.items()], bias.alias("bias"))


def rt_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): median and median absolute deviation."""
    med = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"))
    return df.join(med, by).groupBy(*by, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))


def unit_yield(units: DataFrame, by: list[str], good: Column, metric_good: Column) -> DataFrame:
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return units.groupBy(*by).agg(F.count("*").alias("n_units"), count(good).alias("n_good"), count(metric_good).alias("n_metric_good"))


def channel_extent(channels: DataFrame, by: list[str], x: str, y: str, spacing: float = 20.0) -> DataFrame:
    """Extent of the channel positions, and whether the largest step between rows is ``spacing``."""
    rows = channels.select(*by, y).distinct().withColumn("_d", F.col(y) - F.lag(y, 1).over(Window.partitionBy(*by).orderBy(y)))
    step = rows.groupBy(*by).agg(F.coalesce(F.max("_d") == spacing, F.lit(False)).alias("single_type"))
    return channels.groupBy(*by).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max")).join(step, by)


def lr_difference(raster: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """(by, z): of the bins' (mean right - mean left) / deviation right the one farthest from 0, signed; the first of equals."""
    right, left = F.when(F.col(side) == "R", F.col(value)), F.when(F.col(side) == "L", F.col(value))
    z = raster.groupBy(*by, "bin").agg(F.try_divide(F.avg(right) - F.avg(left), F.stddev_pop(right)).alias("z")).where("z IS NOT NULL")
    return z.groupBy(*by).agg(F.max_by("z", F.struct(F.abs("z"), -F.col("bin"))).alias("z"))


def condition_mean(df: DataFrame, cells: list[str], value: str | Column, min_n: int = 1) -> DataFrame:
    """(cells, mean, n): cells with fewer than ``min_n`` values have no mean."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*cells).agg(F.when(F.count(v) >= min_n, F.avg(v)).alias("mean"), F.count(v).alias("n"))


def condition_grid(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, n): count of every combination of the values that occur, also 0."""
    grid = None
    for c in cols:
        values = df.select(c).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return grid.join(df.groupBy(*cols).agg(F.count("*").alias("n")), cols, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def psychometric(trials: DataFrame, kind: str, level: str, right: Column) -> DataFrame:
    """(series, level, p_right, n): trials count in their own series, blanks in the visual and the coherent one."""
    series = F.when(F.col(kind) == "blank", F.array(F.lit("visual"), F.lit("coherent"))).otherwise(F.array(F.col(kind)))
    rows = trials.withColumn("series", F.explode(series)).where(F.col("series").isin("visual", "coherent", "auditory"))
    return rows.groupBy("series", level).agg(F.avg(right).alias("p_right"), F.count("*").alias("n"))


def group_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def unit_position(points: DataFrame, by: list[str], depth: str, x: str, shanks: tuple[float, ...] = (0.0, 200.0, 400.0, 600.0)) -> DataFrame:
    """(by, depth, x, shank): medians, and the nearest shank's number (the first of equals)."""
    med = points.groupBy(*by).agg(F.percentile(depth, 0.5).alias("depth"), F.percentile(x, 0.5).alias("x"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("x") - s).alias("d"), F.lit(k).alias("k")) for k, s in enumerate(shanks)]))["k"]
    return med.withColumn("shank", near)


def centre_of_mass(df: DataFrame, by: list[str], weight: str, place: str, floor: float = 0.3, power: int = 1) -> DataFrame:
    """(by, centre): weighted mean place; weights under ``floor`` of the group's largest count as 0."""
    top = F.max(weight).over(Window.partitionBy(*by))
    w = F.when(F.col(weight) >= floor * top, F.pow(F.col(weight), F.lit(power))).otherwise(0.0)
    return df.withColumn("_w", w).groupBy(*by).agg(F.try_divide(F.sum(F.col("_w") * F.col(place)), F.sum("_w")).alias("centre"))


def condition_classes(trials: DataFrame, cols: list[str], min_n: int, none: float = -1000.0) -> DataFrame:
    """(cols, n, class_id): combinations with at least ``min_n`` trials, missing values as ``none``."""
    filled = trials.select(*[F.coalesce(F.col(c).cast("double"), F.lit(none)).alias(c) for c in cols])
    n = filled.groupBy(*cols).agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    return n.withColumn("class_id", F.dense_rank().over(Window.orderBy(*cols)))  # a row per condition


def modal_parameter_set(trials: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Trials of the keys whose set of value combinations is the most common; the smallest of equally common ones."""
    sets = trials.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_set(F.struct(*cols)))).alias("_set"))
    best = sets.groupBy("_set").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_set").limit(1)
    keep = sets.join(F.broadcast(best), "_set").select(*by)  # one row
    return trials.join(keep, by, "left_semi")


def longest_per_day(sessions: DataFrame, by: list[str], day: str, duration: str) -> DataFrame:
    """Each key's longest session of every day; ties stay."""
    w = Window.partitionBy(*by, day).orderBy(F.desc(duration))
    return sessions.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def best_yield_per_position(sessions: DataFrame, by: list[str], low: str, high: str, day: str, n: str) -> DataFrame:
    """The key's range group with the largest mean yield, and in it the session of the largest yield (the latest of equals)."""
    from evtspark.operators.signal import merge_ranges

    grouped = merge_ranges(sessions, by, low, high)
    mean = grouped.groupBy(*by, "range_group").agg(F.avg(n).alias("_m"))
    best = mean.groupBy(*by).agg(F.max_by("range_group", F.struct(F.col("_m"), -F.col("range_group"))).alias("range_group"))
    w = Window.partitionBy(*by).orderBy(F.desc(n), F.desc(day), low)
    return grouped.join(best, [*by, "range_group"]).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unique_positions(sessions: DataFrame, by: list[str], bottom: str, chronic: Column, order: list[str], grid: float = 720.0, levels: int = 8) -> DataFrame:
    """The first session of each key and snapped bottom row for chronic rows; all others."""
    snap = F.least(F.round(F.col(bottom) / grid), F.lit(levels - 1)) * grid
    rows = sessions.withColumn("snapped", snap)
    first = rows.where(chronic).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "snapped").orderBy(*order))).where("_r = 1").drop("_r")
    return first.unionByName(rows.where(~chronic))


def decay_fit(counts: DataFrame, by: list[str], day: str, n: str, zero: float | None = None) -> DataFrame:
    """(by, slope, intercept): line of log10(count) on day, for more than two days; zero counts take ``zero`` or go."""
    v = F.when(F.col(n) > 0, F.col(n).cast("double")).otherwise(F.lit(zero)) if zero else F.when(F.col(n) > 0, F.col(n).cast("double"))
    rows = counts.withColumn("_y", F.log10(v)).where("_y IS NOT NULL")
    fit = rows.groupBy(*by).agg(F.regr_slope("_y", day).alias("slope"), F.regr_intercept("_y", day).alias("intercept"), F.count_distinct(day).alias("_d"))
    return fit.where("_d > 2").drop("_d")


def variance_explained(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    rest = F.var_pop(F.col(actual) - F.col(predicted))
    return df.groupBy(*by).agg((1 - F.try_divide(rest, F.var_pop(actual))).alias("ve"))


#: Share of its sum of squares under which a column's spread over the common rows counts as none.
FLAT = 1e-13


def packed_columns(df: DataFrame, by: list[str], col: str, row: str, value: str) -> DataFrame:
    """(by, c, rows, values): every column of a long matrix as two arrays, cells without row or value left out."""
    cell = F.struct(F.col(row).alias("row"), F.col(value).cast("double").alias("v"))
    whole = df.where(F.col(row).isNotNull() & F.col(value).isNotNull())
    made = whole.groupBy(*[F.col(k).alias(k) for k in by], F.col(col).alias("c")).agg(F.collect_list(cell).alias("m"))
    return made.select(*by, "c", F.col("m.row").alias("rows"), F.col("m.v").alias("values"))


def most_columns(sides: list[DataFrame], by: list[str]) -> int:
    """Columns that a key has at most on a side."""
    return max(s.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 for s in sides)


def _blocks(sides: list[DataFrame], by: list[str]) -> int:
    """Blocks a side that leave some BLOCK_COLUMNS columns of a key to each."""
    return max(1, math.ceil(most_columns(sides, by) / BLOCK_COLUMNS))


def _wide_blocks(sides: list[DataFrame], by: list[str]) -> int:
    """Blocks a side, of a key's columns, that leave some LIST_COLUMNS columns of BLOCK_CELLS cells to each at most; more for all cores, of BLOCK_COLUMNS then."""
    told = [s.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.size("rows")).alias("cells")).agg(F.count("*"), F.max("n"), F.max("cells")).first() for s in sides]
    keys, most, cells = (max(t[k] or 0 for t in told) for k in range(3))
    spread = math.ceil(math.sqrt(8 * sides[0].sparkSession.sparkContext.defaultParallelism / max(keys, 1)))
    return max(1, math.ceil(most / LIST_COLUMNS), math.ceil(cells / BLOCK_CELLS), min(spread, math.ceil(most / BLOCK_COLUMNS)))


def _with_copies(df: DataFrame, by: list[str]) -> DataFrame:
    """Packed columns with _h, the same for a key's columns of the same cells, and _part, which parts those of more than COPIES."""
    df = df.withColumn("_h", F.xxhash64(*by, F.array_sort(F.arrays_zip("rows", "values"))))
    many = df.groupBy("_h").agg(F.ceil(F.count("*") / COPIES).alias("_parts")).where("_parts > 1")  # one row for COPIES columns at most
    return df.join(F.broadcast(many), "_h", "left").withColumn("_part", F.pmod(F.xxhash64("c"), F.coalesce("_parts", F.lit(1)))).drop("_parts")


def _dealt(left: DataFrame, right: DataFrame, blocks: int, keys: tuple[str, ...] = ("c",)) -> list[DataFrame]:
    """Two tables of packed columns, each column once per block of the other side; _i and _j are the blocks, dealt by ``keys``."""
    out = []
    for df, own, other in ((left, "_i", "_j"), (right, "_j", "_i")):
        df = df.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(blocks)))
        out.append(df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    return out


def _pairs_of_blocks(left: DataFrame, right: DataFrame, by: list[str], blocks: int):
    """The cogroup of every two blocks of a key's columns."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # of one table twice, a cogroup gets the second without its columns
    dealt = _dealt(left, right, blocks)
    return dealt[0].groupBy(*by, "_i", "_j").cogroup(dealt[1].groupBy(*by, "_i", "_j"))


def _stripes(x_rows, x_values, y_rows, y_values, step: int):
    """(first, n, r) of every ``step`` columns of one block with another block: numbers of common rows, and correlations over them, nan where one does not vary."""
    import numpy as np

    _, at = np.unique(np.concatenate([*x_rows, *y_rows]), return_inverse=True)
    width, split = at.max() + 1, sum(len(r) for r in x_rows)

    def matrix(rows, values, at):
        size = np.array([len(r) for r in rows])
        k, v = np.repeat(np.arange(len(size)), size), np.concatenate([np.asarray(c, float) for c in values])
        out, some = np.zeros((len(size), width)), np.zeros((len(size), width))
        out[k, at], some[k, at] = v - (np.bincount(k, v, len(size)) / size)[k], 1.0
        return out, some

    (us, mus), (v, mv) = matrix(x_rows, x_values, at[:split]), matrix(y_rows, y_values, at[split:])
    full = mus.all() and mv.all()
    for low in range(0, len(us), step):
        u, mu = us[low : low + step], mus[low : low + step]
        if full:  # a column's sums are the same in all its pairs
            n, su, sv = np.full((1, 1), float(width)), u.sum(1)[:, None], v.sum(1)[None, :]
            qu, qv = (u * u).sum(1)[:, None], (v * v).sum(1)[None, :]
        else:
            n, su, sv = mu @ mv.T, u @ mv.T, mu @ v.T
            qu, qv = (u * u) @ mv.T, mu @ (v * v).T
        with np.errstate(divide="ignore", invalid="ignore"):
            both = u @ v.T - su * sv / n
            xu, xv = qu - su * su / n, qv - sv * sv / n
            some = (xu > FLAT * qu) & (xv > FLAT * qv)  # less is what rounding leaves of a constant
            r = np.where(some, both / np.sqrt(np.where(some, xu * xv, 1.0)), np.nan)
        yield low, np.broadcast_to(n, r.shape), r.clip(-1, 1)


def _correlations(x_rows, x_values, y_rows, y_values):
    """(n, r) of two blocks of columns, as of one stripe."""
    return next(_stripes(x_rows, x_values, y_rows, y_values, len(x_rows)))[1:]


def _largest(r, n: int):
    """(row, column) of each row's n largest, of equals those of the smaller column; -inf is none."""
    import numpy as np

    keep = r > -np.inf
    if n < r.shape[1]:
        least = np.partition(r, r.shape[1] - n, axis=1)[:, r.shape[1] - n, None]
        keep &= r >= least
        many = keep.sum(1) > n
        over, same = r[many] > least[many], r[many] == least[many]
        keep[many] = over | (same & (np.cumsum(same, 1) <= n - over.sum(1, keepdims=True)))
    return np.nonzero(keep)


def best_of_both(left: DataFrame, right: DataFrame, by: list[str], n: int, blocks: int) -> DataFrame:
    """(by, side, a, b, r) of two tables of packed columns (by, c, rows, values): each a's n largest correlations as side 0, each b's as side 1.

    Of equals those of the smaller other column. A pair of blocks, of ``blocks`` a side,
    is worked off in stripes and leaves n pairs of each of its columns.
    """

    def product(x, y):
        import numpy as np
        import pandas as pd

        names = [*by, "side", "a", "b", "r"]
        if not len(x) or not len(y):
            return pd.DataFrame(columns=names)
        x, y = x.sort_values("c"), y.sort_values("c")
        rows, columns = [], []
        for low, m, r in _stripes(x["rows"], x["values"], y["rows"], y["values"], STRIPE):
            r = np.where((m > 0) & ~np.isnan(r), r, -np.inf)
            i, j = _largest(r, n)
            rows.append((i + low, j, r[i, j]))
            j, i = _largest(np.ascontiguousarray(r.T), n)
            columns.append((i + low, j, r[i, j]))
        i, j, r = (np.concatenate(c) for c in zip(*columns, strict=True))
        order = np.lexsort((i, -r, j))
        i, j, r = i[order], j[order], r[order]
        first = np.arange(len(j)) - np.searchsorted(j, j) < n
        rows.append((i[first], j[first], r[first]))
        i, j, r = (np.concatenate(c) for c in zip(*rows, strict=True))
        out = pd.DataFrame({"side": np.repeat([0, 1], [len(i) - first.sum(), first.sum()]), "a": x["c"].to_numpy()[i], "b": y["c"].to_numpy()[j], "r": r})
        for k in by:
            out[k] = x[k].iloc[0]
        return out[names]

    kinds = [f"{k} {left.schema[k].dataType.simpleString()}" for k in by]
    schema = ", ".join([*kinds, "side int", f"a {left.schema['c'].dataType.simpleString()}", f"b {right.schema['c'].dataType.simpleString()}", "r double"])
    found = _pairs_of_blocks(left, right, by, blocks).applyInPandas(product, schema)
    w = Window.partitionBy(*by, "side", F.when(F.col("side") == 0, F.col("a")), F.when(F.col("side") == 1, F.col("b"))).orderBy(F.desc("r"), "a", "b")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def corr_matrix(a: DataFrame, b: DataFrame, row: str, a_col: str, b_col: str, value: str, by: list[str] | None = None, blocks: int | None = None, best: tuple[int, int] | None = None) -> DataFrame:
    """(by, a, b, r): correlations of the columns of two long matrices over their common rows, null where one does not vary; ``blocks`` and ``best`` as for ``corr_of_packed``."""
    by = by or []
    sides = [packed_columns(a, by, a_col, row, value), packed_columns(b, by, b_col, row, value)]
    return corr_of_packed(*(sides if blocks else [stage(s) for s in sides]), by, blocks, best)


def corr_of_packed(left: DataFrame, right: DataFrame, by: list[str], blocks: int | None = None, best: tuple[int, int] | None = None) -> DataFrame:
    """(by, a, b, r) of two tables of packed columns (by, c, rows, values): ``corr_matrix``.

    Columns are dealt to ``blocks`` blocks a side, by default as ``_wide_blocks`` has
    it; each pair of blocks is one group with a handful of matrix products, so no row is
    joined with a row. A group holds its columns and gives its pairs by and by, some
    BLOCK_COLUMNS squared at a time, so that blocks can be wide and columns are sent
    seldom. Columns of the same cells are then dealt together and stand side by side,
    so that their equal r come in runs, which a file keeps small. ``best``, (n, digits),
    leaves of every pair of blocks only each a's n largest r, rounded to so many digits,
    of equals those of the smaller b, and none without r: all that a choice of n by key
    and a needs; there, and with ``blocks`` given, columns are dealt by name.
    """
    beside = ["_h"] if not blocks and not best else []
    blocks = blocks or _wide_blocks([left, right], by)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        whole = pa.Table.from_batches(list(batches))
        x, y = whole.filter(whole["_left"]), whole.filter(pc.invert(whole["_left"]))
        if not len(x) or not len(y):
            return
        if best:
            y = y.sort_by("b")
        if beside:
            x, y = x.sort_by("_h"), y.sort_by("_h")
        arrays = lambda t: [t[c].to_pandas().to_numpy() for c in ("rows", "values")]
        own = arrays(x)
        for part in [y] if best else [y.slice(k, STRIPE) for k in range(0, len(y), STRIPE)]:
            for low, n, r in _stripes(*own, *arrays(part), STRIPE if best else BLOCK_COLUMNS):
                known = (n > 0) & ~np.isnan(r) if best else n > 0
                if best and best[0] < len(part):
                    key = np.where(known, np.rint(np.where(known, r, 0.0) * 10.0 ** best[1]), -2 * 10.0 ** best[1]).astype(np.int64) * len(part) - np.arange(len(part))
                    top = np.argpartition(-key, best[0] - 1, axis=1)[:, : best[0]]
                    i, j = np.repeat(np.arange(len(r)), best[0]), top.ravel()
                    i, j = i[known[i, j]], j[known[i, j]]
                else:
                    i, j = np.nonzero(known)
                made = x.select([*by, "a"]).take(i + low).append_column("b", part["b"].take(j)).append_column("r", pa.array(r[i, j]))
                yield from made.combine_chunks().to_batches()

    kinds = [f"{k} {left.schema[k].dataType.simpleString()}" for k in by]
    sorts = {c: s.schema["c"].dataType.simpleString() for c, s in (("a", left), ("b", right))}
    schema = ", ".join([*kinds, *(f"{c} {k}" for c, k in sorts.items()), "r double"])
    sides = []
    dealt = _dealt(_with_copies(left, by), _with_copies(right, by), blocks, ("_h", "_part")) if beside else _dealt(left, right, blocks)
    for c, df in zip(sorts, dealt, strict=True):
        ids = [(F.col("c") if k == c else F.lit(None).cast(sorts[k])).alias(k) for k in sorts]
        sides.append(df.select(*by, "_i", "_j", F.lit(c == "a").alias("_left"), *ids, "rows", "values", *beside))
    made = sides[0].unionByName(sides[1]).groupBy(*by, "_i", "_j").applyInArrow(product, schema)
    return made.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def stability_of_columns(first: DataFrame, second: DataFrame, row: str, col: str, value: str, by: list[str], min_pairs: int = 3) -> DataFrame:
    """(by, stability): ``correlation_stability`` of two long matrices' columns; a pair of blocks leaves only the sums of its pairs."""
    whole = packed_columns(first, by, col, row, value).withColumnsRenamed({"rows": "rows1", "values": "values1"})
    whole = stage(whole.join(packed_columns(second, by, col, row, value).withColumnsRenamed({"rows": "rows2", "values": "values2"}), [*by, "c"]))
    names = ["pairs", "n", "x", "y", "xx", "yy", "xy"]

    def product(x, y):
        import numpy as np
        import pandas as pd

        if not len(x) or not len(y):
            return pd.DataFrame(columns=[*by, *names])
        (n1, p), (n2, q) = (_correlations(x[f"rows{k}"], x[f"values{k}"], y[f"rows{k}"], y[f"values{k}"]) for k in (1, 2))
        pair = (x["c"].to_numpy()[:, None] < y["c"].to_numpy()[None, :]) & (n1 > 0) & (n2 > 0)
        known = pair & ~np.isnan(p) & ~np.isnan(q)
        p, q = p[known], q[known]
        sums = [float(pair.sum()), float(len(p)), p.sum(), q.sum(), p @ p, q @ q, p @ q]
        return pd.DataFrame([[*(x[k].iloc[0] for k in by), *sums]], columns=[*by, *names])

    schema = ", ".join([*(f"{k} {first.schema[k].dataType.simpleString()}" for k in by), *(f"{c} double" for c in names)])
    sums = _pairs_of_blocks(whole, whole, by, _blocks([whole], by)).applyInPandas(product, schema).groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    r = F.expr("try_divide(xy - try_divide(x * y, n), sqrt(greatest(xx - try_divide(x * x, n), 0D) * greatest(yy - try_divide(y * y, n), 0D)))")
    return sums.where("pairs > 0").select(*by, F.when(F.col("pairs") > min_pairs, r).alias("stability"))


def signal_noise_corr(resp: DataFrame, by: list[str], stimulus: str, repeat: str, value: str) -> DataFrame:
    """(by, signal, noise): correlation over stimuli of odd and even repeats' means, and of their residuals' means."""
    odd = F.col(repeat) % 2 == 1
    means = resp.groupBy(*by, stimulus).agg(F.avg(F.when(odd, F.col(value))).alias("_o"), F.avg(F.when(~odd, F.col(value))).alias("_e"))
    signal = means.groupBy(*by).agg(F.corr("_o", "_e").alias("signal"))
    rest = resp.withColumn("_rest", F.col(value) - F.avg(value).over(Window.partitionBy(*by, stimulus)))
    pair = rest.withColumn("_p", F.floor((F.col(repeat) - 1) / 2)).groupBy(*by, stimulus, "_p").agg(F.max(F.when(odd, F.col("_rest"))).alias("_o"), F.max(F.when(~odd, F.col("_rest"))).alias("_e"))
    return signal.join(pair.groupBy(*by).agg(F.corr("_o", "_e").alias("noise")), by)


def lagged_noise_corr(resp: DataFrame, by: list[str], unit: str, trial: list[str], stimulus: list[str], bin_col: str, value: str, lags: list[int], blocks: int | None = None) -> DataFrame:
    """(by, a, b, lag, r, gain): for every two units the lag of the largest |r|, ``lags`` in bins, and that r less the one at lag 0.

    r is the correlation of what the mean over a stimulus and bin leaves, of ``a`` lag
    bins after ``b`` in one trial. Bins beyond a trial's ends meet nothing. The
    nearest lag of equal ones is taken, the negative one first; pairs without
    spread at any lag go, gain is null without one at lag 0. ``blocks``: by default as
    many as leave some BLOCK_COLUMNS units to each, 1 where a key has few. Units are packed once for all lags;
    in one block, many keys are dealt to a group.
    """
    mean = F.avg(value).over(Window.partitionBy(*by, unit, *stimulus, bin_col))
    rest = resp.select(*by, F.col(unit).alias("c"), F.to_json(F.struct(*trial)).alias("_t"), F.col(bin_col).cast("long").alias("_b"), (F.col(value) - mean).cast("double").alias("_v"))
    cells = F.collect_list(F.struct("_b", "_v"))
    packed = rest.where("_t IS NOT NULL AND _b IS NOT NULL AND _v IS NOT NULL").groupBy(*by, "c", "_t").agg(cells.alias("_m"))
    packed = packed.groupBy(*by, "c").agg(F.collect_list(F.struct("_t", F.col("_m._b").alias("b"), F.col("_m._v").alias("v"))).alias("_m"))
    packed = stage(packed.select(*by, "c", F.col("_m._t").alias("trials"), F.transform("_m.b", F.size).alias("sizes"), F.flatten("_m.b").alias("bins"), F.flatten("_m.v").alias("values")))
    names = [*by, "a", "b", "lag", "r", "gain"]

    def best(x, y):
        import numpy as np
        import pandas as pd

        size = lambda s: np.array([len(c) for c in s["bins"]])
        codes, _ = pd.factorize(np.concatenate([*x["trials"], *y["trials"]]))
        trials = np.repeat(codes, np.concatenate([*x["sizes"], *y["sizes"]]))
        bins = np.concatenate([*x["bins"], *y["bins"]])
        nx, ny = size(x), size(y)
        split, found = nx.sum(), []
        cut = lambda rows, n: np.split(rows, np.cumsum(n)[:-1])
        low = bins.min() - max(0, -min(lags))
        width = bins.max() + max(0, *lags) - low + 1
        place = trials * width + bins - low  # never of two trials, however the lag
        left = cut(place[:split], nx)
        for lag in lags:
            n, r = _correlations(left, x["values"], cut(place[split:] + lag, ny), y["values"])
            found.append(np.where(n > 0, r, np.nan))
        r = np.array(found)
        order = sorted(range(len(lags)), key=lambda k: (abs(lags[k]), lags[k]))
        key = np.where(np.isnan(r), -1.0, np.round(np.abs(r), 12))[order]
        at = np.array(order)[key.argmax(0)]
        r_best = np.take_along_axis(r, at[None], 0)[0]
        zero = r[lags.index(0)] if 0 in lags else np.full(r_best.shape, np.nan)
        a, b = x["c"], y["c"]
        i, j = np.nonzero(~np.isnan(r_best) & (a[:, None] != b[None, :]))
        return {"a": a[i], "b": b[j], "lag": np.array(lags)[at[i, j]], "r": r_best[i, j], "gain": (r_best - zero)[i, j]}

    parts = ["c", "trials", "sizes", "bins", "values"]

    def pairs(x, y):
        import pandas as pd

        made = best(*({c: s[c].to_numpy() for c in parts} for s in (x, y))) if len(x) and len(y) else {}
        return pd.DataFrame(made | {k: x[k].iloc[0] for k in by if len(made)}, columns=names)

    def dealt(pdf):
        import numpy as np
        import pandas as pd

        own = {c: pdf[c].to_numpy() for c in parts}
        groups = list(pdf.groupby(by, dropna=False, sort=False).indices.values()) if by else [np.arange(len(pdf))]
        made = [best(x, x) for x in ({c: own[c][g] for c in parts} for g in groups)]
        out = {c: np.concatenate([m[c] for m in made]) for c in names[len(by) :]}
        at = np.repeat([g[0] for g in groups], [len(m["r"]) for m in made])
        return pd.DataFrame(out | {k: pdf[k].to_numpy()[at] for k in by}, columns=names)

    kinds = [f"{k} {resp.schema[k].dataType.simpleString()}" for k in by]
    kind = resp.schema[unit].dataType.simpleString()
    schema = ", ".join([*kinds, f"a {kind}", f"b {kind}", "lag int, r double, gain double"])
    blocks = blocks or _blocks([packed], by)
    if blocks == 1:
        deals = max(math.ceil(packed.count() / BLOCK_COLUMNS), packed.sparkSession.sparkContext.defaultParallelism)
        rows = packed.withColumn("_deal", F.pmod(F.xxhash64(*by) if by else F.lit(0), F.lit(deals)))
        found = rows.repartition(deals, "_deal").groupBy("_deal").applyInPandas(dealt, schema)
    else:
        found = _pairs_of_blocks(packed, packed, by, blocks).applyInPandas(pairs, schema)
    return found.withColumn("gain", F.when(~F.isnan("gain"), F.col("gain")))


def correlation_stability(first: DataFrame, second: DataFrame, by: list[str], min_pairs: int = 3) -> DataFrame:
    """(by, stability): correlation of the upper triangles (a < b, r) of two matrices, for more than ``min_pairs`` pairs."""
    both = first.where("a < b").withColumnRenamed("r", "_x").join(second.where("a < b").withColumnRenamed("r", "_y"), [*by, "a", "b"])
    return both.groupBy(*by).agg(F.when(F.count("*") > min_pairs, F.corr("_x", "_y")).alias("stability"))


def rms(signal: DataFrame, by: list[str], value: str, reference: float | None = None, level: float = 0.0) -> DataFrame:
    """(by, rms) and, with a reference, spl = level + 20 log10(rms / reference)."""
    out = signal.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return out.withColumn("spl", level + 20 * F.log10(F.col("rms") / reference)) if reference else out


def robust_zscore(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``z``: distance from the group's median in median absolute deviations; groups without spread go."""
    s = rt_summary(df, by, value).where("mad > 0")
    return df.join(s, by).withColumn("z", (F.col(value) - F.col("median")) / F.col("mad")).drop("median", "mad")


def zscore(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``z``: population z-score in each group; constant groups go."""
    w = Window.partitionBy(*by)
    out = df.withColumn("_sd", F.stddev_pop(value).over(w)).where("_sd > 0")
    return out.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.col("_sd")).drop("_sd")


def defect_rate(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias("rate"))


def probe_history(main: DataFrame, serial: str | None = None, far: str = "2100-01-01", only_last: bool = False) -> DataFrame:
    """(subject, probe, serial, implanted, explanted): probe columns as rows by explant day; open-ended implants get a far day."""
    rows = None
    for k in (0, 1):
        part = main.select("subject", F.lit(k).alias("probe"), F.col(f"P{k}_serial").alias("serial"), F.col(f"P{k}_implantDate").alias("implanted"), F.col(f"P{k}_explantDate").alias("explanted"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where("serial IS NOT NULL AND serial <> ''").withColumn("explanted", F.when(F.col("explanted").rlike(r"^\d{4}-"), F.col("explanted")).otherwise(far))
    if serial:
        rows = rows.where(F.col("serial") == serial)
    if only_last:
        w = Window.partitionBy("serial").orderBy(F.desc("explanted"), F.desc("implanted"), F.desc("subject"))
        rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows


def ready_report(sessions: DataFrame, by: list[str], day: str, duration: str, now: str, min_duration: float = 600.0, days: int = 7) -> DataFrame:
    """Each key's last session of sufficient length, if within ``days`` of ``now``."""
    w = Window.partitionBy(*by).orderBy(F.desc(day), F.desc(duration))
    last = sessions.where(F.col(duration) > min_duration).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return last.where(F.datediff(F.to_date(F.lit(now)), F.to_date(F.col(day))) <= days)


def training_progress(sessions: DataFrame, subject: str, order: list[str], stage: str, level: int) -> DataFrame:
    """(index, share): share of subjects above ``level`` at their n-th session, stages carried forward."""
    w = Window.partitionBy(subject).orderBy(*order)
    rows = sessions.withColumn("index", F.row_number().over(w)).withColumn("_s", F.last(stage, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("index").agg(F.avg((F.coalesce("_s", F.lit(0)) > level).cast("double")).alias("share"))


def match_stability(tracks: DataFrame, unit: str, day: str) -> DataFrame:
    """(gap, matches, share): over pairs of days, the medians of units seen on both and of their share of the earlier day's."""
    a, b = tracks.select(unit, F.col(day).alias("d1")), tracks.select(unit, F.col(day).alias("d2"))
    pairs = a.join(b, unit).where("d1 < d2").groupBy("d1", "d2").agg(F.count("*").alias("n"))
    size = tracks.groupBy(F.col(day).alias("d1")).agg(F.count("*").alias("_n"))
    out = pairs.join(size, "d1").withColumn("gap", F.col("d2") - F.col("d1"))
    return out.groupBy("gap").agg(F.percentile("n", 0.5).alias("matches"), F.percentile(F.col("n") / F.col("_n"), 0.5).alias("share"))


def choice_difference(df: DataFrame, by: list[str], stimulus: str, side: str, value: str) -> DataFrame:
    """(by, difference): mean right less mean left per stimulus, averaged over stimuli with both choices."""
    per = df.groupBy(*by, stimulus).agg((F.avg(F.when(F.col(side) == 2, F.col(value))) - F.avg(F.when(F.col(side) == 1, F.col(value)))).alias("_d"))
    return per.groupBy(*by).agg(F.avg("_d").alias("difference"))


def dominance(trials: DataFrame, by: list[str], aud_left: Column, aud_right: Column, chose_right: Column, rt: str, cut: float = 0.1) -> DataFrame:
    """(by, speed, dominance): P(right) on conflicts with sound right less on those with sound left, for fast and slow trials."""
    speed = F.when(F.col(rt) <= cut, "fast").otherwise("slow")
    right = chose_right.cast("double")
    return trials.groupBy(*by, speed.alias("speed")).agg((F.avg(F.when(aud_right, right)) - F.avg(F.when(aud_left, right))).alias("dominance"))


def rt_by_condition(trials: DataFrame, by: list[str], rt: str, min_n: int) -> DataFrame:
    """(by, median, mean, n) for conditions with more than ``min_n`` trials."""
    return trials.groupBy(*by).agg(F.percentile(rt, 0.5).alias("median"), F.avg(rt).alias("mean"), F.count(rt).alias("n")).where(F.col("n") > min_n)


def relative_rt(trials: DataFrame, by: list[str], kind: str, rt: str) -> DataFrame:
    """(by, kind, difference, ratio): a kind's median time against the pooled median."""
    pooled = trials.groupBy(*by).agg(F.percentile(rt, 0.5).alias("_p"))
    per = trials.groupBy(*by, kind).agg(F.percentile(rt, 0.5).alias("_m"))
    return per.join(pooled, by).select(*by, kind, (F.col("_m") - F.col("_p")).alias("difference"), F.try_divide("_m", "_p").alias("ratio"))


def baseline_accuracy(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, accuracy): share of the most common label."""
    return df.groupBy(*by, label).agg(F.count("*").alias("_n")).groupBy(*by).agg((F.max("_n") / F.sum("_n")).alias("accuracy"))


def binned_calibration(df: DataFrame, logodds: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, p, n): mean sigmoid per equal-width bin of the log-odds, 0 and bins + 1 outside."""
    b = F.width_bucket(F.col(logodds), F.lit(low), F.lit(high), F.lit(bins))
    return df.groupBy(b.alias("bin")).agg(F.avg(1 / (1 + F.exp(-F.col(logodds)))).alias("p"), F.count("*").alias("n"))


def region_per_depth(units: DataFrame, unit: str, depth: str, region: str, edges: list[float]) -> DataFrame:
    """(bin, region): the first unit's region in each depth bin, '0' where there is none."""
    step = edges[1] - edges[0]
    bins = units.sparkSession.range(len(edges) - 1).select(F.col("id").cast("long").alias("bin"))
    inside = units.where((F.col(depth) >= edges[0]) & (F.col(depth) < edges[-1])).withColumn("bin", F.floor((F.col(depth) - edges[0]) / step))
    return bins.join(inside.groupBy("bin").agg(F.min_by(region, unit).alias("region")), "bin", "left").withColumn("region", F.coalesce("region", F.lit("0")))


def block_mean(signal: DataFrame, by: list[str], index: str, value: str, k: int) -> DataFrame:
    """(by, block, mean): means of k samples in a row."""
    return signal.groupBy(*by, F.floor(F.col(index) / k).alias("block")).agg(F.avg(value).alias("mean"))


def binned_mean(df: DataFrame, by: list[str], day: str, value: str, edges: list[float]) -> DataFrame:
    """(by, bin, mean) per open interval between edges."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        b = F.when((F.col(day) > edges[k]) & (F.col(day) < edges[k + 1]), k).otherwise(b)
    return df.withColumn("bin", b).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.avg(value).alias("mean"))


def date_extent(df: DataFrame, by: list[str], day: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def region_fractions(units: DataFrame, region: str, score: str, threshold: float, min_units: int, requested: list[str]) -> DataFrame:
    """(region, n, share): units over ``threshold`` in regions of more than ``min_units``; requested regions without data have 0."""
    per = units.groupBy(region).agg(F.count("*").alias("n"), F.avg((F.col(score) > threshold).cast("double")).alias("share")).where(F.col("n") > min_units)
    names = units.sparkSession.createDataFrame([(r,) for r in requested], f"{region} string")
    return names.join(per, region, "left").select(region, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def subject_counts(sessions: DataFrame, subject: str, session: str, day: str) -> DataFrame:
    return sessions.groupBy(subject).agg(F.count_distinct(session).alias("n_sessions"), F.count_distinct(day).alias("n_days"))
