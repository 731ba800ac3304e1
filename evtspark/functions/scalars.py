"""Column expressions used across the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_date(c: Column) -> Column:
    """A date from yyyy-mm-dd, yyyy_mm_dd or dd/mm/yyyy, else null."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "_", "-"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))).cast("date")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gaussian(x: Column, centre: float, width: float) -> Column:
    return F.exp(-0.5 * F.pow((x - centre) / width, 2))


def split_gaussian(x: Column, centre: float, left: float, right: float) -> Column:
    return F.when(x < centre, gaussian(x, centre, left)).otherwise(gaussian(x, centre, right))


def gaussian_2d(x: Column, y: Column, cx: float, cy: float, sx: float, sy: float) -> Column:
    return gaussian(x, cx, sx) * gaussian(y, cy, sy)


def cell_degrees(index: Column, centre: float, step: float = 7.5) -> Column:
    """Degrees of a receptive-field grid cell."""
    return (index - centre) * step


def condition_tag(azimuth: Column, power: Column) -> Column:
    return F.format_string("aud_azimuth_%d_dpower_%.2f", azimuth.cast("int"), power.cast("double"))


def diff(a: Column) -> Column:
    """Differences of neighbours of an array."""
    return F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i))


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) + k * ((high - low) / max(n - 1, 1)))


def merge_maps(first: Column, *others: Column) -> Column:
    """One map of all keys; of a key that several have, the last one's value. A null map has no keys."""
    none = F.map_filter(F.coalesce(first, *others), lambda k, v: F.lit(False))

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)

    return reduce(over, [F.coalesce(m, none) for m in (first, *others)])


def load_json(text: Column, schema: str) -> Column:
    """JSON text as ``schema``; text that is none, or of another kind, is null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def dump_json(value: Column) -> Column:
    """A struct, map or array as JSON text, null fields written."""
    return F.to_json(value, {"ignoreNullFields": "false"})
