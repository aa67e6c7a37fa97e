"""Column functions over maps and arrays: overlays, ranges, null-safe comparison."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(a: list[Column], b: list[Column]) -> Column:
    """Whether any pair is distinct, nulls being equal to one another."""
    return reduce(or_, [~x.eqNullSafe(y) for x, y in zip(a, b)])


def overlaid(layer: Column, key: str, value: Column) -> Column:
    """The layer's entry where it has the key (even a null one), else the value."""
    return F.when(F.coalesce(F.map_contains_key(layer, F.lit(key)), F.lit(False)), F.try_element_at(layer, F.lit(key))).otherwise(value)


def put(layer: Column, key: Column, value: Column) -> Column:
    return F.map_concat(without(layer, key), F.create_map(key, value))


def without(layer: Column, key: Column) -> Column:
    return F.map_filter(layer, lambda k, v: k != key)


def present(layer: Column) -> Column:
    return F.map_filter(layer, lambda k, v: v.isNotNull())


def bucket(x: Column, ranges: list[tuple[float, float, int]]) -> Column:
    """Half-open ranges, the first that holds x; the topmost end is inclusive. One when-chain, no join."""
    top = max(hi for _, hi, _ in ranges)
    out = F.lit(None).cast("int")
    for lo, hi, score in sorted(ranges, reverse=True):
        inside = (x >= lo) & ((x < hi) | ((x == hi) if hi >= top else F.lit(False)))
        out = F.when(inside, F.lit(score)).otherwise(out)
    return out


def parse_ranges(table: dict[str, float | str]) -> list[tuple[float, float, int]]:
    """{'6.5-7': 7} to sorted ranges, scores as numbers or texts; malformed entries are skipped."""
    out = []
    for key, score in table.items():
        lo, sep, hi = key.partition("-")
        try:
            out.append((float(lo), float(hi), round(float(score))))
        except (TypeError, ValueError):
            continue
    return sorted(out)


def split_goals(total: Column, penalties: Column) -> tuple[Column, Column]:
    """(goals without penalties, penalties held to the total)."""
    p = F.least(F.coalesce(penalties, F.lit(0)), total)
    return total - p, p
