"""Comparison of sources, and change history between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """A row for each key and stat, null values included."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("int").alias("value")) for s in stats])
    return df.select(*keys, F.inline(pairs))


def changes(before: DataFrame, after: DataFrame, keys: list[str], stats: list[str], absent: dict[str, int | None] | None = None, quiet: bool = False) -> DataFrame:
    """keys, stat, old_value, new_value for each value that changed.

    absent: what a missing row counts as, by stat (else null). quiet: null and zero are the same."""
    parts = []
    for df, name in ((before, "o"), (after, "n")):
        parts.append(df.select(*keys, *[F.col(s).cast("int").alias(f"{name}_{s}") for s in stats], F.lit(True).alias(f"_{name}")))
    j = parts[0].join(parts[1], keys, "full")
    value = lambda name, s: F.when(F.col(f"_{name}").isNull(), F.lit((absent or {}).get(s)).cast("int")).otherwise(F.col(f"{name}_{s}"))
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), value("o", s).alias("old_value"), value("n", s).alias("new_value")) for s in stats])
    # The structs are filtered before they are exploded: unchanged values never become rows.
    same = lambda x: x["old_value"].eqNullSafe(x["new_value"])
    if quiet:
        same = lambda x: F.coalesce(x["old_value"], F.lit(0)) == F.coalesce(x["new_value"], F.lit(0))
    return j.select(*keys, F.inline(F.filter(rows, lambda x: ~same(x))))


def source_diff(a: DataFrame, b: DataFrame, keys: list[str], counts: list[str], minutes: list[str]) -> DataFrame:
    """Both sources side by side: counts default to zero, minutes stay null and compare null-safely."""
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in counts + minutes], F.lit(True).alias("_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in counts + minutes])
    j = x.join(y, keys, "full")
    out = [F.coalesce(F.col(f"{p}_{c}"), F.lit(0)).alias(f"{p}_{c}") for c in counts for p in "ab"] + [F.col(f"{p}_{c}") for c in minutes for p in "ab"]
    late = F.lit(False)
    for c in minutes:
        late = late | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    j = j.select(*keys, *out, F.col("_a").isNull().alias("a_missing"))
    apart = F.lit(False)
    for c in counts:
        apart = apart | (F.col(f"a_{c}") != F.col(f"b_{c}"))
    return j.withColumn("minutes_differ", late).withColumn("differs", apart | late)


def explode_diff(diff: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"a_{s}").cast("int").alias("a_value"), F.col(f"b_{s}").cast("int").alias("b_value")) for s in stats])
    return diff.where("differs").select(*keys, F.inline(F.filter(rows, lambda x: ~x["a_value"].eqNullSafe(x["b_value"]))))
