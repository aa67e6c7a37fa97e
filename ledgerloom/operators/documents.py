"""Snapshot documents: nested, ordered, null fields kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(order: list[Column], value: Column) -> Column:
    """Aggregate: values in order. Sort keys are stripped after sorting."""
    keys = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), value.alias("v")))), lambda x: x["v"])


def nulls_last(c: Column) -> list[Column]:
    return [c.isNull(), c]


def to_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def write_snapshot(df: DataFrame, path: str) -> None:
    """A versioned snapshot: one JSON line per document."""
    df.select(F.lit(2).alias("schema_version"), F.current_timestamp().alias("generated_at"), "*").write.mode("overwrite").json(path)
