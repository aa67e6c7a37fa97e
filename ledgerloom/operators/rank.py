"""Ranks of many rows under few keys: no task holds a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cume_dist(df: DataFrame, key: str, value: str, width: float, out: str) -> DataFrame:
    """Share of a key's rows whose value is not above the row's own; null values come first, NaN last, null keys are
    a key of their own. Exact: distinct values are counted first, summed within cells `width` wide, and the cells,
    of which a key has few, are summed among themselves. The counts, not the rows, go through windows."""
    # -0.0 and 0.0 are one value, as in ordering; NaN and the infinities get cells of their own.
    v = F.col(value) + F.lit(0)
    cell = F.when(F.isnan(v.cast("double")), F.lit(float("inf"))).otherwise(F.floor(v / width).cast("double"))
    counts = df.select(F.col(key).alias("_k"), v.alias("_v"), cell.alias("_c")).groupBy("_k", "_v", "_c").agg(F.count("*").alias("_n"))
    cells = counts.groupBy("_k", "_c").agg(F.sum("_n").alias("_m"))
    by = Window.partitionBy("_k")
    before = F.sum("_m").over(by.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    cells = cells.select(F.col("_k").alias("_k2"), F.col("_c").alias("_c2"), before.alias("_b"), F.sum("_m").over(by).alias("_all"))
    within = F.sum("_n").over(Window.partitionBy("_k", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    j = counts.withColumn("_w", within).join(cells, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_c").eqNullSafe(F.col("_c2")))
    share = j.select("_k", "_v", ((F.col("_b") + F.col("_w")) / F.col("_all")).alias(out))
    rows = df.drop(out)
    return rows.join(share, rows[key].eqNullSafe(F.col("_k")) & (rows[value] + F.lit(0)).eqNullSafe(F.col("_v"))).drop("_k", "_v")
