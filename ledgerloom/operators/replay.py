"""Replay on a clock: a pure function of targets and elapsed seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def progress(target: Column, fraction: Column) -> Column:
    """How much of a target shows at a fraction of its window."""
    return F.least(target, F.floor(fraction * (target + 1)).cast("int"))


def revealed(clock: Column, minute: Column, value: Column) -> Column:
    """A value that shows from its minute on; one without a minute never does."""
    return F.when(clock >= minute, value)


def replay(targets: DataFrame, day: Column, target: Column, elapsed: list[int], window: int) -> DataFrame:
    """targets at each elapsed second: fraction, state, shown value, clock minute."""
    ticks = F.explode(F.array(*[F.lit(x) for x in elapsed])).alias("elapsed")
    df = targets.select("*", ticks)
    f = (F.col("elapsed") - day * window) / F.lit(float(window))
    held = F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))
    state = F.when(f < 0, "scheduled").when(f < 1, "live").otherwise("final")
    return df.withColumn("state", state).withColumn("shown", progress(target, held)).withColumn("clock", F.floor(held * 94).cast("int"))


def transitions(states: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows whose columns differ from the tick before (the first tick counts)."""
    w = Window.partitionBy(*key).orderBy("elapsed")
    prev = F.lag(F.struct(*columns)).over(w)
    return states.withColumn("_p", prev).where(~F.struct(*columns).eqNullSafe(F.col("_p"))).drop("_p")
