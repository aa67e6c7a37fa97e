"""Precedence of layers: manual over official over crawled, column by column.

The layers are kept apart and the columns computed when read, so that a value falls back
by itself when a layer no longer forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layers import overlaid, split_goals

#: Entered this late, or left this early: under 20 minutes played.
LATE, EARLY = 70, 20


def has(layer: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(layer, F.lit(key)), F.lit(False))


def effective(df: DataFrame, crawled: str, official: str, manual: str) -> DataFrame:
    """goals, penalties, assists, yellows, entered, left_min and short of each row, from its layers (maps).

    An official goal total is split by the crawled penalties; `short` is derived anew only
    where a minute is official."""
    c, o, m = F.col(crawled), F.col(official), F.col(manual)
    get = lambda layer, k: F.try_element_at(layer, F.lit(k))
    goals, pens = split_goals(get(o, "goals"), get(c, "penalties"))
    forced = has(o, "goals")
    entered, left = overlaid(o, "entered", get(c, "entered")), overlaid(o, "left", get(c, "left"))
    short = F.coalesce(entered >= LATE, F.lit(False)) | F.coalesce(left < EARLY, F.lit(False))
    return df.select(
        *df.columns,
        overlaid(m, "goals", F.when(forced, goals).otherwise(get(c, "goals"))).alias("goals"),
        F.when(forced, pens).otherwise(get(c, "penalties")).alias("penalties"),
        overlaid(m, "assists", get(c, "assists")).alias("assists"),
        overlaid(m, "yellows", overlaid(o, "yellows", get(c, "yellows"))).alias("yellows"),
        entered.alias("entered"),
        left.alias("left_min"),
        F.when(has(o, "entered") | has(o, "left"), short).otherwise(F.coalesce(get(c, "short") == 1, F.lit(False))).alias("short"),
    )


def build_official(rows: DataFrame, official: DataFrame, key: list[str], team: str, eligible: Column, stats: list[str]) -> DataFrame:
    """The official layer of each row: empty unless eligible; the mapped stats (nulls left out);
    empty where the mapping is ambiguous or an unmapped official row of the team could be it; else zeros.

    official: key (null last part: unmapped), team, stats."""
    match, player = key
    mapped = official.where(F.col(player).isNotNull()).groupBy(match, player).agg(F.count("*").alias("_n"), *[F.min(s).alias(f"_o_{s}") for s in stats])
    loose = official.where(F.col(player).isNull()).select(F.col(match).alias("_m"), F.col(team).alias("_t")).distinct().withColumn("_loose", F.lit(True))
    any_ = official.select(F.col(match).alias("_am")).distinct().withColumn("_any", F.lit(True))
    j = rows.join(mapped, key, "left").join(any_, F.col(match) == F.col("_am"), "left")
    j = j.join(loose, F.col(match).eqNullSafe(F.col("_m")) & F.col(team).eqNullSafe(F.col("_t")), "left")
    empty = F.create_map().cast("map<string,int>")
    own = F.map_filter(F.create_map(*[x for s in stats for x in (F.lit(s), F.col(f"_o_{s}").cast("int"))]), lambda k, v: v.isNotNull())
    zeros = F.create_map(*[x for s in stats for x in (F.lit(s), F.lit(0))])
    layer = F.when(~F.coalesce(eligible, F.lit(False)) | F.col("_any").isNull() | (F.col("_n") > 1), empty).when(F.col("_n") == 1, own).when(F.col("_loose").isNotNull(), empty).otherwise(zeros)
    return j.select(*rows.columns, layer.alias("layer"))
