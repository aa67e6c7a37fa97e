"""Keyed merge: one full join, then a rule for each column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (base value, delta value, whether the row is in base, whether it is in delta) -> value
Rule = Callable[[Column, Column, Column, Column], Column]


def take_delta(b: Column, d: Column, in_b: Column, in_d: Column) -> Column:
    return F.when(in_d, d).otherwise(b)


def keep_base(b: Column, d: Column, in_b: Column, in_d: Column) -> Column:
    return F.when(in_b, b).otherwise(d)


def never_null(b: Column, d: Column, in_b: Column, in_d: Column) -> Column:
    return F.coalesce(d, b)


def forward_only(ranks: dict[str, int], explicit: Column | None = None) -> Rule:
    """A lower rank doesn't replace a higher one, but where `explicit` holds."""

    def rule(b: Column, d: Column, in_b: Column, in_d: Column) -> Column:
        rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
        back = F.coalesce(F.try_element_at(rank, b) > F.try_element_at(rank, d), F.lit(False))
        held = back & ~F.coalesce(explicit, F.lit(False)) if explicit is not None else back
        return F.when(~in_d | d.isNull() | held, b).otherwise(d)

    return rule


def merge(base: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, default: Rule = take_delta) -> DataFrame:
    """The new version of base. Columns that delta lacks stay; columns that only delta has
    are null for rows it doesn't touch. Rules may refer to delta's other columns as d.name."""
    b, d = base.withColumn("_b", F.lit(True)).alias("b"), delta.withColumn("_d", F.lit(True)).alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    in_b, in_d = F.coalesce(F.col("b._b"), F.lit(False)), F.coalesce(F.col("d._d"), F.lit(False))
    out = [F.coalesce(f"d.{k}", f"b.{k}").alias(k) for k in keys]
    for c in [*base.columns, *[c for c in delta.columns if c not in base.columns]]:
        if c in keys:
            continue
        if c not in delta.columns:
            out.append(F.col(f"b.{c}").alias(c))
        elif c not in base.columns:
            out.append(F.col(f"d.{c}").alias(c))
        else:
            out.append((rules or {}).get(c, default)(F.col(f"b.{c}"), F.col(f"d.{c}"), in_b, in_d).alias(c))
    return b.join(d, on, "full").select(*out)


def restricted(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A merge that touches the given columns only, and never nulls them out."""
    return merge(base, delta.select(*keys, *columns), keys, default=never_null)


def patch(base: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... WHERE: a projection."""
    return base.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: rows that other has get its values; changed tells whether any differed."""
    o = other.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = base.join(o, keys, "left")
    hit = F.col("_hit").isNotNull()
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = [F.when(hit, F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return j.select(*out, (hit & changed).alias("changed"))


def replace_children(base: DataFrame, delta: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of the parents that delta has are replaced by delta's."""
    return base.join(delta.select(*parent).distinct(), parent, "left_anti").unionByName(delta)


def prune(base: DataFrame, fresh: DataFrame, group: list[str], member: str, least: int, stale: Column) -> DataFrame:
    """Drops base rows (where `stale` holds) that fresh lacks, in groups of which fresh has `least` distinct members."""
    whole = fresh.groupBy(*group).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") >= least).select(*group)
    gone = base.where(stale).join(whole, group, "left_semi").join(fresh.select(*group, member).distinct(), [*group, member], "left_anti")
    return base.join(gone.select(*group, member).distinct(), [*group, member], "left_anti")


def reconcile(base: DataFrame, seen: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """Soft delete: active rows within a scope that seen covers, but whose key it lacks, become
    inactive. Without anything seen in a scope, nothing there changes."""
    s = seen.select(*scope).distinct().withColumn("_scope", F.lit(True))
    k = seen.select(*scope, *key).distinct().withColumn("_seen", F.lit(True))
    j = base.join(s, scope, "left").join(k, [*scope, *key], "left")
    gone = F.col("active") & F.col("_scope").isNotNull() & F.col("_seen").isNull()
    return j.select(*[c for c in base.columns if c != "active"], (F.col("active") & ~gone).alias("active"), gone.alias("left_now"))


def upsert_checked(delta: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Splits a delta into rows to save and rejects with a reason, before one write."""
    from ..sources.pages import split_rejects

    return split_rejects(delta, checks)
