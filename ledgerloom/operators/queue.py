"""Outbox and job queue: pure transitions on frames, with an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff

# Priorities of job kinds, attempts before a delivery is given up.
PRIORITY = {"watch": 10, "match": 50, "round": 50, "dates": 55, "ratings": 60, "squads": 70, "official": 80, "backfill": 90}
#: Routing: pairs of a task, tasks at most (then with more pairs each), subscribers of a task, subscribers of a block.
CELL, CELLS, SHARE, BLOCK = 1 << 24, 10_000, 1 << 16, 4096
MAX_ATTEMPTS = 8


def coalesce_events(events: DataFrame, key: str, order: list[str], delivered: Column, routing: str) -> DataFrame:
    """One pending row for each key with events since its last delivery: how many, the first,
    the last, and the last routing value that isn't null."""
    at = F.struct(*order)
    last = events.where(delivered).groupBy(key).agg(F.max(at).alias("_d"))
    e = events.where(~delivered).join(last, key, "left").where(F.col("_d").isNull() | (at > F.col("_d")))
    first, final = F.min(at).alias("a"), F.max(at).alias("z")
    g = e.groupBy(key).agg(F.count("*").alias("n"), first, final, F.max_by(routing, F.when(F.col(routing).isNotNull(), at)).alias(routing))
    return g.select(key, "n", *[F.col(f"a.{c}").alias(f"first_{c}") for c in order], *[F.col(f"z.{c}").alias(f"last_{c}") for c in order], routing)


def claim(df: DataFrame, due: Column, order: list, n: int) -> DataFrame:
    return df.where(due).orderBy(*order).limit(n).withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("sending"))


def delivered(df: DataFrame, has_payload: Column, listeners: Column, failures: Column, as_of: Column) -> DataFrame:
    """After a delivery: done without payload, listeners or failures; else retried later, or given up."""
    ok = ~has_payload | (listeners == 0) | (failures == 0)
    status = F.when(ok, "delivered").when(F.col("attempts") >= MAX_ATTEMPTS, "failed").otherwise("pending")
    later = as_of + F.make_interval(secs=backoff(F.col("attempts")).cast("decimal(18,6)"))
    return df.withColumn("status", status).withColumn("next_attempt_at", F.when(status == "pending", later))


def _grid(rows: DataFrame, subscribers: DataFrame, keys: list[str], pairs: int, n: int, m: int) -> DataFrame:
    """rows (n of them) joined to subscribers (m, the other columns of which stand in `_x`) on the keys, or all with all. The
    pairs are dealt to a grid of cells of about CELL: each takes a share of the rows and one of the subscribers, these in
    blocks of a key, so that a row meets an array at a time."""
    cells = min(CELLS, pairs // CELL + 1)
    across = min(max(m, 1), max(-(-m // SHARE), round((cells * m / max(n, 1)) ** 0.5), 1))
    down = -(-cells // across)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    on = ["_u", "_v", *keys]
    l = rows.withColumn("_u", (F.monotonically_increasing_id() % down).cast("int")).withColumn("_v", every(across))
    s = subscribers.withColumn("_i", F.monotonically_increasing_id())
    s = s.groupBy(*keys, (F.col("_i") % across).cast("int").alias("_v"), F.floor(F.col("_i") / (across * BLOCK)).alias("_c")).agg(F.collect_list("_x").alias("_x"))
    r = s.drop("_c").withColumn("_u", every(down))
    return l.repartition(down * across, *on).join(r.repartition(down * across, *on).hint("merge"), on)


def route(rows: DataFrame, subscribers: DataFrame, row_key: str, sub_key: str) -> DataFrame:
    """Active subscribers whose key is the row's, or null (all rows): an equality join, and the wildcards, each of
    which takes every row. The pairs of both are counted by key and dealt evenly; no side is broadcast."""
    s = subscribers.where("active")
    have = lambda df, key, x: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).withColumn("x", F.lit(x))
    k = have(rows, row_key, "r").unionByName(have(s, sub_key, "s")).groupBy("k").agg(*[F.sum(F.when(F.col("x") == x, F.col("n")).otherwise(0)).alias(x) for x in "rs"])
    some, total = F.col("k").isNotNull(), lambda x, c: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    m = k.agg(*[total(x, c).alias(n) for n, x, c in (("pairs", F.col("r") * F.col("s"), some), ("rows", F.col("r"), F.lit(True)), ("keyed", F.col("s"), some), ("wild", F.col("s"), ~some))]).first()
    x = F.struct(*([c for c in s.columns if c not in (sub_key, "active")] or [sub_key])).alias("_x")
    out = lambda j, key: j.select(*rows.columns, *(["_k"] if "_k" in j.columns else []), F.inline("_x")).select(*rows.columns, *[key.alias(c) if c == sub_key else F.lit(True).alias(c) if c == "active" else F.col(c) for c in s.columns])
    keyed, wild = s.where(F.col(sub_key).isNotNull()).select(F.col(sub_key).alias("_k"), x), s.where(F.col(sub_key).isNull()).select(x)
    exact = _grid(rows.where(F.col(row_key).isNotNull()).withColumn("_k", F.col(row_key)), keyed, ["_k"], m.pairs, m.rows, m.keyed)
    every = _grid(rows, wild, [], m.rows * m.wild, m.rows, m.wild)
    return out(exact, F.col("_k")).unionByName(out(every, F.lit(None).cast(s.schema[sub_key].dataType)))


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """dedupe_key, id of the live job with that key (null: to be inserted); one row for each key."""
    live = jobs.where(F.col("status").isin("pending", "running")).groupBy("dedupe_key").agg(F.min("id").alias("existing_id"))
    return wanted.select("dedupe_key").distinct().join(live, "dedupe_key", "left")


def reclaim(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Running jobs whose lease ended: back to pending, or failed after the last attempt."""
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") < as_of)
    status = F.when(lost & (F.col("attempts") >= F.col("max_attempts")), "error").when(lost, "pending").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "lease_expires_at": F.when(~F.coalesce(lost, F.lit(False)), F.col("lease_expires_at"))})


def finish(jobs: DataFrame, failed: Column) -> DataFrame:
    status = F.when(~failed, "done").when(F.col("attempts") >= F.col("max_attempts"), "error").otherwise("pending")
    return jobs.withColumn("status", F.when(F.col("status") == "running", status).otherwise(F.col("status")))


def wake(jobs: DataFrame, last_wake: Column, as_of: Column, spacing: int = 55) -> DataFrame:
    g = jobs.agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if((F.col("status") == "running") & (F.col("lease_expires_at") >= as_of) & (F.col("kind") != "watch")).alias("draining"),
    )
    return g.withColumn("wake", (F.col("pending") > 0) & (F.col("draining") == 0) & (F.unix_timestamp(as_of) - F.unix_timestamp(last_wake) >= spacing))


def requeue(outbox: DataFrame, chosen: Column, key: str) -> DataFrame:
    """The chosen row is pending again, or delivered if its key has another pending row."""
    pending = F.count_if(F.col("status") == "pending").over(Window.partitionBy(key))
    other = pending - (F.col("status") == "pending").cast("int") > 0
    return outbox.withColumn("status", F.when(chosen & other, "delivered").when(chosen, "pending").otherwise(F.col("status")))
