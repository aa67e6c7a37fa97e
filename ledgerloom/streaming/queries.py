"""Streams run over a table until it is used up; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import replay
from ..plans.registry import SQL, query
from ..plans import delivery
from ..sources.tables import Tables
from .run import drain, stream
from .state import coalesce_stream, watch_stream


@query(SQL["outbox_coalesce"])
def stream_coalesce(t: Tables):
    out = drain(coalesce_stream(stream(t.spark, t.folder, "events").select("user_id", "event_id", "ts", "event_type", "value")), "coalesce", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "first_event_id", "last_event_id", "route"), "batch").alias("m"))
    return last.select("user_id", "m.*").where("n > 0")


@query(SQL["watch_actions"])
def stream_watch(t: Tables):
    return drain(watch_stream(stream(t.spark, t.folder, "events").select("user_id", "event_id", "ts", "event_type")), "watch").drop("batch")


@query(SQL["replay_state"])
def stream_replay(t: Tables):
    """Targets stream in and meet the ticks; day indices come from a small static frame."""
    days = t.events.select(F.to_date("ts").alias("d")).distinct().withColumn("day", F.dense_rank().over(Window.orderBy("d")).cast("long") - 1)
    targets = stream(t.spark, t.folder, "events").withColumn("d", F.to_date("ts")).join(days, "d").select("event_id", "user_id", "day", (F.col("event_id") % 5).cast("int").alias("target"))
    states = replay.replay(targets, F.col("day"), F.col("target"), delivery.TICKS, delivery.WINDOW)
    return drain(states.select("event_id", "user_id", "elapsed", "state", "shown", "clock"), "replay").drop("batch")


@query("SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(t: Tables):
    e = stream(t.spark, t.folder, "events").withWatermark("ts", "1 hour")
    g = e.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    out = drain(g.select("event_type", F.unix_timestamp("window.start").alias("day"), "n"), "daily", "update")
    return out.groupBy("event_type", "day").agg(F.max_by("n", "batch").alias("n"))
