"""Extension surface: views and SQL functions by name, pluggable rating providers, pipelines by job kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import QUERIES

#: What every provider's extractor gives, whatever it reads.
RATING = "match_id long, player_name string, raw_score double, score int, is_mvp boolean"


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Temporary views of the queries, to be used from SQL."""
    names = [n for n in QUERIES if not n.startswith("stream_")] if names is None else names
    for n in names:
        QUERIES[n](spark, folder).createOrReplaceTempView(n)
    return names


def register_functions(spark: SparkSession) -> None:
    """SQL functions in place of stored ones; they are inlined into the plan."""
    for name, args, kind, body in (
        ("backoff_seconds", "n INT", "INT", "CAST(least(5 * pow(2, greatest(n - 1, 0)), 300) AS INT)"),
        ("status_rank", "s STRING", "INT", "CASE s WHEN 'scheduled' THEN 0 WHEN 'live' THEN 1 WHEN 'postponed' THEN 1 WHEN 'final' THEN 2 END"),
        ("short_stay", "entered INT, left_min INT", "BOOLEAN", "coalesce(entered >= 70, false) OR coalesce(left_min < 20, false)"),
        ("progress", "target INT, fraction DOUBLE", "INT", "CAST(least(target, floor(fraction * (target + 1))) AS INT)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


class Providers:
    """Extractors by name, with one output schema and a default for unknown names."""

    def __init__(self, default: str):
        self.default, self.by = default, {}

    def add(self, name: str):
        def put(f: Callable[[DataFrame], DataFrame]):
            self.by[name] = f
            return f

        return put

    def extract(self, name: str | None, pages: DataFrame) -> DataFrame:
        out = self.by.get(name or self.default, self.by[self.default])(pages)
        fields = [x.split() for x in RATING.split(", ")]
        return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(k).alias(c) for c, k in fields])


#: Job kind to the queries that it runs; unknown kinds run as a round.
PIPELINES = {"round": ["merge_forward_status", "replace_children", "prune_stale"], "ratings": ["tiered_link", "mvp_resolution"], "official": ["overlay_build", "change_history"], "squads": ["squad_link", "soft_delete_reconcile"], "watch": ["watch_actions"]}


def run_job(spark: SparkSession, folder: str, kind: str) -> dict[str, DataFrame]:
    return {n: QUERIES[n](spark, folder) for n in PIPELINES.get(kind, PIPELINES["round"])}
