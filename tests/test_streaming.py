"""Streams over several batches equal their batch twins."""

import os
import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sources.tables import load
from ledgerloom.streaming.run import drain, shared
from ledgerloom.streaming.state import coalesce_stream, watch_stream

from .conftest import SMALL


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """events in four files, in order of time, read one at a time."""
    folder = tmp_path_factory.mktemp("events")
    e = load(spark, SMALL, "events")
    e.orderBy("ts", "event_id").withColumn("part", F.floor(F.row_number().over(Window.orderBy("ts", "event_id")) / 260)).repartition(1, "part").write.partitionBy("part").parquet(str(folder / "ordered"))
    flat = folder / "flat"
    flat.mkdir()
    for n, f in enumerate(sorted((folder / "ordered").glob("part=*/*.parquet"), key=lambda f: f.parent.name)):
        shutil.copy(f, flat / f"{n}.parquet")
        os.utime(flat / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age
    return lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def test_coalesce_over_batches(spark, batches):
    out = drain(coalesce_stream(batches().select("user_id", "event_id", "ts", "event_type", "value")), "coalesce", "update")
    assert out.select("batch").distinct().count() > 1
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "first_event_id", "last_event_id", "route"), "batch").alias("m")).select("user_id", "m.*").where("n > 0")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in QUERIES["outbox_coalesce"](spark, SMALL).collect()}


def test_watch_over_batches(spark, batches):
    out = drain(watch_stream(batches().select("user_id", "event_id", "ts", "event_type")), "watch").drop("batch")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in QUERIES["watch_actions"](spark, SMALL).collect()}


def test_shared_folder(spark):
    assert shared(spark, "x").startswith(("file:", "/"))
