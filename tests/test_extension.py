from pyspark.sql import functions as F

from ledgerloom.plans import extension as E
from ledgerloom.streaming.heartbeat import Heartbeat

from .conftest import SMALL


def test_views_and_functions(spark):
    E.register_views(spark, SMALL, ["coverage", "status_counts"])
    assert spark.sql("SELECT sum(n) FROM status_counts").first()[0] == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    E.register_functions(spark)
    row = spark.sql("SELECT backoff_seconds(3), status_rank('final'), short_stay(75, NULL), short_stay(NULL, NULL), progress(2, 0.34D)").first()
    assert tuple(row) == (20, 2, True, False, 1)


def test_providers(spark):
    p = E.Providers("plain")

    @p.add("plain")
    def plain(pages):
        return pages.select(F.col("id").alias("match_id"), F.col("name").alias("player_name"), F.lit(7).alias("score"))

    @p.add("raw")
    def raw(pages):
        return pages.select(F.col("id").alias("match_id"), F.lit(7.55).alias("raw_score"))

    pages = spark.createDataFrame([(1, "Ana")], "id long, name string")
    assert tuple(p.extract("unknown", pages).first()) == (1, "Ana", None, 7, None)
    assert tuple(p.extract("raw", pages).first()) == (1, None, 7.55, None, None)


def test_jobs(spark):
    assert set(E.run_job(spark, SMALL, "squads")) == {"squad_link", "soft_delete_reconcile"}
    assert set(E.run_job(spark, SMALL, "no such kind")) == set(E.PIPELINES["round"])


def test_heartbeat(spark, tmp_path):
    h = Heartbeat(str(tmp_path / "beat.json"))
    spark.streams.addListener(h)
    try:
        q = spark.readStream.format("rate").load().writeStream.format("noop").trigger(processingTime="100 milliseconds").start()
        for _ in range(50):
            q.awaitTermination(0.2)
            if any(v["state"] == "running" for v in h.seen.values()):
                break
        key = str(q.id)
        assert h.dead(h.seen[key]["at"] + 200) == [key] and h.dead(h.seen[key]["at"]) == []
        q.stop()
    finally:
        spark.streams.removeListener(h)
