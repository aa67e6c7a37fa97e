"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever comes first. Texts may be long, so that a
#: batch of Spark's default 10,000 rows could outgrow a worker.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches unless the session asks for smaller ones already.

    Spark reads these settings when a plan runs, so they stay set for the session."""
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower()
        number = now.rstrip("kmgb")
        if not 0 < int(number) * units[now[len(number) :]] <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder serves, in local mode only.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jdir.get() if jdir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: computed once, and
    safe from the loss of an executor. The shuffle files that it took are deleted at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_dir(spark)
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:  # a frame of its own, which nothing runs a second time
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path that `scratch` gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that names each row, whatever it holds, and that column's name: a struct of
    the hash of its file's path and its number there. What isn't a plain scan of files is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        path = scratch(docs.sparkSession, "rows")
        docs.write.parquet(path)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    name, meta = free(docs, "_row"), docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("n"))), name


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, a written frame of narrow rows, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo: the folds of the labelled data."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame of given rows, built by SQL functions alone."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def free(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
