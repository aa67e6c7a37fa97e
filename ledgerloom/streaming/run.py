"""Running a stream over what is there, into a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, in local mode only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of files; zone-less timestamps become UTC instants."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).format("parquet").load(path + "*")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)})


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream until its input is used up; what it wrote, with the batch of each row.

    The sink is idempotent: a batch that runs again replaces its own folder."""
    spark = df.sparkSession
    out = shared(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/rows")
