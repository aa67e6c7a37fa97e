"""Scans of the fact and dimension tables, and the frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, with zone-less timestamps read as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


class Tables:
    """Tables by attribute: Tables(spark, folder).orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load(self.spark, self.folder, name)


def scan(df: DataFrame, where: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """A filtered scan. where: column -> value (equal), or (operator, value) with
    eq, neq, in, not_in, is_null, gte, lte, lt, gt, like, ilike, wild (equal or null)."""
    ops = {
        "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v),
        "is_null": lambda c, v: c.isNull() if v else c.isNotNull(), "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v,
        "gt": lambda c, v: c > v, "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v), "wild": lambda c, v: (c == v) | c.isNull(),
    }
    for column, test in (where or {}).items():
        op, value = test if isinstance(test, tuple) else ("eq", test)
        df = df.where(ops[op](F.col(column), value))
    return df.select(*columns) if columns else df


def page(df: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(size * number).limit(size)


def source_a(t: Tables) -> DataFrame:
    """What the first source says per (order, supplier): g lines, y returned ones, e first low line."""
    return _source(t.lineitem.where("l_linenumber <> 7"), 0.04)


def source_b(t: Tables) -> DataFrame:
    return _source(t.lineitem.where("l_linenumber <> 1"), 0.05)


def _source(lines: DataFrame, tax: float) -> DataFrame:
    return lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.count("*").cast("int").alias("g"),
        F.sum((F.col("l_returnflag") == "R").cast("int")).cast("int").alias("y"),
        F.min(F.when(F.col("l_tax") >= tax, F.col("l_linenumber"))).alias("e"),
    )
