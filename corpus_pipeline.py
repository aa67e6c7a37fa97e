"""From raw documents to a training order: five stages, each written and read again.

Quality classifier (rejected documents go), SimHash near-duplicates (the smallest id of
each group stays), benchmark decontamination (documents with a benchmark passage go), PII
(spans are replaced by their kind), mixing to target weights (adds the order).

Rows are told apart by their file and place, so that those without an id or with a repeated
one are judged on their own texts. The rows that a stage finds to go are few as a rule: up to
GONE of them (counted) are broadcast, and no text is moved; more are joined by a shuffle.

Defined results: null texts count as empty (as such one document of all empty ones stays, if
the classifier keeps them); of equal rows one stays; texts of any length pass whole; an empty
table gives an empty one; extra columns pass, whatever their names. Each stage's table is
deleted when the next one is written, the last when the session's folder is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, mixing, pii, quality, simhash
from ledgerloom.llm.common import bounded, cut, discard, free, read, scratch, with_row

#: Rows to leave out (24 bytes each and an entry in a hash table) that may be broadcast.
GONE = 500_000


def without(rows: DataFrame, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """rows but those named in gone."""
    gone = bounded(cut(gone.select(F.col(f"{row}.file").alias("_f"), F.col(f"{row}.n").alias("_n"))), GONE)
    left = rows.join(gone, (F.col(f"{row}.file") == gone["_f"]) & (F.col(f"{row}.n") == gone["_n"]), "left_anti")
    return left.select([F.col(f"`{c}`") for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free(docs, "_score")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.CUT).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays (rows without id come last), then by place."""
    rows, row = with_row(docs)
    order = free(rows, "_order")
    keyed = rows.withColumn(order, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    gone = simhash.group(keyed, id_col=order).where("doc_id <> component_id")
    return without(rows, row, gone.select(F.col("doc_id.row").alias(row)), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = with_row(docs)
    gone = decontam.overlaps(rows, read(spark, sf_dir, "benchmark"), id_col=row).select(row).distinct()
    return without(rows, row, gone, docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("mixing", mixed),
]

#: No SQL: hashes, trees and the redaction can't be expressed there; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
