"""Semi-structured sources: pages and JSON columns to typed rows, rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, f'{name}="([^"]*)"', 1), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1), F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, label: the anchors in document order; the first of a page's equal hrefs counts."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), 1).alias("href"),
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), 2).alias("label"),
    )
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a")).select("page_id", "pos", "a.href", "a.label")
    return rows.groupBy("page_id", "href").agg(F.min(F.struct("pos", "label")).alias("m")).select("page_id", F.col("m.pos").alias("pos"), "href", F.col("m.label").alias("label"))


def sections(pages: DataFrame, marker: str, most: int) -> DataFrame:
    """page_id, section (from 0), body: what follows each marker, the first `most` of them.

    What stands before the first marker is no section."""
    parts = F.slice(F.split("html", marker), 2, most)
    return pages.select("page_id", F.posexplode(parts).alias("section", "body"))


def embedded_json(html: Column, tag: str, schema: str) -> Column:
    """The JSON inside <script id="tag">, or null."""
    body = F.regexp_extract(html, f'(?s)<script id="{tag}"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def split_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with reason): the first check that holds names the reason."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()])
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
