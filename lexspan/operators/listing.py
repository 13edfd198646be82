"""Listings, statistics, lookups and read-back over docs and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import clean_dir, name_filter

FAILED = ("error", "needs_ocr", "needs_conversion")


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def count_by(docs: DataFrame, column: str, chars: bool = False) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")] if chars else [])
    return docs.groupBy(column).agg(*aggs).orderBy(F.desc("n"), column)


def failures(docs: DataFrame, limit: int = 50) -> DataFrame:
    """The documents that failed, the latest first."""
    return docs.where(F.col("status").isin(*FAILED)).orderBy(F.desc("mtime"), "doc_id").limit(limit)


def list_dirs(docs: DataFrame, base: str = "", depth: int = 1) -> DataFrame:
    """dir, files, chars of the folders below base; folders deeper than depth count with their ancestor at that depth."""
    base, depth = clean_dir(base), max(1, min(5, depth))
    prefix = base + "/" if base else ""
    below = docs.where(F.startswith("dir", F.lit(prefix))).groupBy("dir").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))
    rest = F.substr("dir", F.lit(len(prefix) + 1))
    key = F.concat(F.lit(prefix), F.array_join(F.slice(F.split(rest, "/"), 1, depth), "/"))
    return below.where(rest != "").groupBy(key.alias("dir")).agg(F.sum("files").alias("files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).orderBy("dir")


def list_files(docs: DataFrame, base: str = "", needle: str = "") -> DataFrame:
    """The files of one folder itself; a needle filters files only."""
    found = docs.where(F.col("dir") == clean_dir(base))
    return (name_filter(found, needle) if needle else found).orderBy("name")


def find_document(docs: DataFrame, key: str | int) -> DataFrame:
    """The document of an id, or else of a relative path, name or path, in this order; at most one row."""
    if isinstance(key, int) or str(key).isdigit():
        return docs.where(F.col("doc_id") == int(key)).limit(1)
    place = F.when(F.col("rel") == key, 0).when(F.col("name") == key, 1).when(F.col("path") == key, 2)
    return docs.withColumn("_p", place).where(F.col("_p").isNotNull()).orderBy("_p", "doc_id").limit(1).drop("_p")


def read_text(chunks: DataFrame) -> DataFrame:
    """doc_id, text: each document's chunks in order, with headings and pages shown."""
    shown = F.concat(
        F.when(F.col("heading") != "", F.concat(F.lit("【"), "heading", F.lit("】\n"))).otherwise(""),
        F.when(F.col("page").isNotNull(), F.concat(F.lit("【第"), F.col("page").cast("string"), F.lit("页】\n"))).otherwise(""),
        "text",
    )
    parts = F.array_sort(F.collect_list(F.struct("ord", shown.alias("t"))))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))


def readable(docs: DataFrame, texts: DataFrame, offset: int = 0, limit: int = 20_000) -> DataFrame:
    """A page of each document's text; documents without extracted text have none and say why."""
    closed = F.col("status").isin("metadata", "needs_ocr", "needs_conversion")
    out = docs.drop("text").join(texts, "doc_id", "left")
    page = F.substr("text", F.lit(max(0, offset) + 1), F.lit(max(0, limit)))
    return out.select("doc_id", "rel", "status", F.when(closed, "").otherwise(F.coalesce(page, F.lit(""))).alias("text"), F.when(closed, F.concat(F.lit("no text: "), "status")).alias("message"))


def chunk_health(chunks: DataFrame) -> DataFrame:
    """One row on chunk lengths: count, mean, extremes, and how many are under and over the usual marks."""
    n = F.length("text")
    over = [F.count_if(n > m).alias(f"over_{m}") for m in (1200, 1800, 2700, 5000)]
    return chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n < 120).alias("under_120"), *over)


def doc_health(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"), (F.count("*") == 1).alias("single"))
