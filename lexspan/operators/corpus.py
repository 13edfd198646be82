"""Documents and chunks of the search engine, from tables.

`docs` has doc_id, path, rel, dir, name, ext, size, mtime, kind, text_source,
status, chars, text; `chunks` has chunk_id, doc_id, ord, heading, page, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "path", "rel", "dir", "name", "ext", "kind", "text_source", "status", "mtime"]
#: Chunk ids are doc_id * CHUNKS + ord.
CHUNKS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_path_parts(df: DataFrame, rel: Column) -> DataFrame:
    """Adds rel, dir (empty at the root), name and ext (lower case, from the last dot) of a relative path."""
    name = F.element_at(F.split(rel, "/"), -1)
    return (
        df.withColumn("rel", rel)
        .withColumn("dir", F.regexp_extract("rel", r"^(.*)/[^/]*$", 1))
        .withColumn("name", F.element_at(F.split("rel", "/"), -1))
        .withColumn("ext", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    )


def docs(spark: SparkSession, sf_dir: str, deal=lambda d: d) -> DataFrame:
    """The documents table as files: folders by source and language, times from events, states from labels.  deal: how its rows
    are dealt to tasks before the joins, which keep those of a doc_id where they are."""
    d = deal(read(spark, sf_dir, "documents"))
    rel = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("mtime"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    sized = with_path_parts(d, rel).withColumns({"size": F.octet_length("text").cast("long"), "chars": F.length("text").cast("long")})  # before the joins, so that texts are joined only if asked for
    out = sized.join(times, "doc_id", "left").join(labels, "doc_id", "left")
    status = F.when(F.col("toxic").isNull(), "metadata").when(F.col("toxic") == 1, "error").otherwise("indexed")
    return out.select(
        "doc_id", F.concat(F.lit("/"), "rel").alias("path"), "rel", "dir", "name", "ext", F.lit("text").alias("kind"),
        F.when(status == "metadata", "metadata").otherwise("native").alias("text_source"), status.alias("status"), "mtime",
        "size", "chars", "text",
    )


def line_chunks(d: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A chunk for each non-blank line of text; keep: more columns of the document to carry, so that no join is needed."""
    lines = d.select("doc_id", *(keep or []), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    text = F.trim("line")
    return lines.where(text != "").select((F.col("doc_id") * CHUNKS + F.col("ord")).alias("chunk_id"), "doc_id", "ord", F.lit("").alias("heading"), F.lit(None).cast("int").alias("page"), text.alias("text"), *(keep or []))


def char_starts(chunks: DataFrame) -> DataFrame:
    """Adds char_start: the characters of the document's chunks before this one (a window, no self-join)."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("char_start", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)))


# Filters


def clean_dir(prefix: str | None) -> str:
    return (prefix or "").strip().replace("\\", "/").strip("./")


def in_dir(prefix: str) -> Column:
    p = clean_dir(prefix)
    return (F.col("dir") == p) | F.startswith("dir", F.lit(p + "/"))


def filtered(df: DataFrame, dir: str | None = None, ext=None, days: float | None = None, as_of=None) -> DataFrame:
    """Rows under a folder, of some extensions, changed in the days before as_of (a timestamp text; now if None)."""
    from ..plans.search_plan import ext_list

    if dir and dir.strip():
        df = df.where(in_dir(dir))
    if exts := ext_list(ext):
        df = df.where(F.col("ext").isin(*exts))
    if days is not None and 0 < days < float("inf"):
        now = F.to_timestamp(F.lit(as_of)) if as_of is not None else F.current_timestamp()
        df = df.where(F.col("mtime") >= now - F.make_interval(secs=F.lit(float(days) * 86400)))
    return df


def name_filter(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose name or path contains needle, case folded; no character of it is special."""
    n = F.lit(needle.lower())
    return df.where(F.contains(F.lower("name"), n) | F.contains(F.lower("rel"), n))
