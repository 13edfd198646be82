"""Incremental sync as joins: the difference of disk and index, routing, upserts and retention.

A state's truth is the full outer join of what is on disk with what is indexed.
The store writes to new folders and swaps a manifest after the write, so readers
never see half of a sync.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WITH_IMAGES = (".docx", ".docm", ".pptx", ".xlsx", ".xlsm")
LOG_ROWS, CACHE_ROWS = 500, 5000
#: Characters of a cached picture's text: with the rows, what bounds the cache that a sync sends to its tasks.
CACHE_TEXT = 20_000
MESSAGE, DETAILS = 4000, 20_000


def diff(disk: DataFrame, index: DataFrame, images: bool = False) -> DataFrame:
    """path and change (added, updated, images, unchanged, removed).  disk: path, size, mtime; index: the same, ext and
    media_ocr when images are read."""
    old = index.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), *([F.col("media_ocr"), F.col("ext").alias("old_ext")] if images else []), F.lit(True).alias("known"))
    both = disk.select("path", "size", "mtime", F.lit(True).alias("there")).join(old, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    change = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "removed").when(~same, "updated")
    if images:
        change = change.when(F.col("old_ext").isin(*WITH_IMAGES) & ~F.coalesce("media_ocr", F.lit(False)), "images")
    return both.select("path", change.otherwise("unchanged").alias("change"))


def counters(changes: DataFrame) -> DataFrame:
    """One row: scanned and the number of each change."""
    kinds = ("added", "updated", "images", "unchanged", "removed")
    return changes.agg(F.count_if(F.col("change") != "removed").alias("scanned"), *[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def stale(disk: DataFrame, index: DataFrame) -> DataFrame:
    c = diff(disk, index)
    return c.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "updated").alias("changed"), F.count_if(F.col("change") == "removed").alias("removed"))


def restricted(changes: DataFrame, disk: DataFrame, only: DataFrame) -> DataFrame:
    """A retry: files named by path or relative path are updates, other known files stay; removals hold as ever."""
    wanted = disk.join(only, disk.rel == only.key, "left_semi").union(disk.join(only, disk.path == only.key, "left_semi")).select("path").distinct()
    hit = changes.join(wanted.withColumn("wanted", F.lit(True)), "path", "left")
    new = F.when(F.col("change") == "removed", "removed").when(F.col("wanted") & (F.col("change") == "unchanged"), "updated").when(F.col("wanted"), F.col("change")).otherwise("unchanged")
    return hit.select("path", new.alias("change"))


def routed(files: DataFrame, include: str, max_bytes: int) -> DataFrame:
    """Adds route: metadata for files too large (PDFs and images may be), binary or not included (a regular expression on
    rel); else by kind."""
    large = (F.col("size") > max_bytes) & ~F.col("kind").isin("pdf", "image")
    return files.withColumn("route", F.when(large | (F.col("kind") == "binary") | ~F.col("rel").rlike(include), "metadata").when(F.col("kind").isin("pdf", "image"), "ocr").when(F.col("kind").isin("legacy-doc", "legacy-xls"), "convert").otherwise("extract"))


def metadata_text(kind: str = "kind"):
    """What a file without text is found by: path, name, type and size in KB, 1 at least."""
    kb = F.greatest(F.lit(1), F.round(F.col("size") / 1024)).cast("long").cast("string")
    return F.concat_ws("\n", "rel", "name", F.col(kind), F.concat(kb, F.lit(" KB")))


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def newest(df: DataFrame, order: list, keep: int) -> DataFrame:
    """The first rows in an order: a bounded top-k, without a sort of the whole table."""
    return df.orderBy(*order).limit(keep)


def append_log(log: DataFrame, entries: DataFrame, keep: int = LOG_ROWS) -> DataFrame:
    """entries (id, ts, level, message, details) behind log, cut to length, of which the newest stay."""
    cut = entries.withColumn("message", F.substr("message", F.lit(1), F.lit(MESSAGE))).withColumn("details", F.substr("details", F.lit(1), F.lit(DETAILS)))
    return newest(log.unionByName(cut), [F.desc("id")], keep)


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_put(cache: DataFrame, entries: DataFrame, keep: int = CACHE_ROWS) -> DataFrame:
    """The image cache with entries (sha1, text, bytes, at): a known image keeps its bytes."""
    old = cache.select("sha1", F.col("bytes").alias("b"))
    fresh = latest(entries, "sha1", [F.desc("at")]).join(old, "sha1", "left").withColumn("bytes", F.coalesce("b", "bytes")).drop("b")
    return newest(upsert(cache, fresh, "sha1"), [F.desc("at"), "sha1"], keep)


def cache_lookup(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds state: pending for images the cache lacks, cached for those with text, dropped for those without."""
    known = cache.select("sha1", F.col("text").alias("cached"), F.lit(True).alias("hit"))
    joined = images.join(known, "sha1", "left")
    return joined.withColumn("state", F.when(F.col("hit").isNull(), "pending").when(F.trim("cached") != "", "cached").otherwise("dropped")).drop("hit")


def cache_statistics(cache: DataFrame) -> DataFrame:
    """One row: cached images and the characters of their texts."""
    return cache.agg(F.count("*").alias("images"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"))


def log_details(log: DataFrame, shown: int = 60) -> DataFrame:
    """The files of log entries, in the order added, updated, removed, failed, with each entry's true count; shown of them at most."""
    kind = "struct<added: array<struct<rel: string, note: string>>, updated: array<struct<rel: string, note: string>>, removed: array<string>, failed: array<struct<rel: string, error: string>>>"
    d = log.withColumn("d", F.from_json("details", kind))
    row = lambda g, name, rel, note: F.transform(F.coalesce(F.col(f"d.{name}"), F.array()), lambda x: F.struct(F.lit(g).alias("g"), F.lit(name).alias("change"), rel(x).alias("rel"), note(x).alias("note")))
    none = lambda x: F.lit(None).cast("string")
    parts = F.concat(row(0, "added", lambda x: x["rel"], lambda x: x["note"]), row(1, "updated", lambda x: x["rel"], lambda x: x["note"]), row(2, "removed", lambda x: x, none), row(3, "failed", lambda x: x["rel"], lambda x: x["error"]))
    out = d.select("id", F.size(parts).alias("total"), F.posexplode(parts).alias("pos", "f")).where(F.col("pos") < shown)
    return out.select("id", "total", "pos", "f.change", "f.rel", "f.note")


def numbered_images(images: DataFrame) -> DataFrame:
    """Image texts that aren't blank, numbered within their document."""
    w = Window.partitionBy("doc_id").orderBy("entry")
    n = F.row_number().over(w)
    return images.where(F.trim("text") != "").withColumn("label", F.concat(F.lit("【图片"), n.cast("string"), F.lit("】"))).withColumn("n", n)
