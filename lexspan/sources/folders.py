"""Folder scans: files of some roots with path, size and time, without their contents."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import kind_of
from ..operators.corpus import with_path_parts


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: **/ any folders, ** anything, * anything but /, ? one character but /."""
    out, i = "", 0
    while i < len(pattern):
        for mark, made in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(mark, i):
                out, i = out + made, i + len(mark)
                break
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def any_of(patterns) -> str:
    """One regular expression for several globs; none match nothing."""
    return "|".join(map(glob_regex, patterns)) or r"(?!)"


def excluded(settings: Settings):
    """Whether a path (rel) is passed over: by its own path or name, by those of a folder above, or by a folder's name
    in any case."""
    rule = any_of(settings.exclude_globs)
    parts = F.split("rel", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    by_glob = F.exists(above, lambda p: p.rlike(rule)) | F.exists(parts, lambda p: p.rlike(rule))
    names = [d.lower() for d in settings.exclude_dirs]
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return by_glob | F.exists(folders, lambda p: F.lower(p).isin(*names) if names else F.lit(False))


def missing_roots(spark: SparkSession, roots) -> dict[str, str]:
    """Why a root can't be scanned, for those that can't."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            out[root] = "does not exist"
        elif not fs.getFileStatus(path).isDirectory():
            out[root] = "is not a folder"
    return out


FILE_SCHEMA = "path string, root string, rel string, dir string, name string, ext string, size long, mtime timestamp, kind string, too_large boolean, included boolean"


def base_path(spark: SparkSession, root: str) -> str:
    """The root as its file system names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getPath().toString().rstrip("/")


def local_path(path: str) -> str | None:
    """The path as the operating system knows it, if its file system is one that is mounted."""
    return re.sub("^file:/+", "/", path) if path.startswith("file:") else None


def mounted_files(spark: SparkSession, base: str, settings: Settings) -> DataFrame:
    """path, modificationTime and length of all regular files under a mounted folder, whatever their names: Spark's own listing passes over names
    that begin with _ or a dot.  Each entry of the folder is walked by a task; links aren't followed, excluded folders not entered."""
    top, skipped = local_path(base), {d.lower() for d in settings.exclude_dirs}
    entries = sorted(e.name for e in os.scandir(top) if not e.is_symlink())

    def walk(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            todo, rows = [os.path.join(top, e) for e in batch.column(0).to_pylist()], []
            while todo:
                path = todo.pop()
                try:
                    s = os.lstat(path)
                    if stat.S_ISREG(s.st_mode):
                        rows.append((base + path[len(top.rstrip("/")) :], s.st_mtime_ns // 1_000_000 * 1000, s.st_size))
                    elif stat.S_ISDIR(s.st_mode) and os.path.basename(path).lower() not in skipped:
                        todo += [e.path for e in os.scandir(path)]
                except OSError:  # gone or closed since it was listed
                    continue
                if len(rows) >= 10_000:
                    yield _file_rows(rows)
                    rows = []
            yield _file_rows(rows)

    n = max(1, min(len(entries), 10_000))
    seeds = spark.createDataFrame([(e,) for e in entries], "entry string").repartition(n)
    return seeds.mapInArrow(walk, "path string, modificationTime timestamp, length long")


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["path", "modificationTime", "length"])


def scan(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(files, errors).  Mounted folders are walked by tasks; elsewhere the binary source lists files in parallel and, as no content is
    selected, reads none (it passes over names that begin with _ or a dot)."""
    bad = missing_roots(spark, settings.roots)
    errors = spark.createDataFrame(list(bad.items()), "root string, error string")
    good = [r for r in settings.roots if r not in bad]
    if not good:
        return spark.createDataFrame([], FILE_SCHEMA), errors
    out = None
    for root in good:
        base = base_path(spark, root)
        if local_path(base):
            found = mounted_files(spark, base, settings)
        else:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
        named = with_path_parts(found, F.substr("path", F.lit(len(base) + 2))).withColumn("root", F.lit(root))
        out = named if out is None else out.unionByName(named)
    files = out.where(~excluded(settings)).select(
        "path", "root", "rel", "dir", "name", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        kind_of(F.col("ext")).alias("kind"), (F.col("length") > settings.max_file_bytes).alias("too_large"), F.col("rel").rlike(any_of(settings.include)).alias("included"),
    )
    return files, errors
