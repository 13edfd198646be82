"""Small helpers shared by the operators: shared folder, tables, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python at once.  Whole texts can be long, so batches are smaller than Spark's default.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables.  The session's batches to Python are made small enough for whole texts, unless they are smaller yet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition at least, where a written table is gathered.
PART_ROWS = 100_000


def cut(df: DataFrame, gather: bool = False) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it back: short lineage,
    one computation, and files that outlive lost executors.  Only where the session names
    no such folder (local tests) is a temporary one set.  gather: what is left of a table is
    often little, and is then read in as few partitions as it fills, so that the next
    shuffles don't write a file for each of many empty ones."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexspan-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    out = df.checkpoint(eager=True)
    return out.coalesce(max(1, -(-out.count() // PART_ROWS))) if gather else out


#: Rows of one key that a task joins at most about, and keys with more rows than that at most.
SPLIT, HOT_KEYS = 64, 100_000


def salted_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows (written already) joined with side, which has one row for each key.  The rows of a key with many are dealt by the column by to
    several tasks, each with a copy of the key's row in side.  The keys so split are broadcast: at most HOT_KEYS, as one has more than a
    HOT_KEYS-th of all rows."""
    most = max(SPLIT, -(-rows.count() // HOT_KEYS))
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def starts(*columns: np.ndarray) -> np.ndarray:
    """The first row of each group of equal rows."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def chunks(batches: Iterator[pa.RecordBatch], group: int, size: int):
    """(table, whole) of about size rows from batches sorted by their first columns, as many as group says, cut between groups.  A group longer
    than size comes in several tables of its own, which aren't whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < size:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(n, bool)
        for i in range(group):
            c = t.column(i).to_numpy()
            same &= c == c[-1]
        to = n - int(same.sum())
        yield (t.slice(0, to), True) if to else (t, False)
        held = t.slice(to).to_batches() if to else []
        n = sum(b.num_rows for b in held)
    if n:
        yield pa.Table.from_batches(held).combine_chunks(), True


def held_out():
    """True for the fifth of documents that no model may learn from; an id of null counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def share(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def release() -> None:
    """Gives a Python worker's free memory back to the system when its task ends; workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
