"""Watching folders: a stream of new files starts incremental syncs.

A file stream reports new and changed files but not deletions, so it only says
that something happened; the full outer join of the sync stays the truth.  The
trigger's interval collects a burst of changes into one sync.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine

INTERVAL = "3 seconds"
FILES = "path string, modificationTime timestamp, length long, content binary"


def changes(engine: Engine) -> DataFrame:
    """The stream of paths, sizes and times under the roots."""
    out = None
    for root in engine.settings.roots:
        files = engine.spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
        out = files if out is None else out.union(files)
    if out is None:
        raise ValueError("no roots to watch")
    return out


def watch(engine: Engine, checkpoint: str, once: bool = False, interval: str = INTERVAL) -> StreamingQuery:
    """Syncs whenever files have come; once: handles what is there and ends."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            engine.sync()

    writer = changes(engine).writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
