"""File contents to chunks, where the files are read; contents never leave their task.

Pictures, PDFs and old Office files need engines that Spark doesn't bring.  A
provider is a Python callable, registered by kind; without one a file keeps a
state that says what it needs, and is still found by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.chunking import Block, blocks_text, chunk_blocks, text_blocks
from ..operators.sync import metadata_text
from . import office
from .decode import clean, decode
from .folders import base_path, local_path, missing_roots

#: A provider takes (kind, bytes) and gives text, or None if it finds none.
Provider = Callable[[str, bytes], "str | None"]


@dataclass
class Providers:
    ocr: Provider | None = None
    legacy: Provider | None = None
    by_kind: dict[str, Provider] = field(default_factory=dict)

    def of(self, kind: str) -> Provider | None:
        if kind in self.by_kind:
            return self.by_kind[kind]
        return self.ocr if kind in ("pdf", "image") else self.legacy if kind.startswith("legacy-") else None


OUT = "path string, status string, text_source string, text string, error string, media_ocr boolean, chunks array<struct<ord: int, heading: string, page: int, text: string>>, images array<struct<sha1: string, text: string, bytes: long>>"
_CHUNKS = pa.list_(pa.struct([("ord", pa.int32()), ("heading", pa.string()), ("page", pa.int32()), ("text", pa.string())]))
_IMAGES = pa.list_(pa.struct([("sha1", pa.string()), ("text", pa.string()), ("bytes", pa.int64())]))
#: Of a Word file without text, which is often scanned pages: pictures of any size up to this, and how many.
SCAN_BYTES, SCAN_IMAGES = 8 << 20, 12


def extract_file(kind: str, data: bytes | str, settings: Settings, providers: Providers, cache: dict[str, str], fresh: list[dict]) -> tuple[str, str, list[Block], str | None, bool]:
    """(status, text source, blocks, error, whether its pictures were read).  data: the contents, or the path of a mounted file;
    cache: texts of known pictures by their sha1; what it lacked is added to it and to fresh."""
    try:
        if isinstance(data, str):
            data = Path(local_path(data)).read_bytes()
        if kind == "text":
            text, warning = decode(data)
            return "indexed", "native", text_blocks(clean(text), settings.page_marks), warning, False
        if kind in office.EXTRACTORS:
            blocks, read = office.EXTRACTORS[kind](data), False
            bare = kind == "docx" and not any(b.text.strip() for b in blocks if b.kind != "page")
            wanted = ((0, SCAN_BYTES, SCAN_IMAGES) if bare else (settings.embedded_image_min_bytes, 12 << 20, settings.max_embedded_images_per_file)) if bare or settings.ocr_embedded_images else None
            pictures = office.embedded_images(data, *wanted) if wanted else []
            if wanted and providers.ocr:
                shown = 0
                for _, sha1, size, raw in pictures:
                    if sha1 not in cache:
                        cache[sha1] = providers.ocr("image", raw) or ""
                        fresh.append({"sha1": sha1, "text": cache[sha1], "bytes": size})
                    if cache[sha1].strip():
                        shown += 1
                        blocks += [Block("para", f"【图片{shown}】"), *text_blocks(cache[sha1], settings.page_marks)]
                read = True
            if bare and pictures:
                return ("indexed", "ocr", blocks, None, read) if blocks else ("needs_ocr", "none", [], None, read)
            return "indexed", "native", blocks, None, read
        provider = providers.of(kind)
        if provider:
            text = provider(kind, data)
            if text and text.strip():
                return "indexed", "word" if kind.startswith("legacy-") else "ocr", text_blocks(text, settings.page_marks), None, False
        return ("needs_conversion" if kind.startswith("legacy-") else "needs_ocr"), "none", [], None, False
    except Exception as e:  # one bad file is a row with its error, not a failed job
        return "error", "none", [], f"{type(e).__name__}: {e}"[:500], True  # its pictures aren't looked for again


def extract(spark: SparkSession, files: DataFrame, settings: Settings, providers: Providers | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """path, status, text_source, text, error, media_ocr, chunks, and images read anew, of files (of scan(), with route).  known: texts
    of pictures by their sha1, of a cache bounded in rows and in the length of a text."""
    providers = providers or Providers()
    plain = files.where("route = 'metadata'").select("path", F.lit("metadata").alias("status"), F.lit("metadata").alias("text_source"), metadata_text().alias("text"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("media_ocr"), "dir")
    chunk = F.struct(F.lit(0).alias("ord"), F.col("dir").alias("heading"), F.lit(None).cast("int").alias("page"), F.col("text").alias("text"))
    plain = plain.withColumn("chunks", F.array(chunk)).withColumn("images", F.lit(None).cast("array<struct<sha1: string, text: string, bytes: long>>")).drop("dir")
    sent = spark.sparkContext.broadcast(known or {})
    wanted = files.where("route <> 'metadata'").select("path", "kind", "dir", metadata_text().alias("fallback"), "size")
    todo = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = int(max(1, min(100_000, todo["n"] // 50 + todo["bytes"] // (64 << 20) + 1)))
    # files of mounted folders are read where they are extracted, one at a time; others come from the binary source
    read = wanted.where(F.startswith("path", F.lit("file:"))).repartition(tasks, "path").withColumn("content", F.lit(None).cast("binary")).drop("size")
    gone = missing_roots(spark, settings.roots)
    for root in (r for r in settings.roots if r not in gone):
        if local_path(base_path(spark, root)) is None:
            part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
            part = part.join(F.broadcast(wanted) if todo["n"] <= 200_000 else wanted, "path")
            read = read.unionByName(part.select("path", "kind", "dir", "fallback", "content"))

    def run(batches: Iterator[pa.RecordBatch]):
        cache = dict(sent.value)
        for batch in batches:
            rows = []
            for path, kind, folder, fallback, data in zip(*(c.to_pylist() for c in batch.columns)):
                fresh: list[dict] = []
                status, source, blocks, error, media = extract_file(kind, path if data is None else data, settings, providers, cache, fresh)
                chunks = chunk_blocks(blocks, settings.chunk_chars, settings.chunk_overlap) or [{"ord": 0, "heading": folder, "page": None, "text": fallback}]
                rows.append((path, status, source, blocks_text(blocks), error, media, chunks, fresh))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), _CHUNKS, _IMAGES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["path", "status", "text_source", "text", "error", "media_ocr", "chunks", "images"])

    return plain.unionByName(read.mapInArrow(run, OUT))
