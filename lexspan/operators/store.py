"""Tables whose versions one manifest names.

Tables of documents (docs, chunks, postings, index_stats) are dealt by doc_id to
a fixed number of parts, so that a sync rewrites only the parts of documents that
changed.  A write goes to a new folder; a new manifest then names, for every
table and part, the folder that holds it.  So several tables change in one step:
readers see all of them before it or after it, and a sync that dies between two
writes leaves nothing but a folder that no manifest names.  Folders that are no
longer named stay for a while, as lazy results may still read them.

One process syncs a store at a time; others may read it.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import threading
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a new store.  A sync rewrites a part for a document in it, so large stores want more.
PARTS = 64
#: Tasks that the rows of one part are dealt to at most, when it is written.
SPREAD = 8
#: Bytes of text whose chunks and postings a task sorts and writes about, where documents are dealt at once.
TASK_BYTES = 16 << 20
#: Of dealt tables.
CODEC = "zstd"
#: Seconds for which replaced folders stay.
GRACE = 3600.0

CHUNK = "doc_id long, ord int, heading string, page int, text string"
SCHEMAS = {
    "docs": "doc_id long, path string, root string, rel string, dir string, name string, ext string, size long, mtime timestamp, kind string, text_source string, status string, error string, chars long, media_ocr boolean, indexed_at timestamp",
    "chunks": "chunk_id long, " + CHUNK,
    "postings": "term string, chunk_id long, doc_id long, weight double, fields int, dl int",
    "index_stats": "chunks long, terms long",
    "sync_log": "id long, ts timestamp, level string, message string, details string",
    "image_ocr": "sha1 string, text string, bytes long, at timestamp",
    "session_state": "session_id string, enabled boolean, updated_at timestamp",
    "meta": "k string, v string",
}
#: Of the tables dealt to parts: what deals a part's rows to tasks, and their order in a file.
DEALT = {"docs": ("doc_id", ["doc_id"]), "chunks": ("doc_id", ["chunk_id"]), "postings": ("term", ["term", "chunk_id"]), "index_stats": ("chunks", [])}

_SWAP = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors reach: spark.checkpoint.dir, or a temporary one of a local session without it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lexspan-")


@dataclass(frozen=True)
class Staged:
    """A table's new files, which no manifest names yet: the folder of each part ("" for tables that aren't dealt)."""

    name: str
    folders: dict[str, str]


class Store:
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, grace: float = GRACE):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace
        known = self.manifest()
        self.parts = known.get("parts", parts)
        self.deal = known.get("deal", "xxhash64" if known["number"] else "hash")  # older stores were dealt by xxhash64

    def _at(self, *names: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    # Manifests

    def _manifests(self) -> list[tuple[int, float]]:
        """Number and time of each manifest."""
        fs, p = self._at("manifest")
        if not fs.exists(p):
            return []
        return sorted((int(s.getPath().getName()[:-5]), s.getModificationTime() / 1000) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _load(self, number: int) -> dict:
        fs, p = self._at("manifest", f"{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest whole one."""
        for number, _ in reversed(self._manifests()):
            try:
                return self._load(number)
            except ValueError:  # its writer died
                continue
        return {"number": 0, "tables": {}}

    def _publish(self, manifest: dict) -> bool:
        fs, p = self._at("manifest", f"{manifest['number']:012d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.write(json.dumps(manifest).encode())
        out.close()
        return True

    # Tables

    def part(self) -> Column:
        """The part of a row's document."""
        return F.pmod(F.hash("doc_id") if self.deal == "hash" else F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")

    def dealt(self, docs: DataFrame, text_bytes: int) -> DataFrame:
        """Documents, dealt by doc_id so that a task has about TASK_BYTES of their text and, if part() goes by the hash that
        deals them, documents of one part only.  What is made of them row by row can be staged without another shuffle."""
        return docs.repartition(self.parts * max(1, -(-text_bytes // (self.parts * TASK_BYTES))), "doc_id")

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], StructType.fromDDL(SCHEMAS[name]))

    def _files(self, name: str, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{name}/{folder}" + (f"/part={k}" if k else "") for k, folder in folders.items()]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.empty(name)

    def read(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """A table, or some parts of it."""
        folders = self.manifest()["tables"].get(name, {})
        return self._files(name, {k: f for k, f in folders.items() if parts is None or not k or int(k) in parts})

    def staged(self, s: Staged) -> DataFrame:
        return self._files(s.name, s.folders)

    def stage(self, name: str, df: DataFrame, dealt: bool = False) -> Staged:
        """Writes rows to a new folder; swap makes them the table's.  index_stats has the column part, others doc_id.  dealt:
        each task has rows of few parts already, as those of dealt documents."""
        folder = uuid.uuid4().hex
        columns = StructType.fromDDL(SCHEMAS[name]).names
        to = f"{self.path}/{name}/{folder}"
        if name not in DEALT:
            df.select(*columns).write.parquet(to)
            return Staged(name, {"": folder})
        key, order = DEALT[name]
        rows = (df if "part" in df.columns else df.withColumn("part", self.part())).select(*columns, "part")
        if dealt:  # a file for each part is open, so that no sort by part is needed, which would come before the order
            with self._open_files():
                rows.sortWithinPartitions(*order).write.partitionBy("part").parquet(to, compression=CODEC)
        else:
            rows = rows.repartition("part", F.pmod(F.hash(key), F.lit(SPREAD))).sortWithinPartitions("part", *order)
            rows.write.partitionBy("part").parquet(to, compression=CODEC)
        fs, p = self._at(name, folder)
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return Staged(name, {n[5:]: folder for n in found if n.startswith("part=")})

    @contextlib.contextmanager
    def _open_files(self):
        """Meanwhile a task may write as many files at once as there are parts."""
        key = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(self.parts))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def swap(self, staged: list[Staged], parts: set[int] | None = None) -> None:
        """Makes staged rows the tables' in one step: the rows of these parts (None: all) give way to them."""
        with _SWAP:
            while True:
                now = self.manifest()
                tables = dict(now["tables"])
                for s in staged:
                    kept = {} if parts is None or s.name not in DEALT else {k: f for k, f in tables.get(s.name, {}).items() if int(k) not in parts}
                    tables[s.name] = kept | s.folders
                number = max([now["number"], *[n for n, _ in self._manifests()]]) + 1
                if self._publish({"number": number, "parts": self.parts, "deal": self.deal, "tables": tables}):
                    break
            self._sweep()

    def write(self, name: str, df: DataFrame) -> None:
        self.swap([self.stage(name, df)])

    def delete_on_exit(self) -> None:
        """The store goes when the driver ends."""
        fs, p = self._at()
        fs.deleteOnExit(p)

    def clear(self, *names: str) -> None:
        self.swap([Staged(n, {}) for n in names])

    def _sweep(self) -> None:
        """Deletes what manifests replaced long ago named and their successors don't; each is unlike any later folder."""
        have = self._manifests()
        for (number, _), (later, at) in zip(have, have[1:]):
            if time.time() - at < self.grace:
                return
            try:
                old, new = ({(t, k, f) for t, by in self._load(n)["tables"].items() for k, f in by.items()} for n in (number, later))
            except ValueError:
                continue
            used = {(t, f) for t, _, f in new}
            for names in {(t, f) if (t, f) not in used else (t, f, f"part={k}") for t, k, f in old - new}:
                fs, p = self._at(*names)
                fs.delete(p, True)
            fs, p = self._at("manifest", f"{number:012d}.json")
            fs.delete(p, False)
