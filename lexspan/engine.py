"""The search engine over a store: sync, search, read, list, status, sessions, and who may ask."""

from __future__ import annotations

import datetime
import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions.snippets import snippets
from .operators import corpus, gate, index, listing, search, sync
from .operators.store import Staged, Store
from .plans.search_plan import build_plan, ext_list
from .sources.extract import Providers, extract
from .sources.folders import any_of, scan


TAG = "lexspan-sync"
#: Paths of each change, and failures, that a log entry names; its summary holds all counts.
LOGGED = 200
HIT = (
    "rank int, doc_id long, rel string, path string, name string, dir string, ext string, kind string, text_source string, status string, mtime timestamp, "
    "ord int, heading string, char_start long, page int, score double, snippet string"
)


class Engine:
    def __init__(self, spark: SparkSession, store: str, settings: Settings, providers: Providers | None = None):
        self.spark, self.store, self.settings, self.providers = spark, Store(spark, store, settings.store_parts), settings, providers or Providers()
        self._lock, self._stale = threading.Lock(), (0.0, None)
        self.progress = {"phase": "idle"}
        self._held: list[DataFrame] = []  # what the running sync has cached
        self._cancelled = False

    # Sync

    def sync(self, full: bool = False, only: list[str] | None = None) -> dict:
        """Brings the index to what is on disk and gives the counts.  One at a time; full: from nothing; only: paths to try again."""
        if not self._lock.acquire(blocking=False):
            return {"running": True, **self.progress}
        started, outcome, changes, failed = time.time(), {}, None, []
        self._cancelled = False
        self.spark.addTag(TAG)
        try:
            self.progress = {"phase": "scan"}
            files, errors = scan(self.spark, self.settings)
            problems = {r["root"]: r["error"] for r in errors.collect()}
            if problems and self.settings.fail_on_missing_root:
                raise FileNotFoundError(str(problems))
            files, old = self._hold(files), self._hold(self.store.empty("docs") if full else self.store.read("docs"))
            changes = sync.diff(files, old, images=self.settings.ocr_embedded_images and self.providers.ocr is not None)
            if only is not None:
                keys = self.spark.createDataFrame([(k,) for k in only], "key string")
                changes = sync.restricted(changes, files, keys)
            changes = self._hold(changes)
            outcome = sync.counters(changes).first().asDict() | {"errors": problems}
            todo = changes.where(F.col("change").isin("added", "updated", "images"))
            self.progress = {"phase": "extract", **outcome}
            failed = self._apply(files, old, todo, changes.where("change = 'removed'"), full, outcome)
            outcome["seconds"] = round(time.time() - started, 3)
            self._log("info", "sync", changes, failed, outcome)
            self.progress = {"phase": "done", **outcome}
            return outcome
        except Exception as e:
            if self._cancelled:
                outcome["cancelled"] = True
                self._log("warn", "sync cancelled", None, [], outcome)
                self.progress = {"phase": "cancelled", **outcome}
                return outcome
            self.progress = {"phase": "error", "error": str(e)[:500]}
            self._log("error", f"sync failed: {e}", None, [], outcome)
            raise
        finally:
            self.spark.removeTag(TAG)
            self._stale = (0.0, None)
            for df in self._held:
                df.unpersist()
            self._held = []
            self._lock.release()

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist())
        return self._held[-1]

    def cancel(self) -> None:
        """Stops a running sync's jobs; all tables stay as they were before it."""
        if self._lock.locked():
            self._cancelled = True
            self.spark.interruptTag(TAG)

    def _apply(self, files: DataFrame, old: DataFrame, todo: DataFrame, removed: DataFrame, full: bool, outcome: dict) -> list:
        """Rewrites the parts of the store that hold documents in todo or removed, or all if full; gives the first failures."""
        if not full and not todo.limit(1).count() and not removed.limit(1).count():
            return []
        wanted = sync.routed(files.join(todo.select("path"), "path", "left_semi"), any_of(self.settings.include), self.settings.max_file_bytes)
        cache = self.store.read("image_ocr")
        known = {r["sha1"]: r["text"] for r in cache.select("sha1", "text").collect()} if self.providers.ocr else {}  # sync.CACHE_ROWS at most
        made = extract(self.spark, wanted, self.settings, self.providers, known)
        # a document keeps its id; new ones follow the largest, in the order of their paths within ranges of paths
        last = old.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        numbers = old.select("path", F.col("doc_id").alias("old_id"))
        fresh = wanted.join(numbers, "path", "left").select("path", "old_id")
        new = self._hold(fresh.where("old_id is null").select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id()))
        sizes = sorted((r["part"], r["count"]) for r in new.groupBy("part").count().collect())  # a row for each partition
        offsets = F.create_map(*[F.lit(x) for i, (part, _) in enumerate(sizes) for x in (part, sum(n for _, n in sizes[:i]))]) if sizes else None
        place = F.row_number().over(Window.partitionBy("part").orderBy("path")) + last
        numbered = fresh.where("old_id is not null").withColumnRenamed("old_id", "doc_id")
        if sizes:
            numbered = new.select("path", (place + offsets[F.col("part")]).cast("long").alias("doc_id")).union(numbered)
        rows = self._hold(wanted.join(made, "path").join(numbered, "path"))
        gone = todo.select("path").union(removed.select("path"))
        docs = rows.select("doc_id", "path", "root", "rel", "dir", "name", "ext", "size", "mtime", "kind", "text_source", "status", "error", F.length("text").cast("long").alias("chars"), "media_ocr", F.current_timestamp().alias("indexed_at"))
        chunks = rows.select("doc_id", F.explode("chunks").alias("c")).select((F.col("doc_id") * corpus.CHUNKS + F.col("c.ord")).alias("chunk_id"), "doc_id", "c.ord", "c.heading", "c.page", "c.text")
        stale_ids = self._hold(old.join(gone, "path", "left_semi").select("doc_id"))
        parts = None
        if not full:
            both = stale_ids.union(rows.select("doc_id"))
            parts = {r["part"] for r in both.select(self.store.part().alias("part")).distinct().collect()}  # at most the store's parts

        def kept(name: str) -> DataFrame:
            return self.store.empty(name) if full else sync.delete(self.store.read(name, parts), stale_ids, "doc_id")

        post = index.postings(chunks.join(rows.select("doc_id", "rel", "name"), "doc_id")).drop("part")
        index.write(self.store, kept("docs").unionByName(docs), kept("chunks").unionByName(chunks), kept("postings").unionByName(post), parts, self._pictures(cache, rows))
        bad = rows.where("status = 'error'").select("rel", "error")
        outcome["failed"] = bad.count()
        return bad.orderBy("rel").limit(LOGGED).collect()

    def _pictures(self, cache: DataFrame, rows: DataFrame) -> tuple[Staged, ...]:
        """The cache with the pictures that were read in this sync, staged; none if none were."""
        read = rows.select(F.explode("images").alias("i")).select("i.sha1", "i.text", "i.bytes", F.current_timestamp().alias("at"))
        read = read.where(F.length("text") <= sync.CACHE_TEXT)  # a longer text is read again
        return (self.store.stage("image_ocr", sync.cache_put(cache, read)),) if read.limit(1).count() else ()

    def _log(self, level: str, message: str, changes: DataFrame | None, failed: list, outcome: dict) -> None:
        """A log entry, and the summary and time of the last sync, which outlive the log's length."""
        log = self.store.read("sync_log")
        last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        summary = {k: v for k, v in outcome.items() if k != "errors"}
        details = {"summary": summary, "failed": [{"rel": r["rel"], "error": (r["error"] or "")[:200]} for r in failed]}
        if changes is not None:
            by = {k: [r["path"] for r in changes.where(F.col("change") == k).orderBy("path").limit(LOGGED).collect()] for k in ("added", "updated", "removed")}
            details |= {"added": [{"rel": p, "note": ""} for p in by["added"]], "updated": [{"rel": p, "note": ""} for p in by["updated"]], "removed": by["removed"]}
        text = json.dumps(details, ensure_ascii=False)
        while len(text) > sync.DETAILS:  # the longest list gives way, as a cut text could not be read again
            longest = max((k for k in details if k != "summary"), key=lambda k: len(details[k]))
            if not details[longest]:
                break
            details[longest] = details[longest][: len(details[longest]) // 2]
            text = json.dumps(details, ensure_ascii=False)
        now = datetime.datetime.now(datetime.timezone.utc)
        entry = self.spark.createDataFrame([(last + 1, now, level, message, text)], log.schema)
        meta = self.store.read("meta")
        news = self.spark.createDataFrame([("last_sync_at", now.isoformat()), ("last_sync", json.dumps({"level": level, **summary}))], meta.schema)
        self.store.swap([self.store.stage("sync_log", sync.append_log(log, entry)), self.store.stage("meta", sync.upsert(meta, news, "k"))])

    def last_sync(self) -> dict:
        """When the last sync ended and what it counted."""
        known = {r["k"]: r["v"] for r in self.store.read("meta").collect()}  # two rows
        return {"at": known["last_sync_at"], **json.loads(known["last_sync"])} if "last_sync" in known else {}

    def log(self, limit: int = 50) -> DataFrame:
        return self.store.read("sync_log").orderBy(F.desc("id")).limit(max(1, min(200, limit)))

    def staleness(self, now: bool = False) -> dict:
        """How far disk and index differ, looked up once in a while, or now."""
        at, known = self._stale
        if now or known is None or time.time() - at > self.settings.stale_seconds:
            files, _ = scan(self.spark, self.settings)
            known = sync.stale(files, self.store.read("docs")).first().asDict()
            self._stale = (time.time(), known)
        return known

    # Queries

    def search(self, text: str, limit: int | None = None, per_doc: int | None = None, dir: str | None = None, ext=None, days: float | None = None, as_of: str | None = None) -> DataFrame:
        """The best hits (30 at most) with snippet and char_start, the place of the chunk in the document's text."""
        plan = build_plan(text[:600])
        if not plan:
            return self.spark.createDataFrame([], HIT)
        filters = search.Filters(dir, tuple(ext_list(ext)), days, as_of)
        found = search.search(self.store.read("chunks"), plan, limit or self.settings.top_k, per_doc or self.settings.max_chunks_per_doc, filters, index.Index.of(self.store))
        hits = self._small(found.withColumn("part", self.store.part()))
        ids, parts = (sorted({r[c] for r in hits.collect()}) for c in ("doc_id", "part"))
        some = self.store.read("chunks", set(parts)).where(F.col("doc_id").isin(*ids)) if ids else self.store.empty("chunks")
        starts = corpus.char_starts(some).select("chunk_id", "char_start")
        shown = hits.join(starts, "chunk_id").withColumn("snippet", snippets([*plan.phrases, *plan.terms])("text"))
        return shown.select(*[c.split()[0] for c in HIT.split(", ")]).orderBy("rank")

    def _small(self, df: DataFrame) -> DataFrame:
        """A table of a few rows, computed now."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def read(self, key: str | int, offset: int = 0, limit: int = 12_000) -> DataFrame:
        doc = listing.find_document(self.store.read("docs"), key)
        chunks = self.store.read("chunks").join(F.broadcast(doc.select("doc_id")), "doc_id", "left_semi")
        return listing.readable(doc, listing.read_text(chunks), offset, limit)

    def list(self, dir: str = "", depth: int = 1, needle: str = "") -> tuple[DataFrame, DataFrame]:
        """(folders, files)."""
        docs = self.store.read("docs")
        return listing.list_dirs(docs, dir, depth), listing.list_files(docs, dir, needle)

    def status(self) -> dict:
        docs = self.store.read("docs")
        out = listing.totals(docs).first().asDict() | {"chunks": self.store.read("chunks").count()}
        for column in ("status", "ext", "text_source"):
            out[f"by_{column}"] = {r[column]: r["n"] for r in listing.count_by(docs, column).collect()}
        if self.settings.staleness_hint:
            out["stale"] = self.staleness()
        return out

    # Who may ask

    def session(self, session_id: str, enabled: bool | None = None) -> bool:
        state = self.store.read("session_state")
        if enabled is not None:
            row = self.spark.createDataFrame([(session_id, enabled, datetime.datetime.now(datetime.timezone.utc))], state.schema)
            self.store.write("session_state", sync.upsert(state, row, "session_id"))
            return enabled
        found = state.where(F.col("session_id") == session_id).first()
        return bool(found and found["enabled"])

    def allowed(self, messages: DataFrame) -> DataFrame:
        names = gate.path_names(self.store.read("docs")) if self.settings.path_triggers else self.spark.createDataFrame([], "name string")
        return gate.evaluate(messages, names, self.store.read("session_state"), self.settings.triggers, self.settings.explicit_only)

    def inside_roots(self, path: str) -> bool:
        """Whether an indexed path lies under a root, and so may be shown."""
        row = self.store.read("docs").where(F.col("path") == path).first()
        return bool(row) and ".." not in path.split("/") and row["root"] in self.settings.roots
