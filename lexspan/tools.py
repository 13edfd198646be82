"""The engine's five tools for an assistant: gated, with text reports, and a section on the index's state."""

from __future__ import annotations

import threading

from .engine import Engine
from .operators.gate import wants_sync

LABELS = {"ocr": "OCR", "word": "Word", "metadata": "metadata only", "none": "no text"}
REFUSED = "The knowledge base is used only when asked for by name, by a file's name, or in a session that it is switched on for."
#: Files that a sync handles before the answer at most; with more to do, without an index or anew it runs behind the answer.
BACKGROUND = 5


class Tools:
    """message: the user's own text of this turn, on which the gate decides."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _asked(self, session: str, message: str) -> tuple[bool, bool]:
        row = self.engine.allowed(self.engine.spark.createDataFrame([(session, message)], "session_id string, text string")).first()
        if row["asked"] and not self.engine.session(session):
            self.engine.session(session, True)  # who has asked once needn't ask again
        return bool(row["allowed"]), bool(row["sync"])

    def kb_search(self, session: str, message: str, query: str, limit: int | None = None, dir: str | None = None, ext=None, days: float | None = None) -> str:
        if not self._asked(session, message)[0]:
            return REFUSED
        hits = self.engine.search(query[:600], min(20, limit) if limit else None, dir=dir, ext=list(ext)[:10] if ext and not isinstance(ext, str) else ext, days=days).collect()
        if not hits:
            return "Nothing found."
        out = [f"{len(hits)} hits in {len({h['doc_id'] for h in hits})} files"]
        for h in hits:
            place = f"p. {h['page']}, " if h["page"] is not None else ""
            out.append(f"{h['rank']}. {h['rel']} ({place}{LABELS.get(h['text_source'], 'native text')}, offset {h['char_start']})" + (f"\n   {h['heading']}" if h["heading"] else "") + f"\n   {h['snippet']}")
        return "\n".join(out + self._stale())

    def _stale(self) -> list[str]:
        if not self.engine.settings.staleness_hint:
            return []
        s = self.engine.staleness()
        return [f"The index lacks {s['added']} new, {s['changed']} changed and {s['removed']} removed files."] if any(s.values()) else []

    def kb_read(self, session: str, message: str, doc: str | int, offset: int = 0, limit: int = 12_000) -> str:
        if not self._asked(session, message)[0]:
            return REFUSED
        row = self.engine.read(doc, max(0, offset), max(200, min(40_000, limit))).first()
        return f"{doc} isn't indexed." if row is None else row["message"] or row["text"]

    def kb_list(self, session: str, message: str, dir: str = "", depth: int = 1, filter: str = "") -> str:
        if not self._asked(session, message)[0]:
            return REFUSED
        folders, files = self.engine.list(dir, max(1, min(3, depth)), filter)
        lines = [f"{r['dir']}/ ({r['files']} files)" for r in folders.collect()] + [f"{r['name']} ({r['size']} bytes, {r['status']})" for r in files.collect()]
        return "\n".join(lines) or "This folder is empty."

    def kb_status(self, session: str, message: str, action: str = "status") -> str:
        """action: status, progress, now or rebuild; the last two need a wish to sync in the message."""
        allowed, sync = self._asked(session, message)
        if not allowed:
            return REFUSED
        if action in ("now", "rebuild"):
            if not sync:
                return "The message doesn't ask for a sync."
            pending = sum(self.engine.staleness(now=True).values())
            if action == "rebuild" or pending > BACKGROUND or not self.engine.store.read("docs").limit(1).count():
                self.background = threading.Thread(target=self._sync_behind, args=(action == "rebuild",), daemon=True)
                self.background.start()
                return f"A sync of {pending} changed files has begun; action progress tells how far it is."
            done = self.engine.sync()
            return ", ".join(f"{k}: {v}" for k, v in done.items() if k != "errors")
        return ", ".join(f"{k}: {v}" for k, v in (self.engine.progress if action == "progress" else self.engine.status()).items())

    def _sync_behind(self, full: bool) -> None:
        try:
            self.engine.sync(full)
        except Exception:  # the engine has logged it, and its progress says so
            pass

    def kb_session(self, session: str, action: str = "status") -> str:
        on = self.engine.session(session, {"on": True, "off": False}.get(action))
        return "on" if on else "off"

    def prompt_section(self, session: str) -> str:
        s = self.engine.status()
        return f"Knowledge base: {s['docs']} files, {s['chunks']} chunks; {'on' if self.engine.session(session) else 'only on request'} in this session. " + " ".join(self._stale())

    def wants_sync(self, message: str) -> bool:
        from pyspark.sql import functions as F

        return bool(self.engine.spark.createDataFrame([(message,)], "t string").select(wants_sync(F.col("t")).alias("w")).first()["w"])
