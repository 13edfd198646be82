"""Blocks and chunks of a text.

Cutting a text into chunks is a left fold with look-back (a short rest joins the
chunk before, an overlap is carried on), so it runs in Python, a batch of whole
texts at a time; a document is never split over tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from .columns import HEADINGS

CHUNK_CHARS, OVERLAP = 900, 150
MIN_REST = 40
HEADING_CHARS = 300
CHUNK_TYPE = "array<struct<ord: int, heading: string, page: int, text: string>>"
_ORDINALS = [re.compile(p) for p in HEADINGS]
_PAGE = re.compile(r"^【第\s*(\d+)\s*页】$")
_SENTENCE = re.compile(r"(?<=[。！？!?；;])")


@dataclass
class Block:
    kind: str  # heading, para or page
    text: str = ""
    level: int = 0
    n: int = 0


def heading_level(line: str) -> int:
    line = line.strip()
    if not line or len(line) > 80:
        return 0
    marks = re.match(r"(#{1,6})\s+\S", line)
    if marks:
        return len(marks[1])
    return 2 if any(p.match(line) for p in _ORDINALS) else 0


def text_blocks(text: str | None, pages: bool = True) -> list[Block]:
    """A block for each non-blank line; pages: page marks become page blocks."""
    out = []
    for line in (text or "").splitlines():
        line = line.strip()
        if not line:
            continue
        mark = _PAGE.match(line) if pages else None
        level = 0 if mark else heading_level(line)
        if mark:
            out.append(Block("page", n=int(mark[1])))
        elif level:
            out.append(Block("heading", line.lstrip("#").strip() if line.startswith("#") else line, level))
        else:
            out.append(Block("para", line))
    return out


def blocks_text(blocks: list[Block]) -> str:
    shown = {"page": lambda b: f"【第{b.n}页】", "heading": lambda b: "#" * max(1, b.level) + " " + b.text, "para": lambda b: b.text}
    return "\n".join(shown[b.kind](b) for b in blocks)


@dataclass
class Chunker:
    size: int = CHUNK_CHARS
    overlap: int = OVERLAP
    done: list[dict] = field(default_factory=list)

    def run(self, blocks: list[Block]) -> list[dict]:
        self.done, self.held, self.page, self.held_page = [], "", None, None
        trail: list[str] = []
        self.heading, titles = "", []
        for b in blocks:
            if b.kind == "para":
                self._para(b.text)
                continue
            self._flush(False)
            if b.kind == "page":
                self.page = b.n
                continue
            level = min(6, max(1, b.level))
            trail = (trail + [""] * 6)[: level - 1] + [b.text.strip()]
            self.heading = " / ".join(t for t in trail if t)
            titles.append(b.text.strip())
        self._flush(True)
        if not self.done and any(titles):
            joined = "\n".join(t for t in titles if t)
            self.done.append({"ord": 0, "heading": " / ".join(t for t in titles if t)[:HEADING_CHARS], "page": self.page, "text": joined})
        return self.done

    def _para(self, text: str) -> None:
        if len(text) > 3 * self.size:
            for sentence in _SENTENCE.split(text):
                if self.held and len(self.held) + len(sentence) > self.size:
                    self._flush(False)
                self._hold(sentence, "")
        else:
            self._hold(text, "\n")
            if len(self.held) >= self.size:
                self._flush(False)

    def _hold(self, text: str, joint: str) -> None:
        if not self.held:
            self.held_page = self.page
        self.held += (joint if self.held else "") + text

    def _flush(self, forced: bool) -> None:
        text = self.held.strip()
        self.held = ""
        if not text:
            return
        last = self.done[-1] if self.done else None
        if not forced and last and len(text) < MIN_REST and len(last["text"]) + len(text) + 1 <= 1.5 * self.size:
            last["text"] += "\n" + text
            return
        self.done.append({"ord": len(self.done), "heading": self.heading[:HEADING_CHARS], "page": self.held_page if self.held_page is not None else self.page, "text": text})
        if 0 < self.overlap < len(text):
            self.held, self.held_page = text[-self.overlap :], self.page


def chunk_blocks(blocks: list[Block], size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[dict]:
    return Chunker(size, overlap).run(blocks)


def chunker(size: int = CHUNK_CHARS, overlap: int = OVERLAP):
    """A column function: text -> its chunks."""

    @F.pandas_udf(CHUNK_TYPE)
    def chunks(text: pd.Series) -> pd.Series:
        return pd.Series([chunk_blocks(text_blocks(t), size, overlap) for t in text])

    return chunks


def read_back(chunks: list[dict]) -> str:
    """The text of a document from its chunks, with headings and pages shown."""
    out = []
    for c in sorted(chunks, key=lambda c: c["ord"]):
        head = (f"【{c['heading']}】\n" if c["heading"] else "") + (f"【第{c['page']}页】\n" if c["page"] is not None else "")
        out.append(head + c["text"])
    return "\n\n".join(out)
