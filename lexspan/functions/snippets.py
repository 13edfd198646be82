"""Snippets and highlighting: per hit, so never over more than a page of results."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F

SNIPPET = 420
MARKED = 12
MAX_MARKS = 300


def snippet(text: str, needles: list[str], size: int = SNIPPET) -> str:
    """A window of text that starts a third of its size before the earliest needle, with first occurrences in 「」."""
    flat = re.sub(r"\s+", " ", text or "")
    folded = flat.lower()
    places = [p for p in (folded.find(n.lower()) for n in needles if n) if p >= 0]
    start = max(0, min(places) - size // 3) if places else 0
    out = flat[start : start + size]
    if places:
        out = ("…" if start else "") + out + ("…" if start + size < len(flat) else "")
    for n in needles[:MARKED]:
        at = out.lower().find(n.lower()) if len(n) >= 2 else -1
        if at >= 0:
            out = f"{out[:at]}「{out[at : at + len(n)]}」{out[at + len(n) :]}"
    return out


def snippets(needles: list[str], size: int = SNIPPET):
    """A column function: text -> snippet."""

    @F.pandas_udf("string")
    def made(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t, needles, size))

    return made


def highlight(text: str, terms: list[str], most: int = MAX_MARKS) -> str:
    """Escaped text with <mark> around the terms, case as given; the first mark has an id."""
    escaped = html.escape(text or "", quote=True).replace("&#x27;", "'")
    wanted = sorted({html.escape(t, quote=True).replace("&#x27;", "'") for t in terms if t}, key=lambda t: (-len(t), t))
    if not wanted:
        return escaped
    count = 0

    def mark(m: re.Match) -> str:
        nonlocal count
        count += 1
        if count > most:
            return m[0]
        return f'<mark id="first-hit">{m[0]}</mark>' if count == 1 else f"<mark>{m[0]}</mark>"

    return re.sub("|".join(map(re.escape, wanted)), mark, escaped)
