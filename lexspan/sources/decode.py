"""Bytes to text: byte order marks, UTF-8, then the Chinese code pages."""

from __future__ import annotations

import codecs
import re

LIMIT = 64 << 20
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(data: bytes) -> tuple[str, str | None]:
    """(text, warning) of the first 64 MiB."""
    data = data[:LIMIT]
    for mark, codec in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace"), None
    for codec in ("utf-8", "gb18030", "big5"):
        try:
            return data.decode(codec), None
        except UnicodeDecodeError as e:
            if codec == "utf-8" and len(data) == LIMIT and e.start > len(data) - 4:
                return data[: e.start].decode(codec), None
    return data.decode("utf-8", "replace"), "unknown encoding: some characters were lost"


def clean(text: str) -> str:
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]+\n", "\n", text))
