"""Settings: defaults under what a caller or a JSON file gives."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .operators.gate import TRIGGERS

# What is looked at and what is passed over by default.
INCLUDE = tuple("**/*." + e for e in "md markdown txt csv json log docx doc xlsx xls pptx pdf png jpg jpeg bmp tif tiff".split())
EXCLUDE_DIRS = (".git", "node_modules", "$RECYCLE.BIN", "System Volume Information")
EXCLUDE_GLOBS = ("~$*", "*.tmp", "*.crdownload", "*.partial")


@dataclass(frozen=True)
class Settings:
    roots: tuple[str, ...] = ()
    include: tuple[str, ...] = INCLUDE
    exclude_dirs: tuple[str, ...] = EXCLUDE_DIRS
    exclude_globs: tuple[str, ...] = EXCLUDE_GLOBS
    max_file_bytes: int = 256 << 20
    auto_sync: str = "off"
    staleness_hint: bool = True
    path_triggers: bool = True
    triggers: tuple[str, ...] = TRIGGERS
    chunk_chars: int = 900
    chunk_overlap: int = 150
    substring: bool = True
    top_k: int = 8
    max_chunks_per_doc: int = 3
    ocr_width: int = 1600
    max_ocr_pages_per_file: int = 60
    ocr_embedded_images: bool = True
    embedded_image_min_bytes: int = 20 << 10
    max_embedded_images_per_file: int = 40
    legacy_doc: str = "skip"
    explicit_only: bool = True
    page_marks: bool = True
    fail_on_missing_root: bool = False
    stale_seconds: float = 300.0
    store_parts: int = 64
    extra: dict = field(default_factory=dict, compare=False, repr=False)

    def updated(self, patch: dict) -> Settings:
        """With the known keys of patch, each brought to its default's type; numbers must not be negative."""
        known = {f.name: getattr(Settings(), f.name) for f in fields(self) if f.name != "extra"}
        return replace(self, **{k: _as(v, known[k], k) for k, v in patch.items() if k in known and v is not None})

    @classmethod
    def load(cls, path: str | None = None, given: dict | None = None) -> Settings:
        """Defaults, then given, then the file."""
        out = cls().updated(given or {})
        return out.updated(json.loads(Path(path).read_text())) if path and Path(path).exists() else out

    def save(self, path: str) -> None:
        """Written beside the file and put in its place in one step."""
        data = {k: v for k, v in asdict(self).items() if k != "extra"}
        with tempfile.NamedTemporaryFile("w", dir=Path(path).parent, delete=False) as f:
            json.dump(data, f, ensure_ascii=False, indent=1)
        os.replace(f.name, path)


def _as(value, like, name: str):
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)
    if isinstance(like, (int, float)):
        number = type(like)(float(value))
        if number < 0:
            raise ValueError(f"{name} is negative")
        return number
    if isinstance(like, tuple):
        return tuple(str(x) for x in ([value] if isinstance(value, str) else value))
    return str(value)
