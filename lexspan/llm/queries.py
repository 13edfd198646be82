"""The queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

import importlib

_MODULES = ("language_id", "word_bpe", "jaccard_join", "substring_dedup", "metric_search", "vector_join", "html_text", "quality", "packing", "unigram")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
