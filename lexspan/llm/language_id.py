"""Language identification with bit-sliced Bloom filters.

One table of slots holds, for each slot, a bitmask of languages.  A language's
character n-grams set its bit in the `HASHES` slots of each n-gram; and-ing the
slots of an n-gram returns, in one probe, every language that contains it.  A
language contains the n-grams of its sample, however rare, but for those that are
over `FOREIGN` times as frequent in another language: labels aren't always right,
and such n-grams come from other languages' texts among its own.  A text's n-grams give one count per language, from which the
hits that chance alone would give (the language's false-positive rate, known
from its share of set slots) are taken out; the largest corrected count wins.

Defined results: a null text, or one without a letter, is `und` with score 0.
Equal counts go to the language with more learnt documents, then by name.  With
no labelled documents everything is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import held_out, release, share, table
from ._text import mix

GRAM = 4
HASHES = 2
#: Times that an n-gram is more frequent in another language from which on it isn't counted as a language's own.
FOREIGN = 20
#: Slots for each n-gram of the language that has most, at least; and slots at least.
SLOTS_PER_GRAM, SLOTS = 16, 1 << 17
#: Labelled documents that a language is learnt from, at most (in expectation); the fit is a bounded sample by hash of id.
SAMPLE_PER_LANGUAGE = 1500
BLOCK = 1 << 18
SCHEMA = "lang_pred string, score double"
UND = "und"


def _grams(text: str):
    """Hashes of the n-grams of a text, block by block.  Case is folded; all that isn't a letter is one space between words."""
    for at in range(0, len(text), BLOCK):
        block = text[max(0, at - GRAM) : at + BLOCK].lower()
        code = np.frombuffer(f" {block} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(_is_letter(code), code, np.uint32(32))
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep].astype(np.uint64)
        if len(code) < GRAM:
            code = np.concatenate((code, np.full(GRAM - len(code), 32, dtype=np.uint64)))
        acc = np.zeros(len(code) - GRAM + 1, dtype=np.uint64)
        for j in range(GRAM):
            acc = (acc << np.uint64(16)) ^ code[j : len(code) - GRAM + 1 + j]
        yield mix(acc)


_LETTERS = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x3000)], dtype=bool)


def _is_letter(code: np.ndarray) -> np.ndarray:
    low = code < len(_LETTERS)
    return np.where(low, _LETTERS[np.where(low, code, 0)], True)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text.isascii() else not text.upper() == text.lower()


def _slot(h: np.ndarray, i: int, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32 * i)) & np.uint64(slots - 1)).astype(np.intp)


@dataclass
class Model:
    """slots: one row of mask bytes for each slot; rate: false positives of each language."""

    languages: list[str]
    slots: np.ndarray
    rate: np.ndarray

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        width = self.slots.shape[1]
        seen, total = np.zeros((width, 256), dtype=np.int64), 0
        for h in _grams(text):
            found = self.slots[_slot(h, 0, len(self.slots))]
            for i in range(1, HASHES):
                found = found & self.slots[_slot(h, i, len(self.slots))]
            for j in range(width):
                seen[j] += np.bincount(found[:, j], minlength=256)
            total += len(h)
        return (seen @ _BITS).reshape(-1)[: len(self.languages)], total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UND, 0.0
        hits, total = self.counts(text)
        true = np.clip((hits - total * self.rate) / np.maximum(1 - self.rate, 1e-9), 0, None)
        best = int(np.argmax(true))  # languages are held in order of their size, so ties go to the larger
        return self.languages[best], float(min(1.0, true[best] / total))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fit(examples: list[tuple[str, str]]) -> Model:
    """examples: (language, text)."""
    by: dict[str, list[str]] = {}
    for lang, text in examples:
        by.setdefault(lang, []).append(text)
    langs = sorted(by, key=lambda x: (-len(by[x]), x))
    counted = []
    for lang in langs:
        grams, n = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for at in range(0, len(by[lang]), 200):  # the counts of some texts at a time
            part = np.concatenate([h for t in by[lang][at : at + 200] for h in _grams(t)] or [grams[:0]])
            keys, inv = np.unique(np.concatenate((grams, part)), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate((n, np.ones(len(part)))), minlength=len(keys)).astype(np.int64)
            grams = keys
        counted.append((grams, n / max(1, n.sum())))
    every = np.unique(np.concatenate([g for g, _ in counted] or [np.empty(0, dtype=np.uint64)]))
    most = np.zeros(len(every))
    for grams, often in counted:
        at = np.searchsorted(every, grams)
        most[at] = np.maximum(most[at], often)
    own = [grams[often * FOREIGN >= most[np.searchsorted(every, grams)]] for grams, often in counted]
    size = max(SLOTS, 1 << (SLOTS_PER_GRAM * max(map(len, own), default=0)).bit_length())
    slots = np.zeros((size, max(1, -(-len(langs) // 8))), dtype=np.uint8)
    rate = np.zeros(len(langs))
    for i, grams in enumerate(own):
        bit = np.uint8(1 << (i % 8))
        for j in range(HASHES):
            slots[_slot(grams, j, size), i // 8] |= bit
        rate[i] = (np.count_nonzero(slots[:, i // 8] & bit) / size) ** HASHES
    return Model(langs, slots, rate)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the labelled documents of docs that aren't held out: of each language about per_language
    documents, those of the lowest hash of id, so the driver receives a bounded sample whatever the input."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return fit([])
    share_of = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    u = (F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / float(1 << 24)).cast("double")
    rows = labelled.where((u < share_of[F.col("lang")]) & F.col("text").isNotNull()).orderBy("doc_id").collect()
    return fit([(r["lang"], r["text"]) for r in rows])


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct<lang_pred, score>."""
    held = share(spark, model)

    @F.pandas_udf(SCHEMA)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            yield pd.DataFrame([held.value.predict(t) for t in text], columns=["lang_pred", "score"])
        release()

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, read from text alone."""
    made = predictor(docs.sparkSession, model)(F.col("text"))
    return docs.select("doc_id", "text").withColumn("_p", made).select("doc_id", "_p.lang_pred", "_p.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    made = predictor(spark, model)(F.col("text"))
    return docs.select("doc_id", "text").withColumn("_p", made).select("doc_id", held_out().alias("held_out"), "_p.lang_pred", "_p.score")


QUERIES = {"op1_language_id": op1_language_id}
