"""Byte-pair encoding by rank-synchronous array merging.

A batch of pre-tokens is one ragged numpy array of symbols with row offsets.  In
each round every pre-token finds its own lowest-rank pair and applies all
occurrences of it, left to right, at once with all other pre-tokens; rows
without a mergeable pair leave.  The symbols that survive are the tokens.

The vocabulary is a tokenizers file of BPE with an end-of-word suffix, whose
normaliser is NFC, white space to one space, lower case, and whose pre-tokens
are contractions, letters, single digits and other signs.  White space separates
pre-tokens and neither NFC nor lower-casing works across it, so a text is the
sequence of its white-space-separated pieces; each distinct piece is encoded
once for a bounded cache.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import release, table

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces that an encoder remembers, and characters and bytes of ids that they take, before it forgets all.
CACHE, CACHE_SIZE = 400_000, 32 << 20
SLOTS = 1 << 18
BATCH_CHARS = 1 << 20
#: White space as Unicode defines it; Python's own also has U+001C to U+001F.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(f"[{_WHITE}]+")
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_ODD = regex.compile("[\x1c-\x1f]")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + n))
        n += b not in plain
    return out


class RankedMerges:
    """Encodes batches of pre-tokens (UTF-8 bytes) to token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, suffix = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        self._index(keys)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.size = len(merges)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank, with the slots after the home slot probed in turn."""
        self.slot_key, self.slot_rank = np.full(SLOTS, -1, dtype=np.int64), np.full(SLOTS, len(keys), dtype=np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = (self._home(keys[left]) + self.probes) & (SLOTS - 1)
            free = self.slot_key[slot] == -1
            _, first = np.unique(slot, return_index=True)
            lucky = np.zeros(len(left), dtype=bool)
            lucky[first] = True
            lucky &= free
            self.slot_key[slot[lucky]], self.slot_rank[slot[lucky]] = keys[left[lucky]], left[lucky]
            left = left[~lucky]
            self.probes += 1

    @staticmethod
    def _home(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        slot = self._home(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_rank[slot], self.size)
        going = np.flatnonzero((found != key) & (found != -1))
        for probe in range(1, self.probes):
            if not len(going):
                break
            slot_on = (slot[going] + probe) & (SLOTS - 1)
            found = self.slot_key[slot_on]
            hit = found == key[going]
            out[going[hit]] = self.slot_rank[slot_on[hit]]
            going = going[~hit & (found != -1)]
        return out

    def encode(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all pre-tokens (not empty, without line breaks) in order, and how many each has."""
        if not pretokens:
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        data = np.frombuffer(("\n".join(pretokens) + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.flatnonzero(data == 10)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        symbol = symbol[data != 10]
        length = np.diff(ends, prepend=-1) - 1
        row = np.repeat(np.arange(len(pretokens)), length)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        joint = self._starts(symbol, row)  # rank of the pair that starts at each symbol
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            low = np.minimum.reduceat(joint, first)
            count = np.diff(np.append(first, len(symbol)))
            low = np.repeat(low, count)
            going = low < self.size
            if not going.all():  # rows without a pair to merge leave
                ended.append((row[~going], symbol[~going]))
                symbol, row, joint, low = symbol[going], row[going], joint[going], low[going]
                if not len(symbol):
                    break
            hit = np.flatnonzero(joint == low)
            # in a run of overlapping occurrences (aaa) every second one from the left applies
            run = np.concatenate(([True], np.diff(hit) != 1))
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
            symbol[hit] = self.made[joint[hit]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]  # where the merged symbols now are
            symbol, row, joint = symbol[keep], row[keep], joint[keep]
            beside = np.zeros(len(symbol) + 1, dtype=bool)  # only pairs beside a merge have changed
            beside[at] = beside[at - 1] = True
            near = np.flatnonzero(beside[:-1])
            joint[near] = self._starts(symbol, row, near)
        row, symbol = (np.concatenate(x) for x in zip(*ended))
        return symbol[np.argsort(row, kind="stable")].astype("<u4"), np.bincount(row, minlength=len(pretokens))

    def _starts(self, symbol: np.ndarray, row: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(symbol)) if at is None else at
        right = np.minimum(at + 1, len(symbol) - 1)
        inside = (right > at) & (row[right] == row[at])
        out = np.full(len(at), self.size, dtype=np.int64)
        out[inside] = self._ranks(symbol[at[inside]], symbol[right[inside]])
        return out


def normalise(piece: str) -> str:
    piece = unicodedata.normalize("NFC", piece)
    return piece.replace("Σ", "σ").lower()  # a sigma is lower-cased without looking at its place


class Encoder:
    """Texts to token ids or counts, with each distinct piece encoded once.  Memory: CACHE pieces of CACHE_SIZE in all, then the cache starts anew."""

    def __init__(self, path: str | None = None):
        path = path or model_path()
        self.merges = RankedMerges(path)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(_byte_chars())}
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.marks = regex.compile("|".join(map(regex.escape, self.merges.specials)) or "(?!)")

    def _pieces(self, text: str) -> list[str]:
        """The white-space-separated pieces; special strings are pieces of their own."""
        if "<|" in text:
            found = list(self.marks.finditer(text))
            if found:
                out, at = [], 0
                for m in found:
                    out += [*self._pieces_plain(text[at : m.start()]), m[0]]
                    at = m.end()
                return out + self._pieces_plain(text[at:])
        return self._pieces_plain(text)

    def _pieces_plain(self, text: str) -> list[str]:
        if _latin(text):  # here every character is its own lower case or one other character, and none composes
            text = text.lower()
        return [x for x in _SPLIT.split(text) if x] if _ODD.search(text) else text.split()

    def _pretokens(self, piece: str) -> list[str]:
        if piece.isascii():
            piece = piece.lower()
        elif max(piece) < "\u0370":
            piece = normalise(piece)
        else:
            return self._late_pretokens(piece)
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return _PRETOKEN.findall(piece)

    def _late_pretokens(self, piece: str) -> list[str]:
        # Beyond the older scripts the library's own version of Unicode decides what a letter is.
        spans = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in spans]

    def _learn(self, fresh: list[str]) -> None:
        """Fills the cache.  A piece of letters alone is one pre-token."""
        plain, other = [], []
        for piece in fresh:
            (plain if piece.isalpha() and piece.islower() and _latin(piece) else other).append(piece)
        ids, counts = self.merges.encode(plain)
        self._keep(plain, ids, np.cumsum(counts))
        tokens: list[str] = []
        many = []
        for piece in other:
            found = () if piece in self.merges.specials else self._pretokens(piece)
            many.append(len(found))
            tokens += found
        ids, counts = self.merges.encode(tokens)
        self._keep(other, ids, np.concatenate(([0], np.cumsum(counts)))[np.cumsum(many, dtype=np.int64)])
        for piece in set(other) & self.merges.specials.keys():
            self.cache[piece] = np.array([self.merges.specials[piece]], dtype="<u4").tobytes()

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        flat, ends = ids.tobytes(), (ends * 4).tolist()
        self.held += len(flat) + sum(map(len, pieces))
        self.cache.update(zip(pieces, [flat[a:b] for a, b in zip([0, *ends], ends)]))

    def encode_batch(self, texts: list[str | None]):
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < BATCH_CHARS:
                size += len(texts[to] or "")
                to += 1
            pieces = [self._pieces(t or "") for t in texts[at:to]]
            at = to
            if not self.cache or len(self.cache) > CACHE or self.held > CACHE_SIZE:
                self.cache, self.held = {}, 0
            fresh = list(set().union(*pieces).difference(self.cache))
            if fresh:
                self._learn(fresh)
            for ps in pieces:
                yield b"".join(map(self.cache.__getitem__, ps))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = MODEL) -> Encoder:
    """One encoder a Python worker; its file is read where the task runs."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(model_path(name))
    return _ENCODERS[name]


def forget(name: str = MODEL) -> None:
    """Drops what the worker's encoder has learnt, at the end of a task."""
    encoder(name).cache = {}
    release()


def counter(name: str = MODEL):
    """A column function: text -> tokens of the whole text."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series([len(x) // 4 for x in encoder(name).encode_batch(text.tolist())], dtype="int64")
        forget(name)

    return n_tokens


def count_tokens(docs: DataFrame, limit: int = LIMIT, name: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; a null or empty text has 0 of both."""
    text = F.coalesce("text", F.lit(""))
    made = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counter(name)(text).alias("n_tokens"))
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
