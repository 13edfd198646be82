"""SentencePiece encoding and decoding with the unigram model.

The pieces of a .model file, with their log scores, are a double-array trie over
bytes.  Encoding is the Viterbi path of the highest total score; of equal ones
the path whose last piece starts earliest wins, at every end.  White space is
escaped by a marker that only begins pieces, and characters that no piece holds
stand alone, so a text is a sequence of independent chunks; the distinct chunks
of a batch go through the trie in lock step as arrays, long ones one by one, in
memory that doesn't grow with their length but for the ids.  A
character that no piece covers becomes its bytes' pieces, or the unknown piece.

Scores add up in double precision, whatever the length of the text; the result is
the first of the library's own n-best list.  (Its single-best path may return a
path of a lower score, and it isn't followed in that.)

Defined results: a null or empty text has no ids.  A marker in the text itself
is taken for a space, as the format prescribes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import release, share, table
from .word_bpe import model_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
LONG = 160
#: Places of a long chunk between two looks at what of its path is settled.
SETTLE = 1 << 16
#: Chunks that a model remembers, and characters and bytes of ids that they take, before it forgets all.
CACHE, CACHE_SIZE = 400_000, 32 << 20
BATCH_CHARS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    text: list[str]
    score: list[float]
    kind: list[int]
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def read(cls, path: str) -> Pieces:
        out = cls([], [], [])
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.text.append(piece[1].decode())
                out.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                out.kind.append(piece.get(3, NORMAL))
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or not rules.get(5, 1):
                    raise ValueError("this file normalises texts or leaves spaces as they are, which isn't supported")
                out.dummy_prefix, out.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        return out


class DoubleArray:
    """A trie as two arrays: the child of state s by byte c is t = base[s] + c if check[t] = s.  value[t]: the piece that ends at t, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in keys:
            node = 0
            for c in key:
                node = tree[node].setdefault(c, len(tree))
                if node == len(tree):
                    tree.append({})
            ends[node] = number
        size = 2 * len(tree) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        todo, free, tail = [(0, 0)], 1, 1
        for node, state in todo:
            children = sorted(tree[node])
            if not children:
                continue
            while used[free]:
                free += 1
            at, tries = free, 0
            while used[at] or at < children[0] + 1 or any(used[at - children[0] + c] for c in children):
                at, tries = at + 1, tries + 1
                if tries > 64:
                    at = max(at, tail)
                if at + 512 > size:
                    grow = size
                    base, check, value = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
                    used += bytearray(grow)
                    size += grow
            base[state] = at - children[0]
            for c in children:
                to = int(base[state]) + c
                used[to], check[to] = 1, state
                tail = max(tail, to + 1)
                value[to] = ends.get(tree[node][c], -1)
                todo.append((tree[node][c], to))
        top = tail + 512
        self.base, self.check, self.value = base[:top], check[:top], value[:top]


def _char_bytes() -> np.ndarray:
    out = np.ones(256, np.int64)
    out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 2, 3, 4
    return out


_CHAR = _char_bytes()


class Unigram:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        normal = [s for s, k in zip(pieces.score, pieces.kind) if k == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = low - UNKNOWN_PENALTY
        self.score = np.array([len(t.encode()) * high - 0.1 if k == USER else s for t, s, k in zip(pieces.text, pieces.score, pieces.kind)])
        self.unknown = pieces.kind.index(UNKNOWN) if UNKNOWN in pieces.kind else 0
        keys = [(t.encode(), i) for i, (t, k) in enumerate(zip(pieces.text, pieces.kind)) if k in (NORMAL, USER) and t]
        self.trie = DoubleArray(keys)
        self.reach = max([4, *(len(k) for k, _ in keys)])
        self._plain: tuple[list, ...] | None = None
        by_byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(pieces.text, pieces.kind)) if k == BYTE}
        self.byte_id = np.array([by_byte[b] for b in range(256)]) if len(by_byte) == 256 else None
        self.byte_of = {i: b for b, i in by_byte.items()}
        known = {c for k, _ in keys for c in k.decode()}
        if any(MARK in t.lstrip(MARK) for t, k in zip(pieces.text, pieces.kind) if k in (NORMAL, USER)):
            self.chunk = re.compile(r"(?s).+")
        else:
            alone = "".join(c for c in "\t\n\r\x0b\x0c" if c not in known)
            self.chunk = re.compile(f" +[^ {alone}]*|[{alone}]|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "held": 0, "_plain": None}

    # encoding

    def chunks(self, text: str) -> list[str]:
        """The text with its prefix, spaces still as spaces, in independent chunks."""
        text = text.replace(MARK, " ")
        if self.pieces.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.chunk.findall(" " + text if self.pieces.dummy_prefix else text)

    def paths(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk."""
        data = [c.replace(" ", MARK).encode() for c in chunks]
        out: list = [None] * len(data)
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        at = 0
        while at < len(order):
            if len(data[order[at]]) > LONG:
                out[order[at]] = self._long(data[order[at]])
                at += 1
                continue
            most = max(8, 2 * len(data[order[at]]))
            to = at
            while to < len(order) and to - at < 16384 and len(data[order[to]]) <= min(most, LONG):
                to += 1
            for i, ids in zip(order[at:to], self._together([data[i] for i in order[at:to]])):
                out[i] = ids
            at = to
        return out

    def _together(self, data: list[bytes]) -> list[np.ndarray]:
        t, n = self.trie, len(data)
        size = np.array([len(d) for d in data])
        width = int(size.max())
        letters = np.zeros((n, width + 1), np.uint8)
        letters[np.arange(width + 1)[None, :] < size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 5), np.int16), np.zeros((n, width + 5), np.int32)

        def offer(rows, end, score, begin, ids):
            better = score > best[rows, end]
            rows, end = rows[better], end[better] if isinstance(end, np.ndarray) else end
            best[rows, end], start[rows, end], piece[rows, end] = score[better], begin, ids[better]

        for p in range(width):
            rows = np.flatnonzero((best[:, p] > -np.inf) & (size > p))
            if not len(rows):
                continue
            so_far, chars = best[rows, p], _CHAR[letters[rows, p]]
            single = np.zeros(len(rows), bool)
            going, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for d in range(width - p):
                to = t.base[state] + letters[rows[going], p + d]
                to = np.where((t.check[to] == state) & (to > 0), to, -1)
                going, state = going[to >= 0], to[to >= 0].astype(np.int64)
                if not len(going):
                    break
                ids = t.value[state]
                ends = np.flatnonzero(ids >= 0)
                if len(ends):
                    who, ids = going[ends], ids[ends]
                    single[who] |= chars[who] == d + 1
                    offer(rows[who], p + d + 1, so_far[who] + self.score[ids], p, ids)
            lone = np.flatnonzero(~single)
            if len(lone):
                offer(rows[lone], p + chars[lone], so_far[lone] + self.unknown_score, p, np.full(len(lone), -1))
        # back from the ends, all chunks at once
        row, at, found = np.arange(n), size.copy(), []
        while len(row):
            begin, ids = start[row, at].astype(np.int64), piece[row, at]
            found.append((row, begin, ids, at))
            row, at = row[begin > 0], begin[begin > 0]
        row, begin, ids, end = (np.concatenate(x) for x in zip(*found))
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            if self.byte_id is None:
                ids[lone] = self.unknown
            else:
                many = (end - begin)[lone]
                who = np.repeat(row[lone], many)
                place = np.repeat(begin[lone], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                stay = ids >= 0
                row, begin, ids = np.append(row[stay], who), np.append(begin[stay], place), np.append(ids[stay], self.byte_id[letters[who, place]])
        order = np.lexsort((begin, row))
        out = np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(row, minlength=n))[:-1])
        return out if self.byte_id is not None else [self._one_unknown(x) for x in out]

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """Unknown characters in a row are one piece."""
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
        return ids[keep]

    def _long(self, data: bytes) -> np.ndarray:
        """The ids of one chunk.  Now and then the paths to all ends that can still be reached are followed back to where they meet; up to there
        the path is settled, and given out."""
        if self._plain is None:
            self._plain = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score))
        base, check, value, score = self._plain
        n, low, reach = len(data), -float("inf"), self.reach
        best, back = [0.0], [(0, -1)]  # of the places from off on; back holds places counted from off
        off, look, made = 0, SETTLE, []

        def path(end: int) -> np.ndarray:
            ids: list[int] = []
            while end > 0:
                begin, i = back[end]
                ids += [i] if i >= 0 else [self.unknown] if self.byte_id is None else self.byte_id[np.frombuffer(data[off + begin : off + end], np.uint8)][::-1].tolist()
                end = begin
            return np.array(ids[::-1], dtype="<u4")

        for at in range(n):
            p = at - off
            if p == look:
                open_ends = {e for e in range(p, len(best)) if best[e] > low}
                while len(open_ends) > 1 or max(open_ends) >= p:
                    end = max(open_ends)
                    open_ends.remove(end)
                    open_ends.add(back[end][0])
                met = open_ends.pop()
                made.append(path(met))
                best, back = best[met:], [(b - met, i) for b, i in back[met:]]
                off, p = off + met, p - met
                look = p + SETTLE
            short = p + reach + 1 - len(best)
            if short > 0:
                best += [low] * (short + SETTLE)
                back += [(0, -1)] * (short + SETTLE)
            if best[p] == low:
                continue
            state, single, chars, d = 0, False, int(_CHAR[data[at]]), at
            while d < n:
                to = base[state] + data[d]
                if to <= 0 or check[to] != state:
                    break
                state, d = to, d + 1
                if value[state] >= 0:
                    single = single or d - at == chars
                    s = best[p] + score[value[state]]
                    if s > best[d - off]:
                        best[d - off], back[d - off] = s, (p, value[state])
            if not single and best[p] + self.unknown_score > best[p + chars]:
                best[p + chars], back[p + chars] = best[p] + self.unknown_score, (p, -1)
        out = np.concatenate([*made, path(n - off)])
        return out if self.byte_id is not None else self._one_unknown(out)

    # decoding

    def _surface(self, ids) -> str:
        parts, raw = [], bytearray()
        ids = np.asarray(ids, dtype=np.int64)
        for i in chain(chain.from_iterable(ids[at : at + SETTLE].tolist() for at in range(0, len(ids), SETTLE)), [-1]):
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(_lossy(bytes(raw)))
                raw.clear()
            if i >= 0 and self.pieces.kind[i] != CONTROL:
                parts.append(" ⁇ " if i == self.unknown else self.pieces.text[i].replace(MARK, " "))
        return "".join(parts)

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, markers as spaces, runs of byte pieces as UTF-8 with each bad byte as U+FFFD."""
        text = self._surface(ids)
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and the text that they decode to."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < BATCH_CHARS:
                size += len(texts[to] or "")
                to += 1
            split = [self.chunks(t or "") for t in texts[at:to]]
            if not self.cache or len(self.cache) > CACHE or self.held > CACHE_SIZE:
                self.cache, self.held = {}, 0
            fresh = list(set().union(*split).difference(self.cache))
            for chunk, ids in zip(fresh, self.paths(fresh)):
                self.cache[chunk] = (ids.tobytes(), self._surface(ids))
                self.held += len(chunk) + 4 * len(ids)
            for parts in split:
                got = list(map(self.cache.__getitem__, parts))
                text = "".join([g[1] for g in got])
                yield b"".join([g[0] for g in got]), text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text
            at = to

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text]))[0], "<u4").tolist()


def _lossy(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def encode_documents(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_bytes (UTF-8, of the text)
    and round_trip (the ids decode to the text; a null text counts as empty)."""
    held = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [(len(ids) // 4, zlib.crc32(ids), len(text.encode()), text == back) for text, (ids, back) in zip(texts, held.value.encode_batch(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_pieces", "ids_crc32", "n_bytes", "round_trip"])
        held.value.cache = {}
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), Unigram(Pieces.read(model_path(MODEL))))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
