"""Repeated passages across documents by compact windows of token min-hashes.

Tokens are 5-word shingles.  For one hash function the Cartesian tree of a
document's token hashes gives each token the widest interval whose smallest hash
it is; every subsequence inside that interval and across the token has this
token as its min-hash, so the interval (a compact window) stands for all of them.
Only intervals that hold `MIN_WORDS` words matter: about 2 / 46 of the tokens for
each function.  Two similar passages share a function's min-hash with the
probability that their Jaccard similarity gives.

Windows are joined by their min-hash token and the `EXTEND` tokens before or
after it.  A passage of 46 tokens and similarity 0.8 has lost at most five of
them, so it is one run of equal tokens or two of which the longer has 21; in a
run of 20 or more each token has `EXTEND` others on one side.  So an exact
passage always meets its source, and a line that is frequent but shorter than
15 words brings no documents together.

Each meeting gives the shift between the two passages.  Meetings of a document
pair are joined to intervals by shift and place; verification then compares the
tokens at these shifts (and up to `DRIFT` places off, for inserted or missing
words): a span is reported when every part of it lies in a passage of
`MIN_WORDS` words that is similar (Jaccard of shingles, as bags, at least 0.8) to
one at its place in the earlier document.  Documents are ordered by id: of each
passage the copy in the smallest id has no span.

Skew.  In a bucket each document meets the smallest one only, first within a map
task, so a passage held by a third of all documents leaves each task as one row.
After these pairs are verified, members of larger buckets around which something
isn't in a reported span yet are compared with the bucket's other members inside
tiles of a bounded number; a tile first gives, by hashes and in linear time, each
exact repeat to its smallest holder, then compares what is left and has enough
tokens in common.  No repeat is lost to a smaller document that holds a part of it
only.  Of exact copies a task emits the windows of the first that it meets and
of each that has a smaller id than those before it; all are reported whole by an
aggregate.  Buckets and pairs are sorted by Spark, which spills, and stream
through Python in bounded chunks.

Defined results: texts of fewer than `MIN_WORDS` words, null and empty texts have
no spans; passages repeated only within one document aren't reported; rows
without an id take no part; rows that repeat an id and its text are one document, and of rows
with one id and different texts any may stand for the id.  Ties: of equal sources the smallest id is the source.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import chunks, cut, release, salted_join, starts, table
from ._text import mix, shingles, word_hashes

WORDS = 5
MIN_WORDS = 50
HASHES = 3
#: Tokens on one side of a min-hash token that must be equal too.
EXTEND = 10
#: Places by which the shift may move inside a passage of similarity 0.8, one more than it can.
DRIFT = 3
SIMILARITY = 0.8
#: Rows of a table that is broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
LOCAL_ROWS = 1 << 19
PART = 1 << 20
KEY, PAIR, MEMBER = 0, 1, 2
#: Members of a bucket that one task compares with as many others.
TILE = 4096
#: Rows that a task holds at once, and rows whose tokens it compares at once, in whole groups.
HOLD, CHUNK = 400_000, 20_000
_rng = np.random.default_rng(99)
_SEEDS = _rng.integers(1, 2**63, 16, dtype=np.uint64)
_COEF = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)
_PAD = np.uint32(2**32 - 1)


def compact_windows(tokens: np.ndarray, seed: np.uint64, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """min-hash, place, first and last token of every compact window of at least width tokens.  Equal tokens closer than
    width count once."""
    n = len(tokens)
    value = (mix(tokens ^ seed) & ~_PLACE) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1), dtype=np.uint64)
    padded[:n] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])  # of each width-token subsequence
    place = np.unique(low[np.concatenate(([True], low[1:] != low[:-1]))] & _PLACE).astype(np.int64)
    # a token that some such subsequence has as its smallest needs only such tokens as its borders, so the tree is built over these
    hashes = (value[place] & ~_PLACE).tolist()
    at = place.tolist()
    first, last, stack = [0] * len(at), [n - 1] * len(at), []
    for i, h in enumerate(hashes):
        while stack and hashes[stack[-1]] > h:
            last[stack.pop()] = at[i] - 1
        if stack:
            first[i] = at[stack[-1]] + 1 if hashes[stack[-1]] < h else first[stack[-1]]
        stack.append(i)
    hashes = np.array(hashes, dtype=np.uint64)
    first, last = np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)
    keep = np.ones(len(place), dtype=bool)
    order = np.lexsort((place, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (place[order][1:] - place[order][:-1] < width)
    keep[order[1:][same]] = False
    return hashes[keep], place[keep], first[keep], last[keep]


def block_keys(tokens: np.ndarray, width: int, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of all windows and the first token of each key's block: the blocks that end or begin with a window's min-hash."""
    found = []
    for base in range(0, max(1, len(tokens) - width + 1), PART):
        part = tokens[base : base + PART + 4 * width]
        if len(part) < width:
            break
        for i in range(hashes):
            place = compact_windows(part, _SEEDS[i], width)[1] + base
            found += [place, place - EXTEND]
    at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    at = at[(at >= 0) & (at + EXTEND < len(tokens))]
    key = np.full(len(at), EXTEND, dtype=np.uint64)
    for j in range(EXTEND + 1):
        key += tokens[at + j] * _COEF[j]
    return mix(key).astype(np.int64), at


def _meetings(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> tuple:
    """Meetings of documents a and b at places, joined by shift: a, b, shift, first and last place in b."""
    shift = pa_ - pb
    order = np.lexsort((pb, shift, b, a))
    a, b, shift, pb = a[order], b[order], shift[order], pb[order]
    at = starts(a, b, shift)
    return a[at], b[at], shift[at], pb[at], pb[np.append(at[1:], len(pb)) - 1] if len(at) else pb[:0]


_COLUMNS = {"kind": pa.int8(), "key": pa.int64(), "doc": pa.int64(), "at": pa.int64(), "doc_b": pa.int64(), "lo": pa.int32(), "hi": pa.int32()}
_ROW = "kind byte, key long, doc long, at long, doc_b long, lo int, hi int"


def _batches(kind: int, key, doc, at, doc_b=None, lo=None, hi=None):
    """KEY: hi is 1 where the row stands for others of its bucket; MEMBER: doc_b is the bucket; PAIR: doc, doc_b, shift (in at), places in doc_b."""
    for i in range(0, len(doc), 200_000):
        s = slice(i, i + 200_000)
        none = np.zeros(len(doc[s]), np.int64)
        columns = [np.full(len(none), kind), key[s], doc[s], at[s], *(none if c is None else c[s] for c in (doc_b, lo, hi))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, _COLUMNS.values())], names=list(_COLUMNS))


def _stars(key, doc, at, stands, head=None):
    """Of rows by (key, doc, at): which groups have three documents or more, or two with a row that stands for others; the groups' first rows;
    for each row its group's size class and the first row's document and place.  head: that of the first group, if it began earlier."""
    first = starts(key)
    size = np.diff(np.append(first, len(key)))
    docs = np.add.reduceat(np.concatenate(([1], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))).astype(np.int64), first)
    large = (docs >= 3) | (np.logical_or.reduceat(stands, first) & (docs >= 2))
    centre, place = doc[first], at[first]
    if head is not None and key[0] == head[0]:
        large[0], centre[0], place[0] = True, head[1], head[2]
    return first[large], np.repeat(large, size), np.repeat(centre, size), np.repeat(place, size)


def _deal(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64)).astype(np.int64)


def window_rows(docs: DataFrame, words: int, min_words: int, hashes: int) -> DataFrame:
    width = min_words - words + 1

    def combine(keys, ids, places):
        key, doc, at = np.concatenate(keys), np.concatenate(ids), np.concatenate(places)
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        heads, inside, centre, place = _stars(key, doc, at, np.zeros(len(key), bool))
        met = inside & (doc != centre)
        a, b, shift, lo, hi = _meetings(centre[met], place[met], doc[met], at[met])
        yield from _batches(PAIR, _deal(a ^ _deal(b)), a, shift, b, lo, hi)
        yield from _batches(MEMBER, _deal(doc[inside]), doc[inside], at[inside], key[inside])
        yield from _batches(KEY, key[heads], doc[heads], at[heads], None, None, np.ones(len(heads), np.int64))
        yield from _batches(KEY, key[~inside], doc[~inside], at[~inside])

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[tuple[int, int], int] = {}  # the smallest id of each text so far: its windows must be the class's
        keys, ids, places, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or seen.get(h := (hash(text), len(text)), doc + 1) <= doc:
                    continue
                seen[h] = doc
                tokens = shingles(word_hashes(text), words)
                if len(tokens) < width:
                    continue
                k, at = block_keys(tokens, width, hashes)
                keys.append(k)
                ids.append(np.full(len(k), doc, np.int64))
                places.append(at)
                held += len(k)
                if held >= LOCAL_ROWS:
                    yield from combine(keys, ids, places)
                    keys, ids, places, held = [], [], [], 0
        if held:
            yield from combine(keys, ids, places)
        keys, ids, places = [], [], []
        seen.clear()
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, _ROW)


def _collisions(rows: DataFrame) -> DataFrame:
    """PAIR rows (a, b, shift, places in b) of documents that meet, each window meeting that of the smallest document of its bucket, and
    MEMBER rows (window, bucket) of the buckets with more than two documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        head = None
        for t, whole in chunks(batches, 2, HOLD):
            kind = t.column(0).to_numpy()
            mine = int(np.searchsorted(kind, KEY, "right"))
            yield from t.slice(mine).to_batches()
            if mine:
                key, doc, at, stands = (t.column(i).to_numpy()[:mine] for i in (1, 2, 3, 6))
                _, inside, centre, place = _stars(key, doc, at, stands > 0, head)
                head = None if whole else (key[0], int(centre[0]), int(place[0]))
                met = doc != centre
                a, b, shift, lo, hi = _meetings(centre[met], place[met], doc[met], at[met])
                yield from _batches(PAIR, a, a, shift, b, lo, hi)
                inside = (inside | (not whole)) & (stands == 0)  # those that stand for others have been given as members
                yield from _batches(MEMBER, doc[inside], doc[inside], at[inside], key[inside])
        release()

    return rows.repartition("key").sortWithinPartitions("kind", "key", "doc", "at").mapInArrow(run, _ROW)


def _clusters(meetings: DataFrame, width: int) -> DataFrame:
    """Meetings (a, b, shift, lo, hi) joined to intervals: a, b, the range of shifts, and the stretches of both documents to compare."""
    margin, join = 2 * width, 4 * width

    def run(batches: Iterator[pa.RecordBatch]):
        for t, _ in chunks(batches, 2, HOLD):
            a, b, shift, lo, hi = (t.column(i).to_numpy().astype(np.int64) for i in range(5))
            band = np.zeros(len(a), np.int64)
            at = starts(a, b)
            base = np.repeat(shift[at], np.diff(np.append(at, len(a))))  # shifts are sorted within a pair
            new = np.zeros(len(a), bool)
            new[at] = True
            new[1:] |= (shift[1:] - shift[:-1] > 2 * DRIFT) | ((shift[1:] - base[1:]) // 64 != (shift[:-1] - base[:-1]) // 64)
            band = np.cumsum(new)
            order = np.lexsort((lo, band))
            a, b, shift, lo, hi, band = (c[order] for c in (a, b, shift, lo, hi, band))
            far = np.int64(1) << 33
            reach = np.maximum.accumulate(hi + band * far) - band * far  # the last place so far, in the band
            new = np.ones(len(a), bool)
            new[1:] = (band[1:] != band[:-1]) | (lo[1:] - reach[:-1] > join)
            at = np.flatnonzero(new)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at) + EXTEND
            least, most = np.minimum.reduceat(shift, at), np.maximum.reduceat(shift, at)
            lo, hi = np.maximum(lo - margin, 0), hi + margin
            lo_a, hi_a = np.maximum(lo + least - DRIFT, 0), hi + most + DRIFT
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[at], b[at], least, most, lo_a, hi_a, lo, hi)], names=["a", "b", "least", "most", "lo_a", "hi_a", "lo_b", "hi_b"])
        release()

    rows = meetings.repartition("a", "b").sortWithinPartitions("a", "b", "shift")
    return rows.mapInArrow(run, "a long, b long, least long, most long, lo_a long, hi_a long, lo_b long, hi_b long")


def similar_spans(a: np.ndarray, b: np.ndarray, least: int, most: int, width: int, similarity: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """The maximal spans (first, last token, the least similarity of their passages) of b whose every part lies in a passage of width tokens
    that is similar to that of a at a shift (place in a less place in b) from least to most, or little off."""
    if len(b) < width or len(a) < width:
        return []
    where = np.full(len(b), -1, np.int64)
    for shift in sorted(range(least - DRIFT, most + DRIFT + 1), key=lambda s: max(least - s, s - most, 0)):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        if lo < hi:
            part = where[lo:hi]
            part[(a[lo + shift : hi + shift] == b[lo:hi]) & (part < 0)] = shift + len(b)  # never negative: place and shift are in range
    held = where >= 0
    total = np.concatenate(([0], np.cumsum(held)))
    shared = total[width:] - total[:-width]
    need = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    start = np.flatnonzero(shared >= need)
    if not len(start):
        return []
    place = np.flatnonzero(held)
    first, last = place[total[start]], place[total[start + width] - 1]
    long_a = np.abs(last + where[last] - first - where[first]) + 1
    j = shared[start] / (last - first + 1 + long_a - shared[start])
    good = (j >= similarity) & (last - first + 1 >= need)
    first, last, j = first[good], last[good], j[good]
    if not len(first):
        return []
    at = np.flatnonzero(np.concatenate(([True], first[1:] > np.maximum.accumulate(last)[:-1] + 1)))
    return list(zip(first[at].tolist(), np.maximum.reduceat(last, at).tolist(), np.minimum.reduceat(j, at).tolist()))


def _tokens(text: str | None, words: int) -> np.ndarray:
    """The shingles as 32-bit tokens; verification compares dozens of them at a time."""
    t = (shingles(word_hashes(text), words) >> np.uint64(32)).astype(np.uint32)
    return np.where(t == _PAD, np.uint32(0), t)


def _verified(docs: DataFrame, pairs: DataFrame, words: int, width: int) -> DataFrame:
    """The spans of pairs (written already) with their stretches."""
    sides = pairs.select(F.col("a").alias("doc_id"), F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")).union(pairs.select("b", "lo_b", "hi_b"))
    hulls = cut(sides.groupBy("doc_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), gather=True)
    small = hulls.count() <= BROADCAST_ROWS

    def slices(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, text, lo, hi = (batch.column(i) for i in range(4))
            parts = [_tokens(t, words)[x : y + 1].tobytes() for t, x, y in zip(text.to_pylist(), lo.to_pylist(), hi.to_pylist())]
            yield pa.RecordBatch.from_arrays([doc, lo, pa.array(parts, pa.binary())], names=["doc_id", "from", "part"])
        release()

    parts = docs.join(F.broadcast(hulls) if small else hulls, "doc_id").select("doc_id", "text", "lo", "hi").mapInArrow(slices, "doc_id long, from long, part binary").dropDuplicates(["doc_id"])

    def sliced(rows: DataFrame, x: str) -> DataFrame:
        at, n = (F.col(f"lo_{x}") - F.col("from")) * 4 + 1, (F.col(f"hi_{x}") - F.col(f"lo_{x}") + 1) * 4
        return rows.withColumn(f"part_{x}", F.substring("part", at.cast("int"), n.cast("int"))).drop("from", "part")

    # a centre that many documents meet is dealt to several tasks; what goes on are the stretches only
    both = sliced(salted_join(pairs, parts.withColumnRenamed("doc_id", "a"), "a", "b"), "a")
    both = sliced(both.join(parts.withColumnRenamed("doc_id", "b"), "b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for a, b, least, most, lo_a, lo_b, x, y in zip(*(batch.column(i).to_pylist() for i in range(8))):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                off = lo_b - lo_a
                rows += [(b, a, lo_b + s, e - s + words, j) for s, e, j in similar_spans(x, y, least + off, most + off, width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "source_doc_id", "start_word", "n_words", "similarity"])
        release()

    return both.select("a", "b", "least", "most", "lo_a", "lo_b", "part_a", "part_b").mapInArrow(verify, "doc_id long, source_doc_id long, start_word long, n_words long, similarity double")


def _across(docs: DataFrame, members: DataFrame, spans: DataFrame, words: int, width: int) -> DataFrame:
    """Of the members (key, doc_id, at) of large buckets, the meetings by which what no span (doc_id, s, e) covers is found in a smaller document."""
    around = width - EXTEND - 1  # tokens on both sides of a block that a passage with it may reach
    held = spans.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    covered = F.coalesce(F.exists("spans", lambda x: (x["s"] <= F.greatest(F.col("at") - around, F.lit(0))) & (x["e"] >= F.col("at") + around + EXTEND)), F.lit(False))
    placed = members.join(held, "doc_id", "left").select("key", "doc_id", "at", (~covered).alias("open"))
    groups = placed.groupBy("key").agg(F.max("open").alias("open"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size")).where("open and least < most")
    placed = placed.join(groups.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "key")
    placed = cut(placed.groupBy("doc_id").agg(F.collect_set(F.struct("key", "at", "tiles")).alias("windows")), gather=True)
    rows = docs
    if placed.count() <= BROADCAST_ROWS:  # only the ids: the texts of other documents aren't shuffled
        rows = docs.join(F.broadcast(placed.select("doc_id")), "doc_id", "left_semi")
    rows = rows.join(placed, "doc_id").join(held, "doc_id", "left").select("doc_id", "text", "windows", "spans")
    length = 2 * around + EXTEND + 1
    names = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "doc": pa.int64(), "at": pa.int64(), "tokens": pa.binary(), "open": pa.binary()}

    def contexts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                doc, text, windows, known = (batch.column(c)[r].as_py() for c in range(4))
                tokens = _tokens(text, words)
                free = np.zeros(len(tokens) + 2 * around, bool)
                free[around : around + len(tokens)] = True
                for x in known or ():
                    free[around + x["s"] : around + x["e"] + 1] = False
                tokens = np.concatenate((np.full(around, _PAD), tokens, np.full(around, _PAD)))
                share = int(mix(np.array([doc], np.int64).view(np.uint64))[0])
                for w in windows:
                    if w["at"] + length > len(tokens):
                        continue  # another text of the same id
                    part, rest = tokens[w["at"] : w["at"] + length].tobytes(), np.packbits(free[w["at"] : w["at"] + length]).tobytes()
                    mine = share % w["tiles"]
                    out += [(w["key"], min(mine, t), max(mine, t), doc, w["at"], part, rest) for t in range(w["tiles"])]
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), names.values())], names=list(names))
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), names.values())], names=list(names))
        release()

    def run(batches: Iterator[pa.RecordBatch]):
        for t, _ in chunks(batches, 3, CHUNK):
            key, i, j, doc, at = (t.column(c).to_numpy() for c in range(5))
            first = starts(key, i, j)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            tokens = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint32).reshape(len(key), -1)
            free = np.unpackbits(np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(len(key), -1), axis=1, count=length).astype(bool)
            x, y = tile_links(group, doc, tokens, free, width)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y]), pa.array(at[x] - at[y]), pa.array(at[y].astype(np.int32)), pa.array(at[y].astype(np.int32))], names=["a", "b", "shift", "lo", "hi"])
        release()

    tiled = rows.mapInArrow(contexts, "key long, i int, j int, doc long, at long, tokens binary, open binary")
    tiled = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "at")
    return tiled.mapInArrow(run, "a long, b long, shift long, lo int, hi int")


def _sums(x: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros((len(x), x.shape[1] + 1), np.int16)
    np.cumsum(x, axis=1, out=total[:, 1:])
    return total[:, width:] - total[:, :-width]


def tile_links(group: np.ndarray, doc: np.ndarray, tokens: np.ndarray, free: np.ndarray, width: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of one group, the document of x being the smaller: x holds a passage similar to one of y's with tokens that are free in y and
    in no passage of a smaller x.  Rows come by (group, doc), their tokens around one block that the group has in common."""
    need = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    free, real = free.copy(), tokens != _PAD
    xs, ys = [], []
    alive = np.ones(len(group), bool)
    while True:  # tokens that one document of a group holds alone link nothing, nor do rows with too few others
        r, c = np.divmod(np.flatnonzero(real & alive[:, None]), tokens.shape[1])
        code, d = (group[r].astype(np.uint64) << np.uint64(32)) | tokens[r, c], doc[r]
        order = np.lexsort((d, code))
        code, d = code[order], d[order]
        held = np.zeros(tokens.shape, bool)
        if len(code):
            at = starts(code)
            ends = np.append(at[1:], len(code)) - 1
            several = np.repeat(d[at] != d[ends], np.diff(np.append(at, len(code))))
            held[r[order[several]], c[order[several]]] = True
        enough = _sums(held, width) >= need
        ok = enough.any(1)
        if (ok == alive).all():
            break
        alive &= ok

    def wanting() -> np.ndarray:
        return (enough & (_sums(free & held, width) > 0)).any(1)

    rows = np.flatnonzero(alive)
    mixed = mix(tokens[rows].astype(np.uint64))
    for o in range(tokens.shape[1] - width + 1):  # exact repeats: each has its smallest holder
        whole = held[rows, o : o + width].all(1)
        some = rows[whole]
        if not len(some):
            continue
        h = (mixed[whole, o : o + width] * _COEF[:width]).sum(1, dtype=np.uint64) ^ mix(group[some].astype(np.uint64))
        order = np.lexsort((some, h))
        h, some = h[order], some[order]
        at = starts(h)
        centre = np.repeat(some[at], np.diff(np.append(at, len(h))))
        new = (doc[some] != doc[centre]) & free[some, o : o + width].any(1)
        xs.append(centre[new])
        ys.append(some[new])
        free[some[new], o : o + width] = False
    left = np.flatnonzero(wanting())
    first = np.searchsorted(group, group[left])
    for y, lo in zip(left.tolist(), first.tolist()):
        others = np.arange(lo, y)
        others = others[(doc[others] < doc[y]) & alive[others]]
        for at in range(0, len(others), 1024):
            block = others[at : at + 1024]
            same = np.zeros((len(block), tokens.shape[1]), bool)
            for shift in range(-DRIFT, DRIFT + 1):
                to, of = slice(max(0, -shift), tokens.shape[1] - max(0, shift)), slice(max(0, shift), tokens.shape[1] - max(0, -shift))
                same[:, to] |= tokens[block, of] == tokens[y, to]
            same &= real[y]
            fits = _sums(same, width) >= need
            for k in np.flatnonzero((fits & (_sums(same & free[y], width) > 0)).any(1)).tolist():
                good = np.flatnonzero(fits[k] & (_sums((same[k] & free[y])[None], width)[0] > 0))
                if not len(good):
                    continue
                xs.append(block[k : k + 1])
                ys.append(np.array([y]))
                for o in good.tolist():
                    free[y, o : o + width] = False
            if not (free[y] & held[y]).any():
                break
    if not xs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.stack((np.concatenate(xs), np.concatenate(ys)), axis=1), axis=0)
    return both[:, 0], both[:, 1]


def repeated_passages(docs: DataFrame, words: int = WORDS, min_words: int = MIN_WORDS, hashes: int = HASHES) -> DataFrame:
    """doc_id, source_doc_id, start_word, n_words, similarity: the spans of words that repeat a passage of an earlier document."""
    width = min_words - words + 1
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    found = cut(_collisions(window_rows(docs, words, min_words, hashes)))
    met = found.where(F.col("kind") == PAIR).select(F.col("doc").alias("a"), F.col("doc_b").alias("b"), F.col("at").alias("shift"), "lo", "hi")
    spans = cut(_verified(docs, cut(_clusters(met, width), gather=True), words, width), gather=True)

    # exact copies, whole: an aggregate over the text's hash
    def n_words(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(word_hashes(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_words"])

    marked = docs.where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = marked.groupBy("h").agg(F.min("doc_id").alias("source_doc_id"), F.max("doc_id").alias("last")).where("source_doc_id < last").select("h", "source_doc_id")
    # the words are counted once, in the first copy
    counted = docs.join(first.select(F.col("source_doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(n_words, "doc_id long, n_words long").dropDuplicates(["doc_id"])
    long = first.join(counted.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id").where(F.col("n_words") >= min_words)
    copies = marked.join(long, "h").where("doc_id <> source_doc_id").select("doc_id", "source_doc_id", F.lit(0).cast("long").alias("start_word"), "n_words", F.lit(1.0).alias("similarity"))

    spans = spans.union(cut(copies, gather=True))
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()  # the shuffles so far are no longer read; Spark deletes their files when the driver's garbage goes
    members = found.where(F.col("kind") == MEMBER).select(F.col("doc_b").alias("key"), F.col("doc").alias("doc_id"), "at")
    known = spans.select("doc_id", F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words") - words).alias("e")).distinct()
    more = cut(_clusters(_across(docs, members, known, words, width), width), gather=True)
    spans = spans.union(_verified(docs, more, words, width))

    return spans.groupBy("doc_id", "source_doc_id", "start_word", "n_words").agg(F.max("similarity").alias("similarity"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
