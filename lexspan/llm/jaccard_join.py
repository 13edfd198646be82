"""Near-duplicate documents: an exact Jaccard join of word n-gram sets by parity sketches.

Every element of a document's set flips one bit of its parity sketch, so two
sketches differ in at most as many bits as the sets do.  At similarity 0.8 sets
of a and b elements differ in at most (a + b) / 9 elements.  In each size band
the sketch falls into a few more segments than the largest such difference;
equal segments (pigeonhole) are the join keys.  A document emits its first
d + 1 segments that aren't empty, d being the largest difference that its own
size allows: of these at least one is equal in any partner, and whichever of two
partners stops first, the other has emitted that segment too.  The segments come
from a sketch of 2^64 positions that is never written out; a folded one of a
few bits for each element is kept for a second bound.  Last comes the exact check
of the sets.

Skew.  Documents of equal sets are one class, found by an aggregate with
map-side combining.  In a bucket of three or more members each is paired with
the smallest one only, first within a map task (so a hot key leaves it as one
row), then among what the tasks have left.  After these pairs are checked, the
members of buckets that still lie in several components are compared, across
these components and by their folded sketches, inside tiles of a bounded number of
members; nothing but pairs that the sketches allow leaves a tile: first a
spanning forest of the nearest, then, with the components that the forest has
joined, all that are left.  So every link that matters for the components is
either checked or implied, and no pair within a component is ever made.

Sets hold 64-bit hashes of shingles (a pair of different shingles is confused
with probability 2^-64).

Defined results: a document without words (null and empty texts too) has size 0
and is its own component; rows without an id link with nothing, except that
equal sets share a component; repeated rows are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ._spark import chunks, cut, release, salted_join, starts, table
from ._text import mix, shingle_set, signature
from .components import components

WORDS = 5
#: Rows of a table of ids that is broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
LOCAL_ROWS = 1 << 20
#: Rows of buckets that a task holds at once.
HOLD = 400_000
#: Members of a bucket that one task compares with as many others.
TILE = 4096
#: 64-bit words of the sketches' first comparison.
COARSE = 16
KEY, MEMBER, PAIR, CENTRE = 0, 1, 2, 3


def bands(n: int) -> list[int]:
    """The size bands in which a set of n elements may meet a partner: its own, and the next if a partner can reach it."""
    own = n.bit_length() - 1
    return [own, own + 1] if 5 * n // 4 >= 2 << own else [own]


def segment_keys(h: np.ndarray) -> np.ndarray:
    """The join keys of a sorted set of hashes."""
    n, out = len(h), []
    mixed = mix(h ^ np.uint64(0x51ED270B0A1F39C1))
    for band in bands(n):
        top = (2 << band) - 1
        most = 2 * top // 9
        count = most + 2 + most // 12
        segment = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        value, name = np.bitwise_xor.reduceat(mixed, first), segment[first]
        need = (n + min(top, 5 * n // 4)) // 9 + 1
        if len(name) >= need:
            value, name = value[:need], name[:need]
        else:  # too few segments have elements: the empty ones count as well
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), name)
            value, name = np.concatenate((value, np.zeros(len(empty), np.uint64))), np.concatenate((name, empty))
        out.append(mix(value ^ mix(name + np.uint64((band + 1) << 40))))
    return np.concatenate(out)


def sketch(h: np.ndarray) -> bytes:
    """The parity sketch folded to a power of two of bits, two to four for each element."""
    bits = max(64, 2 << len(h).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer folded onto the shorter: at most the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    k = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, k), axis=0), np.bitwise_xor.reduce(y.reshape(-1, k), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def similar(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= 80 * (a + b - shared)


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (its signature), sketch."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingle_set(text, words)
                rows.append((doc, len(h), *signature(h), sketch(h) if len(h) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n", "s1", "s2", "sketch"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary")


def _grouped(key: np.ndarray, who: np.ndarray, centre: np.ndarray):
    """Rows sorted by (key, id) without repeats, the first row of each group, and each group's size and whether it holds a centre."""
    order = np.lexsort((who, key))
    key, who, centre = key[order], who[order], centre[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])))
    at = np.flatnonzero(fresh)
    centre = np.logical_or.reduceat(centre, at)
    key, who = key[fresh], who[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key, who, centre, first, np.diff(np.append(first, len(key))), np.logical_or.reduceat(centre, first)


def _stars(key, who, first, size, chosen):
    """Pairs of each chosen group's members with its smallest one, without repeats; and the members as (key, id)."""
    inside = np.repeat(chosen, size)
    head = np.repeat(who[first], size)[inside]
    k, w = key[inside], who[inside]
    a, b = head[head != w], w[head != w]
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b = a[fresh], b[fresh]
    return a, b, k, w


def _rows(kind: int, a: np.ndarray, b: np.ndarray):
    for i in range(0, len(a), 200_000):
        x, y = a[i : i + 200_000].astype(np.int64), b[i : i + 200_000].astype(np.int64)
        to = x if kind in (KEY, CENTRE) else (mix(y.astype(np.uint64)) ^ x.astype(np.uint64)).astype(np.int64)
        ready = np.full(len(x), kind not in (KEY, CENTRE))
        yield pa.RecordBatch.from_arrays([pa.array(ready), pa.array(to), pa.array(np.full(len(x), kind, np.int8)), pa.array(x), pa.array(y)], names=["ready", "p", "kind", "a", "b"])


def key_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """ready (whether a bucket's work is done), p (what to deal rows by), kind, a, b: segment keys with ids, large local buckets as stars already."""

    def combine(keys: list[np.ndarray], ids: list[np.ndarray]):
        key, who = np.concatenate(keys).astype(np.int64), np.concatenate(ids)
        key, who, _, first, size, _ = _grouped(key, who, np.zeros(len(key), bool))
        large = size >= 3
        a, b, k, w = _stars(key, who, first, size, large)
        yield from _rows(PAIR, a, b)
        yield from _rows(MEMBER, k, w)
        yield from _rows(CENTRE, key[first][large], who[first][large])
        small = ~np.repeat(large, size)
        yield from _rows(KEY, key[small], who[small])

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[tuple[int, int]] = set()
        keys, ids, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingle_set(text, words)
                if not len(h) or (s := signature(h)) in seen:
                    continue
                seen.add(s)
                k = segment_keys(h)
                keys.append(k)
                ids.append(np.full(len(k), doc, np.int64))
                held += len(k)
                if held >= LOCAL_ROWS:
                    yield from combine(keys, ids)
                    keys, ids, held = [], [], 0
        if held:
            yield from combine(keys, ids)
        keys, ids = [], []
        seen.clear()
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "ready boolean, p long, kind byte, a long, b long")


def bucket_rows(rows: DataFrame) -> DataFrame:
    """kind, a, b: candidate pairs (ids), and members (key, id) of the buckets that have more than two."""

    def run(batches: Iterator[pa.RecordBatch]):
        head = None  # key and smallest id of a bucket that goes on
        for t, whole in chunks(batches, 2, HOLD):
            ready = t.column(0).to_numpy()
            n = int(np.searchsorted(ready, True))
            yield from t.slice(n).select(["kind", "a", "b"]).to_batches()
            if not n:
                continue
            kind, key, who = (t.column(i).to_numpy()[:n] for i in (2, 3, 4))
            key, who, centre, first, size, any_centre = _grouped(key, who, kind == CENTRE)
            large = (size >= 3) | (any_centre & (size > 1))
            if head is not None and key[0] == head[0]:  # the rows of this bucket so far, too many for one table, were given as members
                large[0] = True
                yield from out(PAIR, np.full(size[0], head[1]), who[: size[0]], who[: size[0]] != head[1])
            elif not whole:
                large[0] = True
            head = None if whole else (head if head is not None and head[0] == key[0] else (key[0], who[0]))
            a, b, _, _ = _stars(key, who, first, size, size > 1)
            yield from out(PAIR, a, b)
            inside = np.repeat(large, size) & ~centre  # centres have been given as members
            yield from out(MEMBER, key[inside], who[inside])
        release()

    def out(kind: int, a: np.ndarray, b: np.ndarray, some: np.ndarray | None = None):
        if some is not None:
            a, b = a[some], b[some]
        for i in range(0, len(a), 200_000):
            x, y = a[i : i + 200_000], b[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x), pa.array(y)], names=["kind", "a", "b"])

    return rows.repartition("p").sortWithinPartitions("ready", "p", "b").mapInArrow(run, "kind byte, a long, b long")


@F.pandas_udf(BooleanType())
def _sketches_allow(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([9 * sketch_distance(x, y) <= p + q for x, p, y, q in zip(a, n, b, m)], dtype=bool)


@F.pandas_udf(BooleanType())
def _sets_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        out.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
    return pd.Series(out, dtype=bool)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and its set, sorted, as bytes, of the documents in ids."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = (shingle_set(t, words) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], names=["doc_id", "elements"])
        release()

    ids = cut(ids, gather=True)
    small = ids.count() <= BROADCAST_IDS
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "doc_id long, elements binary").dropDuplicates(["doc_id"])


def _verified(docs: DataFrame, pairs: DataFrame, about: DataFrame, words: int) -> DataFrame:
    """Of pairs (a, b), those that the sizes and sketches allow and whose sets are similar."""
    side = lambda x: about.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    near = salted_join(pairs, side("a"), "a", "b").where("n_a > 0").join(side("b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    near = cut(near.where(_sketches_allow("sketch_a", "n_a", "sketch_b", "n_b")).select("a", "b"), gather=True)
    sets = _sets(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), words)
    both = salted_join(near, sets.withColumnsRenamed({"doc_id": "a", "elements": "x"}), "a", "b").join(sets.withColumnsRenamed({"doc_id": "b", "elements": "y"}), "b")
    return cut(both.where(_sets_similar("x", "y")).select("a", "b"), gather=True)


def _across(members: DataFrame, reps: DataFrame, apart: DataFrame, forest_only: bool) -> DataFrame:
    """a, b: pairs of a bucket's members in different components that the sketches allow; forest_only: of each tile
    the nearest pairs that join all components that such pairs can join."""
    placed = members.join(apart.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    split = split.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    placed = placed.join(split, "key")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    rows = placed.join(reps.select("rep", "sketch"), "rep").withColumn("mine", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "component", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]):
        for t, _ in chunks(batches, 3, 4 * TILE):
            key, i, j, mine, rep, comp, n = (t.column(c).to_numpy() for c in range(7))
            first = starts(key, i, j)
            for at, to in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                rows = slice(at, to)
                if comp[rows].min() == comp[rows].max():
                    continue
                data = t.column(7).slice(at, to - at).to_pylist()
                a, b = tile_pairs(rep[rows], comp[rows], n[rows], data, mine[rows], int(i[at]) == int(j[at]), forest_only)
                for x in range(0, len(a), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[x : x + 200_000]), pa.array(b[x : x + 200_000])], names=["a", "b"])
        release()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(run, "a long, b long").distinct()


def tile_pairs(rep, comp, n, sketches: list[bytes], mine, within: bool, forest_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) across components that sizes and sketches allow; within: of one tile, else between the two tiles in mine."""
    size = min(map(len, sketches))
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0) for s in sketches])
    coarse = np.bitwise_xor.reduce(bits.reshape(len(bits), -1, min(size // 8, COARSE)), axis=1)
    left = np.arange(len(rep)) if within else np.flatnonzero(mine == mine.min())
    right = left if within else np.flatnonzero(mine != mine.min())
    xs, ys, ds = [], [], []
    for p in range(0, len(left), 512):
        x = left[p : p + 512]
        for q in range(p if within else 0, len(right), 512):
            y = right[q : q + 512]
            m, o = n[x][:, None], n[y][None, :]
            fits = (comp[x][:, None] != comp[y][None, :]) & (5 * np.minimum(m, o) >= 4 * np.maximum(m, o))
            if within and p == q:
                fits = np.triu(fits, 1)
            if not fits.any():
                continue
            far = np.zeros((len(x), len(y)), dtype=np.int32)
            for w in range(coarse.shape[1]):
                far += np.bitwise_count(coarse[x, w][:, None] ^ coarse[y, w][None, :])
            u, v = np.divmod(np.flatnonzero(fits & (9 * far <= m + o)), len(y))
            u, v = x[u], y[v]
            d = np.concatenate([np.bitwise_count(bits[u[e : e + 8192]] ^ bits[v[e : e + 8192]]).sum(1, dtype=np.int64) for e in range(0, len(u), 8192)] or [np.empty(0, np.int64)])
            ok = 9 * d <= n[u] + n[v]
            xs.append(u[ok])
            ys.append(v[ok])
            ds.append(d[ok])
    x, y, d = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (xs, ys, ds))
    if forest_only and len(x):
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = root[c]
            return c

        keep = []
        for e in np.argsort(d, kind="stable").tolist():
            f, g = find(int(comp[x[e]])), find(int(comp[y[e]]))
            if f != g:
                root[max(f, g)] = min(f, g)
                keep.append(e)
        x, y = x[keep], y[keep]
    return np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (columns doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profile = cut(profiles(docs, words), gather=True)
    classes = cut(profile.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), gather=True)
    reps = cut(profile.join(classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n", "sketch"), gather=True)

    rows = cut(bucket_rows(key_rows(docs, words)), gather=True)
    rep_of = cut(profile.where("doc_id is not null and n > 0").join(classes, ["s1", "s2"]).select(F.col("doc_id"), "rep").dropDuplicates(["doc_id"]), gather=True)
    of = lambda x, to: rep_of.select(F.col("doc_id").alias(x), F.col("rep").alias(to))
    found = rows.where(F.col("kind") == PAIR).select("a", "b").distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
    tried = cut(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), gather=True)
    links = _verified(docs, tried, reps, words)

    members = rows.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), "b").join(of("b", "rep"), "b").select("key", "rep").distinct()
    members = cut(members.join(reps.select("rep", "n"), "rep").select("key", "rep", "n"), gather=True)
    for forest_only in (True, False):
        pairs = _across(members, reps, components(links, "a", "b"), forest_only).join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, gather=True)
        links = links.union(_verified(docs, pairs, reps, words))
        tried = tried.union(pairs)

    joined = components(links, "a", "b")
    out = profile.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLES = {
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, component_id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT y, component_id FROM reach JOIN both_ways ON x = reach.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(component_id) AS component_id FROM reach GROUP BY 1) AS c USING (doc_id)
"""
}
QUERIES = {"op6_jaccard_join": op6_jaccard_join}
