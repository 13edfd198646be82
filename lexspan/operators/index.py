"""The inverted index as DataFrames.

A chunk is found by the terms of three fields: its text, its heading and its
path, of weights 4, 2 and 1.5.  Fields hold distinct terms, so a chunk's weight
for a term is the sum of the weights of the fields that have it, and its length
is the number of terms of all fields.

Stored postings lie in their document's part, sorted by term, so that a query
reads the row groups of its terms only and a sync rewrites the parts of changed
documents only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MAX_TOKEN, index_terms
from .store import Staged, Store

WEIGHTS = {"text": 4.0, "heading": 2.0, "path": 1.5}
#: Bytes of chunks that a Python worker holds and sorts at once; more make several runs.
RUN_BYTES = 16 << 20


def _plain() -> np.ndarray:
    """By code point: the lower case of a letter or digit, 0 for what parts words, -1 for what is not plain.  Plain is what
    normalising leaves as it is in any text of such, and what has one lower case wherever it stands: most of Latin and its marks."""
    out = np.full(0x2070, -1, np.int32)
    for code in [*range(1, 0x250), *range(0x2010, 0x2070)]:
        c = chr(code)
        if unicodedata.category(c) == "Cn" or unicodedata.normalize("NFKC", c) != c or len(c.lower()) != 1 or ord(c.lower()) >= 0x250 and c.lower() != c:
            continue
        out[code] = ord(c.lower()) if unicodedata.category(c)[0] in "LN" else 0
    return out


PLAIN = _plain()


def _plain_text() -> str:
    """A pattern of plain texts.  Java looks single characters under 256 up in a table, but tries others and ranges in turn."""
    codes = np.flatnonzero(PLAIN >= 0)
    ranges = np.split(codes[codes > 0xFF], np.flatnonzero(np.diff(codes[codes > 0xFF]) > 1) + 1)
    common, rare = "".join(rf"\x{{{c:x}}}" for c in codes if c <= 0xFF), "".join(rf"\x{{{r[0]:x}}}-\x{{{r[-1]:x}}}" for r in ranges)
    return rf"^[{common}]*+(?:[{rare}]++[{common}]*+)*+\z"


PLAIN_TEXT = _plain_text()


def path_terms(rows: DataFrame) -> DataFrame:
    """Adds t_path, the terms of rel and name.  Chunks may carry that of their document."""
    return rows.withColumn("t_path", index_terms(F.concat_ws(" ", "rel", "name")))


def fields(chunks: DataFrame) -> DataFrame:
    """Adds the term arrays t_text, t_heading, t_path and dl, the number of terms; needs t_path, or rel and name."""
    out = chunks.withColumn("t_text", index_terms(F.col("text"))).withColumn("t_heading", index_terms(F.col("heading")))
    out = out if "t_path" in out.columns else path_terms(out)
    return out.withColumn("dl", F.size("t_text") + F.size("t_heading") + F.size("t_path"))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id, term, weight, fields (how many have the term), dl: one row for each chunk and term, without a shuffle."""
    f = fields(chunks)
    terms = F.array_distinct(F.concat("t_text", "t_heading", "t_path"))
    # those of the text come first, so their place tells them; the other fields are short
    has = {"text": F.col("at") < F.size("t_text")} | {name: F.array_contains(f"t_{name}", F.col("term")) for name in ("heading", "path")}
    weight = sum(F.when(has[name], w).otherwise(0.0) for name, w in WEIGHTS.items())
    number = sum(F.when(has[name], 1).otherwise(0) for name in WEIGHTS)
    return f.select("*", F.posexplode(terms).alias("at", "term")).select("chunk_id", "doc_id", "term", weight.alias("weight"), number.alias("fields"), "dl")


def sorted_postings(chunks: DataFrame) -> DataFrame:
    """What postings gives, each task's rows in runs by term and chunk_id, so that a sort of the task's rows only merges runs.
    Texts of PLAIN characters are split in Python, many at once; others, headings and paths have the terms that fields gives."""
    rows = chunks if "t_path" in chunks.columns else path_terms(chunks)
    rows = rows.withColumn("plain", F.col("text").rlike(PLAIN_TEXT))
    text = {"text": F.when(F.col("plain"), F.col("text"))}
    terms = {"t_text": F.when(~F.col("plain"), index_terms(F.col("text"))), "t_heading": index_terms(F.col("heading")), "t_path": F.col("t_path")}
    # strings, as Spark's writer of Arrow goes through a batch's lists again for each row
    rows = rows.select("chunk_id", "doc_id", *(c.alias(n) for n, c in (text | {n: F.array_join(t, " ") for n, t in terms.items()}).items()))
    return rows.mapInArrow(_runs, "chunk_id long, doc_id long, term string, weight double, fields int, dl int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= RUN_BYTES:
            yield from _run(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from _run(pa.Table.from_batches(held))


def _split(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The words of plain texts, lower case, and the number of the text of each; a text's words may repeat."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
    starts = np.cumsum(lengths + 1) - lengths  # a blank stands before each text
    joined = " " + " ".join(t or "" for t in texts.to_pylist())
    chars = PLAIN[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    inside = np.concatenate([[False], chars > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    chars = chars[chars > 0]
    short = end - begin <= MAX_TOKEN
    if not short.all():
        chars = chars[np.repeat(short, end - begin)]
        begin, end = begin[short], end[short]
    places = np.concatenate([[0], np.cumsum(end - begin)])  # of the words' characters, then of their bytes
    places = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80))])[places].astype(np.int32)  # PLAIN has no letter of three bytes
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(data))
    return np.searchsorted(starts, begin, "right") - 1, words


def _run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The postings of these chunks by term and chunk_id.  Numbers are sorted in their place: of the term, of the chunk, of the field."""
    whole = pc.and_(pc.or_(rows["text"].is_valid(), rows["t_text"].is_valid()), pc.and_(rows["t_heading"].is_valid(), rows["t_path"].is_valid()))
    rows = rows.filter(whole)  # a chunk that lacks a field has no postings
    ids = rows["chunk_id"].to_numpy()
    found = [(0, *_split(rows["text"]))]
    for field, name in enumerate(WEIGHTS):
        lists = pc.split_pattern(pc.if_else(pc.equal(rows[f"t_{name}"], ""), None, rows[f"t_{name}"]), " ")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        found.append((field, np.repeat(np.arange(len(ids)), lengths), pc.list_flatten(lists)))
    words = pa.concat_arrays([c for _, _, w in found for c in (w.chunks if isinstance(w, pa.ChunkedArray) else [w])])
    if not len(words):
        return
    words = words.dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()  # by bytes, as Spark sorts
    by_id = np.argsort(ids, kind="stable")
    place, chunk = np.empty(len(order), np.int64), np.empty(len(ids), np.int64)
    place[order], chunk[by_id] = np.arange(len(order)), np.arange(len(ids))
    keys = place[words.indices.to_numpy()] << 35
    keys |= np.concatenate([chunk[at] << 3 | field for field, at, _ in found])
    keys.sort()
    first = np.flatnonzero(np.diff(keys >> 3, prepend=-1))
    has = np.bitwise_or.reduceat(1 << (keys & 7), first)  # a bit for each field
    keys = keys[first]
    row = by_id[(keys >> 3) & 0xFFFFFFFF]
    sets = [[w for i, w in enumerate(WEIGHTS.values()) if s >> i & 1] for s in range(1 << len(WEIGHTS))]
    fields = np.array([len(s) for s in sets], np.int32)[has]
    columns = {
        "chunk_id": ids[row], "doc_id": rows["doc_id"].to_numpy()[row], "term": words.dictionary.take(pa.array(order[keys >> 35])),
        "weight": np.array([float(sum(s)) for s in sets])[has], "fields": fields, "dl": np.bincount(row, fields).astype(np.int32)[row],
    }
    yield from pa.table(columns).to_batches(max_chunksize=1 << 16)


def document_frequencies(post: DataFrame) -> DataFrame:
    """term, df: chunks that have the term."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def statistics(chunks: DataFrame) -> DataFrame:
    """chunks and terms, the sum of their lengths, in one row; nothing is stored or shuffled for it."""
    return fields(chunks).agg(F.count("*").alias("chunks"), F.sum("dl").alias("terms"))


def part_statistics(store: Store, chunks: DataFrame, post: DataFrame) -> DataFrame:
    """part, chunks and terms, the sum of their lengths: a row for each part."""
    n = chunks.groupBy(store.part().alias("part")).agg(F.count("*").alias("chunks"))
    terms = post.groupBy(store.part().alias("part")).agg(F.sum("fields").alias("terms"))
    return n.join(terms, "part", "left").select("part", "chunks", F.coalesce("terms", F.lit(0)).alias("terms"))


def write(store: Store, docs: DataFrame, chunks: DataFrame, post: DataFrame, parts: set[int] | None = None, also: tuple[Staged, ...] = (), dealt: bool = False) -> None:
    """Documents, chunks and their index take the place of those in these parts (None: all) in one step, with what else is staged.
    dealt: chunks and postings were made of dealt documents, and so are written where they are made."""
    written = [store.stage("docs", docs), store.stage("chunks", chunks, dealt), store.stage("postings", post, dealt)]
    stats = part_statistics(store, store.staged(written[1]), store.staged(written[2]))
    store.swap([*written, *also, store.stage("index_stats", stats)], parts)


@dataclass(frozen=True)
class Index:
    """A stored index: postings, a row of statistics for each part, and documents for filters."""

    postings: DataFrame
    stats: DataFrame
    docs: DataFrame

    @classmethod
    def of(cls, store: Store) -> Index:
        return cls(store.read("postings"), store.read("index_stats"), store.read("docs"))
