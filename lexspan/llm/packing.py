"""Best-fit packing of token sequences, online and in bounded space.

Documents are cut into pieces of at most one sequence.  A packer holds a fixed
number of open bins.  A bitset has a bit for each amount of free space that some
open bin has, so the best fit for a piece (the least free space that holds it)
is the lowest set bit at or above its length.  A piece that fits nowhere opens a
bin; when all bins are open, the fullest, which is the lowest set bit, closes
first.  Of the pieces that arrive, `AT_HAND` at a time are held back and placed
longest first.

Pieces are laid out by range of (doc_id, piece) before packing, with a partition
for every `PIECES_PER_PART`, each packed by itself: a task holds its open bins
only, and running it again gives the same numbers.  A sequence's number is its
partition's number and its own within the partition.

Defined results: a null or empty text is the separator alone; rows with the same
id each count; a row without an id is packed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from .word_bpe import MODEL, encoder, forget

SIZE = 2048
SEPARATOR = 0
OPEN_BINS = 8192
AT_HAND = 10_000
PIECES_PER_PART = 400_000


class BestFit:
    """add(length) -> (sequence, offset); sequences are numbered from 0."""

    def __init__(self, size: int = SIZE, bins: int = OPEN_BINS):
        self.size, self.bins = size, bins
        self.free = 0  # bit s: some open bin has s places free
        self.at: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free space
        self.open = self.made = 0

    def add(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            number, space = self.made, self.size
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.at[left].append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        here = self.at[space]
        number = here.pop()
        if not here:
            self.free &= ~(1 << space)
        return number


def cut_pieces(docs: DataFrame, size: int = SIZE, separator: int = SEPARATOR, name: str = MODEL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a separator, in pieces of at most size."""
    sep = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, data in zip(ids, encoder(name).encode_batch(texts)):
                data += sep
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        forget(name)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = SIZE, bins: int = OPEN_BINS, per_part: int = PIECES_PER_PART) -> DataFrame:
    """pieces (with doc_id, piece, length) and the sequence_id and offset of each."""
    pieces = cut(pieces)  # read several times, and the layout by range must not change between the reads
    parts = max(1, -(-pieces.count() // per_part))
    keys = ["doc_id", "piece", *sorted(set(pieces.columns) - {"doc_id", "piece"})]
    laid = pieces.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    names = laid.columns
    where = names.index("length")

    def together(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= AT_HAND:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]):
        packer, base = BestFit(size, bins), TaskContext.get().partitionId() << 40
        for batch in together(batches):
            length = batch.column(where).to_numpy()
            seq, offset = np.zeros((2, len(length)), dtype=np.int64)
            for i in np.argsort(-length, kind="stable").tolist():  # the pieces at hand come longest first
                seq[i], offset[i] = packer.add(int(length[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq + base), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in laid.dtypes)
    return laid.mapInArrow(run, f"{schema}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, size: int = SIZE, bins: int = OPEN_BINS, separator: int = SEPARATOR, name: str = MODEL, per_part: int = PIECES_PER_PART) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_pieces(docs, size, separator, name), size, bins, per_part)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
