"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed character trigrams (case and signs kept, digits
alike), log-scaled and weighted by inverse document frequency, and four shares of
the whole text: words that repeat the word before, words that came before,
capitals and signs.  They are projected on the leading right singular vectors of
the training matrix.  Labelled vectors are
broadcast; every document's cosines with all of them are exact blocked matrix
products, and the nearest labels vote, weighted by similarity.

Defined results: a null or empty text, and one whose vector is zero, scores the
share of label 1 among the labelled documents (0.5 without any).  A document
labelled more than once counts with its smallest label.  Of neighbours with equal
cosines those of smaller ids vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import held_out, release, share, table
from ._text import word_hashes

BITS = 12
RANK = 48
NEIGHBOURS = 15
POWER = 8
#: Labelled documents that the classifier is fitted on, at most (in expectation): a bounded sample by hash of id, by label.
SAMPLE_PER_LABEL = 1500
THRESHOLD = 0.3
BLOCK = 1 << 18
SHARES = 4
SHARE_WEIGHT = 3.0
ROWS = 512
SCHEMA = "score double"


def features(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of the whole text."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    text = text or ""
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[max(0, at - 2) : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where((code >= 48) & (code <= 57), np.uint32(48), code)
        if len(code) < 3:
            continue
        h = code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA77) ^ code[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def shares(text: str | None) -> list[float]:
    """Of the words: those equal to the word before, and those seen before; of the characters: capitals, and signs."""
    if not text:
        return [0.0] * SHARES
    words = word_hashes(text)
    n = max(1, len(words))
    upper = sign = 0
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _KIND[np.minimum(code, 255)]
        upper += int((kind == 1).sum())
        sign += int((kind == 2).sum())
    return [float((words[1:] == words[:-1]).sum()) / n, 1 - len(np.unique(words)) / n, upper / len(text), sign / len(text)]


_KIND = np.array([1 if chr(c).isupper() else 2 if not (chr(c).isalnum() or chr(c).isspace()) else 0 for c in range(256)], dtype=np.uint8)


def matrix(texts: list[str | None]) -> np.ndarray:
    """One row per text: the trigrams, then the shares, which weigh SHARE_WEIGHT times the trigrams' length at most."""
    out = np.zeros((len(texts), (1 << BITS) + SHARES), np.float32)
    for row, text in zip(out, texts):
        row[:-SHARES] = np.log1p(features(text), dtype=np.float32)
        row[-SHARES:] = np.array(shares(text), np.float32) * np.linalg.norm(row[:-SHARES]) * SHARE_WEIGHT
    return out


def leading_axes(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration, in memory of a few of x's columns."""
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((x.shape[1], rank + 16)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    y = x @ q
    _, turn = np.linalg.eigh(y.T @ y)
    return (q @ turn[:, ::-1][:, :rank]).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    def project(self, x: np.ndarray) -> np.ndarray:
        x = (x * self.weight) @ self.axes
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > 0, x / np.maximum(size, 1e-12), 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), ROWS):
            x = self.project(matrix(texts[at : at + ROWS]))
            cos = x @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(cos, near, 1).min(1, keepdims=True)
            for row in np.flatnonzero((cos >= last).sum(1) > k):  # more equal neighbours than places; vectors are in order of id
                near[row] = np.argsort(-cos[row], kind="stable")[:k]
            w = np.clip(np.take_along_axis(cos, near, 1).astype(np.float64), 0, None) ** POWER
            total = w.sum(1)
            some = total > 1e-12
            out[at : at + ROWS][some] = (w * self.labels[near]).sum(1)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(texts: list[str | None], labels: list[int], rate: float | None = None) -> Model:
    """rate: the share of label 1 where it is known better than from these examples."""
    y = np.array(labels, dtype=np.float64)
    base = float(rate if rate is not None else y.mean() if len(y) else 0.5)
    x = matrix(texts)
    if not len(y):
        return Model(np.zeros((1 << BITS) + SHARES, np.float32), np.zeros(((1 << BITS) + SHARES, 0), np.float32), np.zeros((0, 0), np.float32), y, base)
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    weight[-SHARES:] = 1
    model = Model(weight, leading_axes(x * weight, RANK), np.zeros((0, 0), np.float32), y, base)
    model.vectors = model.project(x).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fitted on about per_label labelled documents of each label, those of the lowest hash of id, so the driver
    receives a bounded sample whatever the input.  Held-out documents are never read."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where(~held_out())
    sizes = {r["_q"]: r["n"] for r in known.groupBy("_q").agg(F.count("*").alias("n")).where("_q in (0, 1)").collect()}
    if not sizes:
        return fit([], [])
    u = (F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / float(1 << 24)).cast("double")
    part = F.create_map(*[F.lit(x) for q, n in sizes.items() for x in (int(q), min(1.0, per_label / n))])
    picked = known.where(F.col("_q").isin(*sizes) & (u < part[F.col("_q")]))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").collect()
    return fit([r["text"] for r in rows], [r["_q"] for r in rows], sizes.get(1, 0) / sum(sizes.values()))


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    held = share(spark, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series(held.value.score(text.tolist()), dtype="float64")
        release()

    return score


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op8_quality": op8_quality}
