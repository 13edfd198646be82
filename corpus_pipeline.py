"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of documents, whatever else these are called.  Stages work on
all that their predecessor kept.  Empty tables pass through.  Rows without an id
stay in the stages that compare documents; so do rows that share an id but not
their text, since an id is all by which such a stage tells documents apart.
SQL can't express the classifiers, the joins by similarity or the packing, so
there is no ORACLE_SQL; tests compare the stages with plain Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import jaccard_join, language_id, packing, quality, substring_dedup
from lexspan.llm._spark import cut, table
from lexspan.llm._text import word_hashes

#: A language's corrected share of a text's n-grams under which no language is believed.
MIN_LANGUAGE = 0.1
#: Rows of a table of ids that is broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

ORACLE_SQL = None


def _hint(ids: DataFrame, size: str = "1") -> DataFrame:
    """ids (already written), broadcast if they are few; size: what a row counts for."""
    return F.broadcast(ids) if (ids.agg(F.sum(F.expr(size))).first()[0] or 0) <= BROADCAST_IDS else ids


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learnt language explains."""
    model = language_id.train(docs)
    if not model.languages:
        return docs
    made = _free(docs, "language")
    judged = docs.withColumn(made, language_id.predictor(spark, model)(F.col("text")))
    return judged.where((F.col(made)["lang_pred"] != language_id.UND) & (F.col(made)["score"] >= MIN_LANGUAGE)).drop(made)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under the classifier's threshold."""
    score = quality.scorer(spark, quality.train(docs, table(spark, sf_dir, "labels")))
    made = _free(docs, "score")
    return docs.withColumn(made, score("text")).where(F.col(made) >= quality.THRESHOLD).drop(made)


def _ambiguous(docs: DataFrame) -> DataFrame:
    """doc_id and n (its rows) of the ids that repeat, and whether their texts differ."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.md5(text)).alias("lo"), F.max(F.md5(text)).alias("hi"))
    return cut(texts.where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("differ")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once if its row is repeated."""
    twice = _ambiguous(docs)
    differ = _hint(twice.where("differ").select("doc_id"))
    groups = jaccard_join.near_duplicates(docs.join(differ, "doc_id", "left_anti"))
    gone = _hint(cut(groups.where("doc_id <> component_id").select("doc_id").distinct()))
    same = _hint(twice.where("not differ").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti")
    once = kept.join(same, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(same, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def without_spans(text: str | None, starts, lengths) -> str:
    """The text without the given spans of words; white space around a cut becomes one line break."""
    _, begin, end = word_hashes(text, spans=True)
    data, gone = (text or "").encode(), np.zeros(len(begin) + 1, dtype=np.int64)
    for s, n in zip(starts, lengths):
        gone[s] += 1
        gone[min(s + n, len(begin))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    parts, edge = [], np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    for a, b in zip(edge[0::2], edge[1::2]):
        lo = 0 if a == 0 else int(begin[a])
        hi = len(data) if b == len(begin) else int(end[b - 1])
        parts.append(data[lo:hi].decode())
    return "\n".join(parts)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat one of a smaller id; a document of which nothing is left goes.  n_chars follows the text."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([without_spans(*x) for x in zip(text, starts, lengths)], dtype=object)

    differ = _hint(_ambiguous(docs).where("differ").select("doc_id"))
    made = _free(docs, "spans")
    spans = substring_dedup.repeated_passages(docs.join(differ, "doc_id", "left_anti")).groupBy("doc_id", "start_word").agg(F.max("n_words").alias("n_words"))
    spans = cut(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias(made)))
    hinted = _hint(spans, f"size({made})")
    changed = docs.join(hinted, "doc_id").withColumn("text", rest("text", F.col(made)["start_word"], F.col(made)["n_words"])).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.join(hinted, "doc_id", "left_anti").select(*docs.columns).unionByName(changed.select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
