"""Lexical search: weighted BM25 and substring matches, fused by reciprocal rank.

With a stored index, BM25 reads the postings of the query's terms, which the
parquet scan finds by their order, and a row of statistics for each part.
Without one, the statistics are one aggregate of a row and scoring is a second
scan that only chunks with a term survive.  Substrings are looked for in the
texts.  Of each list at most 80 candidates go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_folded
from ..plans.search_plan import SearchPlan
from .corpus import filtered
from .index import WEIGHTS, Index, fields

CANDIDATES = 80
RRF_K = 60
K1, B = 1.2, 0.75
PHRASE, ALL_TERMS, HEADING, LONG_CHUNK = 0.02, 0.012, 0.008, 0.004
LONG = 1600


@dataclass(frozen=True)
class Filters:
    dir: str | None = None
    ext: tuple[str, ...] = ()
    days: float | None = None
    as_of: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return filtered(df, self.dir, self.ext, self.days, self.as_of)


def statistics(f: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """One row: n, avgdl and df (an array by place of term), of all chunks whatever the filters."""
    has = lambda t: F.array_contains("t_text", t) | F.array_contains("t_heading", t) | F.array_contains("t_path", t)
    counts = [F.count_if(has(t)).alias(f"df{i}") for i, t in enumerate(terms)]
    row = f.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *counts)
    return row.select("n", "avgdl", F.array(*[f"df{i}" for i in range(len(terms))]).alias("df"))


def bm25(chunks: DataFrame, terms: tuple[str, ...], filters: Filters = Filters()) -> DataFrame:
    """The chunks (with rel and name) that have a term and pass the filters, with bm25: larger is better."""
    f = fields(chunks)
    stats = statistics(f, terms)  # one row, whatever the corpus
    scored = filters.apply(f).where(F.arrays_overlap("t_text", _terms(terms)) | F.arrays_overlap("t_heading", _terms(terms)) | F.arrays_overlap("t_path", _terms(terms)))
    scored = scored.join(F.broadcast(stats))
    weight = lambda t: sum(F.when(F.array_contains(f"t_{name}", t), w).otherwise(0.0) for name, w in WEIGHTS.items())
    return scored.withColumn("bm25", _total([weight(t) for t in terms])).drop("n", "avgdl", "df", "t_text", "t_heading", "t_path", "dl")


def _total(weights: list):
    """BM25 of a row with n, avgdl, df and dl, from its weight for each term."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        df = F.col("df")[i]
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        total = total + idf * w * (K1 + 1) / (w + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return total


def indexed_bm25(ix: Index, terms: tuple[str, ...], filters: Filters = Filters()) -> DataFrame:
    """chunk_id and bm25, as bm25 gives them, from stored postings."""
    found = ix.postings.where(F.col("term").isin(*terms))
    corpus = ix.stats.agg(F.sum("chunks").alias("n"), (F.sum("terms") / F.sum("chunks")).alias("avgdl"))
    df = found.agg(F.array(*[F.count_if(F.col("term") == t) for t in terms]).alias("df"))
    if filters != Filters():
        found = found.join(filters.apply(ix.docs).select("doc_id"), "doc_id", "left_semi")
    weights = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, t in enumerate(terms)]
    rows = found.groupBy("chunk_id").agg(F.max("dl").alias("dl"), *weights)
    scored = rows.join(F.broadcast(corpus.join(df)))  # one row
    return scored.select("chunk_id", _total([F.col(f"w{i}") for i in range(len(terms))]).alias("bm25"))


def _terms(terms: tuple[str, ...]):
    return F.array(*map(F.lit, terms))


def word_ranks(chunks: DataFrame | None, plan: SearchPlan, filters: Filters = Filters(), ix: Index | None = None) -> DataFrame:
    """chunk_id and rank_a, from 0: the 80 best chunks by BM25, ties by id.  ix: the chunks' stored index, read in their place."""
    scored = bm25(chunks, plan.word_terms, filters) if ix is None else indexed_bm25(ix, plan.word_terms, filters)
    best = scored.select("chunk_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "chunk_id").limit(CANDIDATES)
    return best.select("chunk_id", "bm25", (F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id")) - 1).alias("rank_a"))


def substring_ranks(chunks: DataFrame, plan: SearchPlan, filters: Filters = Filters(), ix: Index | None = None) -> DataFrame:
    """chunk_id, term_idx and rank_b, from 0: of each contained term the first 80 chunks by id; a chunk's rank is that of the
    first term in plan order that lists it."""
    hits = F.filter(F.array(*[F.when(contains_folded(F.col("text"), t), F.lit(i)) for i, t in enumerate(plan.contained)]), lambda i: i.isNotNull())
    if ix is None:
        found = filters.apply(chunks).select("chunk_id", F.explode(hits).alias("term_idx"))
    else:  # documents are joined with the few chunks that have a term
        found = chunks.select("chunk_id", "doc_id", F.explode(hits).alias("term_idx"))
        if filters != Filters():
            found = found.join(filters.apply(ix.docs).select("doc_id"), "doc_id", "left_semi")
    first = Window.partitionBy("term_idx").orderBy("chunk_id")
    listed = found.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= CANDIDATES)
    return listed.groupBy("chunk_id").agg(F.min("term_idx").alias("term_idx"), (F.min_by("pos", "term_idx") - 1).alias("rank_b"))


def fused(chunks: DataFrame, plan: SearchPlan, filters: Filters = Filters(), ix: Index | None = None) -> DataFrame:
    """The candidates of both lists with their columns, rank_a, rank_b and score.  With ix, chunks needs no columns of documents."""
    a = word_ranks(chunks, plan, filters, ix).select("chunk_id", "rank_a") if plan.word_terms else None
    b = substring_ranks(chunks, plan, filters, ix) if plan.contained else None
    if a is None or b is None:
        both = (a if b is None else b).withColumns({n: F.lit(None).cast("int") for n in (("rank_b", "term_idx") if b is None else ("rank_a",))})
    else:
        both = a.join(b, "chunk_id", "full_outer")
    rows = chunks.join(F.broadcast(both), "chunk_id")  # at most 80 for each of 21 lists
    if ix is not None:
        rows = ix.docs.join(F.broadcast(rows), "doc_id")
    return rows.withColumn("score", _score(plan))


def _score(plan: SearchPlan):
    reciprocal = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r) + 1), F.lit(0.0))
    score = reciprocal("rank_a") + reciprocal("rank_b")
    for p in plan.phrases:
        if len(p) >= 2:
            score = score + F.when(contains_folded(F.col("text"), p), PHRASE).otherwise(0.0)
    if len(plan.terms) > 1:
        every = F.lit(True)
        for t in plan.terms:
            every = every & contains_folded(F.col("text"), t)
        score = score + F.when(every, ALL_TERMS).otherwise(0.0)
    place = F.concat_ws(" ", "heading", "rel")
    some = F.lit(False)
    for t in plan.terms:
        some = some | contains_folded(place, t)
    score = score + F.when(some, HEADING).otherwise(0.0)
    return F.round(score - F.when(F.length("text") > LONG, LONG_CHUNK).otherwise(0.0), 6)


def search(chunks: DataFrame, plan: SearchPlan, limit: int = 8, per_doc: int = 3, filters: Filters = Filters(), ix: Index | None = None) -> DataFrame:
    """The best hits, at most per_doc of a document; rank from 1.  chunks: line or stored chunks with their document's columns."""
    if not plan:
        return chunks.limit(0).withColumns({"rank": F.lit(0), "score": F.lit(0.0)})
    order = [F.desc("score"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("term_idx"), F.asc_nulls_last("rank_b"), F.asc("chunk_id")]
    own = fused(chunks, plan, filters, ix).withColumn("in_doc", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    best = own.where(F.col("in_doc") <= max(1, min(10, per_doc))).orderBy(*order).limit(max(1, min(30, limit)))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("in_doc")


def group_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each document and how many more it has."""
    first = Window.partitionBy("doc_id").orderBy("rank")
    more = F.count("*").over(Window.partitionBy("doc_id")) - 1
    return hits.withColumn("n", F.row_number().over(first)).withColumn("more", more).where("n = 1").drop("n")
