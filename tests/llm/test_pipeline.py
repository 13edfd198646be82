import random

import corpus_pipeline
import pytest
from helpers import documents, edited, prose, shingles

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.collect()}
        kept = corpus_pipeline.cut(stage(spark, kept, DATA))
        assert kept.columns == columns and kept.schema == docs.schema
        assert {r["doc_id"] for r in kept.collect()} <= before
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in kept.collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).drop("sequence_id").collect())) == sorted(map(str, last.drop("sequence_id").collect()))


def test_language_stage_drops_texts_without_letters(spark):
    rows = [(i, " ".join(prose(30))) for i in range(60)] + [(100, None), (101, ""), (102, "123 456 !!"), (None, "w1 w2 w3")]
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, documents(spark, rows), DATA).collect()}
    assert kept == {*range(60), None}


def test_near_duplicates_stage(spark):
    rng = random.Random(4)
    base = prose(100, rng)
    rows = [(5, " ".join(base)), (7, " ".join(edited(base, 1, rng))), (9, " ".join(base)), (9, " ".join(base)), (11, " ".join(prose(100, rng))), (12, None), (13, "one two"), (13, "one two"), (None, "alone here")]
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), DATA).collect())
    assert kept == sorted(map(str, [5, 11, 12, 13, None]))


def test_passages_stage(spark):
    rng = random.Random(6)
    p = prose(80, rng)
    a, b, c, d = (prose(40, rng) for _ in range(4))
    rows = [(1, " ".join(a + p + b)), (2, " ".join(c + p + d)), (3, " ".join(p)), (4, " ".join(b)), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeated_passages(spark, documents(spark, rows), DATA).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[1]["text"] == rows[0][1] and got[4]["text"] == rows[3][1]
    assert got[2]["text"].split() == c + d and got[2]["n_chars"] == len(got[2]["text"])


@pytest.mark.parametrize("text,starts,lengths,want", [(" a b  c\nd e ", [1, 3], [1, 1], " a\nc\ne "), ("a b c", [0], [3], ""), ("a b", [], [], "a b"), (None, [], [], ""), ("é ü x", [1], [9], "é"), ("a b c d", [1, 1, 2], [1, 2, 1], "a\nd")])
def test_cut_words(text, starts, lengths, want):
    assert corpus_pipeline.without_spans(text, starts, lengths) == want


def test_helpers_agree_with_sets():
    assert len(shingles("a b c d e f")) == 2


def clashing(spark, rows):
    made = [(i, t, "en", 1.0, "x", [2], {"a": 1}) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, score double, language string, spans array<int>, _spans map<string,int>").repartition(3)


def test_clashing_columns_and_empty_tables(spark):
    rng = random.Random(7)
    p = prose(80, rng)
    docs = clashing(spark, [(i, " ".join(prose(40, rng) + p + prose(40, rng))) for i in range(6)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        assert all((r["score"], r["language"], r["spans"], r["_spans"]) == (1.0, "x", [2], {"a": 1}) for r in got.collect())
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(8)
    a, b = " ".join(prose(100, rng)), " ".join(prose(100, rng))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b), (4, b)]
    kept = sorted((r["doc_id"], r["text"] == a) for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), DATA).collect())
    assert kept == [(1, True), (2, False), (2, True), (3, False)]
    cut = sorted((r["doc_id"], r["text"] == a) for r in corpus_pipeline.cut_repeated_passages(spark, documents(spark, rows), DATA).collect())
    assert cut == [(1, True), (2, False), (2, True), (3, False)]
