import random
from collections import Counter

import duckdb
import pytest
from helpers import documents
from pyspark.sql import functions as F

from lexspan.llm import language_id, quality

DATA = "/root/testdata/sf0.01"


def test_language_accuracy_held_out(spark):
    got = language_id.op1_language_id(spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_is_the_crc(spark):
    import zlib

    rows = language_id.op1_language_id(spark, DATA).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_odd_texts(spark):
    model = language_id.fit([("en", "the cat and the dog of the house")] * 3 + [("fr", "le chat et le chien de la maison")] * 2)
    long = "the dog of the house and the cat " * 40_000
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "le chien de la maison"), (5, long), (6, "中文"), (7, "THE CAT"), (None, "the cat")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(documents(spark, rows), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "fr", 5: "en", 6: "en", 7: "en", None: "en"}
    assert language_id.fit([]).predict("the cat") == ("und", 0.0)
    assert language_id.train(documents(spark, rows).limit(0)).languages == []


def test_bloom_never_misses():
    texts = ["some words that are learnt here", "und andere worte"]
    model = language_id.fit([("en", texts[0]), ("de", texts[1])])
    for i, lang in enumerate(("en", "de")):
        hits, total = model.counts(texts[i])
        assert hits[model.languages.index(lang)] == total


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
    while "  " in letters:
        letters = letters.replace("  ", " ")
    letters = letters.ljust(language_id.GRAM)
    return [letters[i : i + language_id.GRAM] for i in range(len(letters) - language_id.GRAM + 1)]


def test_language_against_plain_sets():
    """Every n-gram that a language holds counts, however rare; the counts are those of plain sets but for some false positives."""
    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)] for lang, letters in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "aeijklmno"))}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    examples = [(lang, say(lang, 60)) for lang in words for _ in range(30)] + [("a", say("b", 20))]
    model = language_id.fit(examples)
    often = {lang: Counter(g for x, t in examples if x == lang for g in plain_grams(t)) for lang in words}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in often.items()}
    own = {lang: {g for g, x in s.items() if x * language_id.FOREIGN >= max(o.get(g, 0) for o in share.values())} for lang, s in share.items()}
    for lang in words:
        for _ in range(30):
            text = say(lang, rng.randint(1, 40))
            hits, total = model.counts(text)
            grams = plain_grams(text)
            assert total == len(grams)
            for other, n in zip(model.languages, hits):
                exact = sum(g in own[other] for g in grams)
                assert exact <= n <= exact + 0.05 * total + 2
            assert model.predict(text)[0] == max(model.languages, key=lambda x: sum(g in own[x] for g in grams))


def test_stray_texts_of_another_language_do_not_count():
    clean = [("en", "the cat and the dog of the house " * 20)] * 40
    model = language_id.fit([*clean, *[("fr", "le chat et le chien de la maison " * 20)] * 39, ("fr", "the cat and the dog")])
    assert model.predict("the dog and the cat")[0] == "en"
    assert model.counts("the dog and the cat")[0][model.languages.index("fr")] < 8


def test_many_languages_use_more_bytes():
    words = [f"{a}{b}{c}" * 3 for a in "abcde" for b in "fghi" for c in "kl"]
    model = language_id.fit([(w, w + " " + w) for w in words])
    assert model.slots.shape[1] == 5 and all(model.predict(w)[0] == w for w in words)


def test_quality_held_out(spark):
    got = quality.op8_quality(spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_ignores_held_out_labels(spark):
    """Turning every held-out label round changes no score."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, turned))
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all() and a.base == b.base


def test_quality_voting_against_plain_loops():
    import numpy as np

    texts = [f"good prose number {i} with words" for i in range(20)] + [f"###$$$ {i} !!!" for i in range(20)]
    model = quality.fit(texts, [1] * 20 + [0] * 20)
    ask = ["good prose", "$$$ ###", "", None, "x"]
    got = model.score(ask)
    for t, s in zip(ask, got):
        v = model.project(quality.matrix([t]))[0]
        cos = [float(v @ w) for w in model.vectors]
        near = sorted(range(40), key=lambda i: -cos[i])[: quality.NEIGHBOURS]
        w = [max(0, cos[i]) ** quality.POWER for i in near]
        want = sum(a * model.labels[i] for a, i in zip(w, near)) / sum(w) if sum(w) > 1e-12 else model.base
        assert s == pytest.approx(want, abs=1e-3)
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] == got[3] == model.base
    assert (quality.fit([], []).score(["a", None]) == np.array([0.5, 0.5])).all()


def test_equal_neighbours_vote_by_id():
    model = quality.fit(["good prose with words"] * 40 + ["###$$$"] * 3, [1] * 10 + [0] * 33)
    same = model.vectors[0].copy()
    model.vectors[:40] = same
    assert model.score(["good prose with words"])[0] == pytest.approx(10 / 15)


def test_quality_odd_tables(spark):
    """Doubled labels count once with the smallest, repeated rows each get a score, long texts and other columns do no harm, nothing gives nothing."""
    rows = [(i, f"good prose number {i} with words", ) for i in range(40)] + [(i, f"###$$$ {i} !!!") for i in range(40, 80)] + [(90, None), (91, ""), (92, "good prose " * 60_000), (92, "good prose " * 60_000)]
    docs = documents(spark, rows).withColumn("score", F.lit("x"))
    marks = [(i, int(i < 40)) for i in range(80)] + [(3, 1), (50, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").withColumn("text", F.lit("y"))
    model = quality.train(docs, labels)
    made = docs.select("doc_id", quality.scorer(spark, model)("text").alias("got")).collect()
    assert len(made) == 84 and all(0 <= r["got"] <= 1 for r in made)
    assert len({r["got"] for r in made if r["doc_id"] == 92}) == 1
    assert all(r["got"] == model.base for r in made if r["doc_id"] in (90, 91))
    assert quality.train(docs, labels.limit(0)).base == 0.5
    assert docs.limit(0).select(quality.scorer(spark, model)("text")).collect() == []


def test_oracles_run_in_duckdb(spark):
    from lexspan.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLES.items():
        made, want = QUERIES[name](spark, DATA), con.sql(sql)
        assert made.columns == want.columns
        assert sorted(map(tuple, made.collect())) == sorted(want.fetchall())
