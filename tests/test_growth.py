"""What must not grow faster than the tables: rows broadcast, shuffled and written."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexspan.operators import corpus, gate, index, search
from lexspan.operators import store as store_module
from lexspan.operators.store import Store
from lexspan.plans import catalog

DATA = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 100])
def test_named_paths_never_broadcasts_clauses(spark, monkeypatch, few):
    monkeypatch.setattr(gate, "FEW_NAMES", few, raising=False)
    texts = ["See DOC_1.txt, and doc_11.txt! Nothing else", "doc_ 1.txt", "a doc_1.txtdoc_2.md", None, "", "do", "readme, readme"]
    known = ["doc_1.txt", "doc_11.txt", "doc_2.md", "doc", "readme", "do", "ead", "not there"]
    messages = spark.createDataFrame(list(enumerate(texts)), "session_id int, text string")
    found = gate.named_paths(messages, spark.createDataFrame([(k,) for k in known], "name string"))
    clauses = {i: [c.strip() for c in (t or "").lower().replace("!", ",").split(",")] for i, t in enumerate(texts)}
    want = {(i, k) for i, cs in clauses.items() for k in known if len(k) >= 3 and any(k in c for c in cs)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 8
    plan = executed(found)
    assert "BuildLeft" not in plan and ("Broadcast" in plan) == (few > 0)


def test_index_statistics_need_no_store(spark, monkeypatch):
    def stored(*_):
        raise AssertionError("a store is written for two numbers")

    monkeypatch.setattr(catalog, "_store", stored)
    row = catalog.QUERIES["index_statistics"](spark, DATA).first()
    monkeypatch.undo()
    kept = catalog._store(spark, DATA).read("index_stats").agg(F.sum("chunks"), F.sum("terms")).first()
    assert tuple(row) == tuple(kept)


def test_texts_are_tokenised_once(spark):
    plan = index.fields(catalog._chunks(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("com.ibm.icu") == 2, "one for the text, one for the path, none for the empty heading"


def test_texts_are_not_joined_for_sizes(spark):
    df = catalog._docs(spark, DATA).select("doc_id", "size", "chars", "status")
    joined = df._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[1]
    assert "length(text" in joined and "Filter" not in joined.split("length(text")[0]
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[0]
    assert "text" not in top


def test_dealt_postings_are_sorted_without_a_shuffle(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("same"), F.col("id"), F.col("id") % 7, F.lit("ｗｉｄｅ")).alias("text"), F.lit("a/b.txt").alias("rel"), F.lit("b.txt").alias("name"))
    store = Store(spark, str(tmp_path / "s"), parts=4)
    limit = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(limit)

    def made(rows):
        chunks = corpus.line_chunks(index.path_terms(rows), ["t_path"])
        return index.postings(chunks)

    dealt = store.dealt(docs, 3 * 4 * store_module.TASK_BYTES)
    assert dealt.rdd.getNumPartitions() == 12
    assert executed(made(dealt)).count("Exchange") == 1
    staged = store.stage("postings", made(dealt), dealt=True)
    assert spark.conf.get(limit) == before
    files = sorted((tmp_path / "s").glob("postings/*/part=*/*.parquet"))
    assert 4 <= len(files) <= 12, "a file for each task, as its documents are of one part"
    for f in files:
        rows = pq.ParquetFile(f).read().to_pylist()
        assert rows == sorted(rows, key=lambda r: (r["term"].encode(), r["chunk_id"]))
    other = store.stage("postings", made(docs))
    want = sorted(map(tuple, store.staged(other).collect()))
    assert sorted(map(tuple, store.staged(staged).collect())) == want
    store.swap([staged])
    for k in range(4):
        ids = {r["doc_id"] for r in store.read("postings", {k}).collect()}
        assert ids == {r["doc_id"] for r in docs.where(store.part() == k).collect()}


def test_older_stores_keep_their_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), parts=4)
    assert "xxhash64" not in str(store.part())
    store.deal = "xxhash64"
    store.write("docs", store.empty("docs"))
    manifest = next((tmp_path / "s" / "manifest").glob("*.json"))
    old = json.loads(manifest.read_text())
    assert old.pop("deal") == "xxhash64"
    manifest.write_text(json.dumps(old))
    for crc in manifest.parent.glob(".*.crc"):
        crc.unlink()
    assert "xxhash64" in str(Store(spark, str(tmp_path / "s")).part())


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_search"])
def test_first_query_deals_documents_once(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "_STORES", {})
    plans = {}

    def stage(self, table, df, *dealt, kept=Store.stage):
        plans[table] = executed(df)
        return kept(self, table, df, *dealt) if dealt and dealt[0] or table not in ("chunks", "postings") else pytest.fail(f"{table} are shuffled")

    monkeypatch.setattr(Store, "stage", stage)
    got = catalog.QUERIES[name](spark, DATA).collect()
    assert all(plans[t].count("Exchange hashpartitioning") == 1 for t in ("chunks", "postings"))
    if name == "bm25_topk":
        want = catalog.QUERIES["bm25_scan"](spark, DATA)
    else:
        want = search.search(catalog._chunks(spark, DATA), catalog._PLAN).select("rank", "chunk_id", "doc_id", "rel", "score")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_sorted_postings_are_the_postings(spark, monkeypatch):
    plain = [chr(c) for c in range(1, len(index.PLAIN)) if index.PLAIN[c] >= 0]
    assert len(plain) > 600
    odd = ["\x00a b", "ｗｉｄｅ Ⅳ", "a\u0301 e\u0308x", "İI ıi", "ΟΔΟΣ Σ", "追溯系统 GS1追溯", "𝔸 😀x", "x" * 64 + " " + "y" * 65, "É" * 64 + "-" + "É" * 65, "", " ", None, "ß ẞ Straße STRASSE", "b a B A a"]
    texts = [*odd, *plain, *(f"aB{c}Cd{c} {c}" for c in plain), "".join(plain), "\n".join(plain), "the end\u0085", "end\n"]
    rows = [(7 * i % 1009, i % 5, t, ["", "the b", "Überß 追溯", None][i % 4] if i % 9 == 0 else "", "src/the_b.txt", "the_b.txt") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame([*rows, rows[-1]], "chunk_id long, doc_id long, text string, heading string, rel string, name string").coalesce(1)
    want = sorted(map(tuple, index.postings(chunks).select("term", "chunk_id", "doc_id", "weight", "fields", "dl").collect()))
    assert len(want) > 3000
    got = [tuple(r) for r in index.sorted_postings(chunks).select("term", "chunk_id", "doc_id", "weight", "fields", "dl").collect()]
    assert sorted(got) == want
    assert [(t[0].encode(), t[1]) for t in got] == sorted((t[0].encode(), t[1]) for t in got), "one run, so all in order"
    assert index.sorted_postings(chunks.limit(0)).count() == 0
    schema = pa.schema({"chunk_id": pa.int64(), "doc_id": pa.int64()} | dict.fromkeys(["text", "t_text", "t_heading", "t_path"], pa.string()))
    four = [{"chunk_id": i, "doc_id": i, "text": "b a" if i % 2 else None, "t_text": None if i % 2 else "c", "t_heading": "", "t_path": "a"} for i in range(4)]
    small = pa.Table.from_pylist(four, schema).to_batches(max_chunksize=1)
    monkeypatch.setattr(index, "RUN_BYTES", 1)
    runs = [pa.Table.from_batches([b]).select(["term", "chunk_id", "weight", "dl"]).to_pylist() for b in index._runs(iter(small))]
    assert [[tuple(r.values()) for r in run] for run in runs] == [[("a", 0, 1.5, 2), ("c", 0, 4.0, 2)], [("a", 1, 5.5, 3), ("b", 1, 4.0, 3)], [("a", 2, 1.5, 2), ("c", 2, 4.0, 2)], [("a", 3, 5.5, 3), ("b", 3, 4.0, 3)]]


def test_stored_postings_are_made_without_explode(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_STORES", {})
    plans = {}
    monkeypatch.setattr(Store, "stage", lambda self, table, df, *dealt, kept=Store.stage: (plans.__setitem__(table, executed(df)), kept(self, table, df, *dealt))[1])
    catalog.QUERIES["bm25_topk"](spark, DATA)
    assert "MapInArrow" in plans["postings"] and plans["postings"].count("Generate") == 1, "lines only"
