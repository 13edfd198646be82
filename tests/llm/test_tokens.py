import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.llm import packing, unigram, word_bpe

DATA = "/root/testdata/sf0.001"
ODD = ["a", "A", "Σ", "ς", "İ", "é", "é", " ", "\n", "\x1c", "\x85", "　", "​", "'s", "'re", "1", "½", "中", "ǅ", "ß", "<|startoftext|>", "<|endoftext|>", "<|end", "\0", "😀", "aaaa", "hello", "--", "한", "ᄀ", "ᅡ", "₏", "\U00010940", "ª"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(word_bpe.MODEL))


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.Encoder()


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ODD), max_size=14).map("".join)))
def test_ids_equal_the_library(library, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(next(encoder.encode_batch([text])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, library):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in word_bpe.op2_token_counts(spark, DATA).collect()}
    for r in df.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)
    long = "word " * 5000
    rows = {r["doc_id"]: tuple(r)[1:] for r in word_bpe.count_tokens(documents(spark, [(1, None), (2, ""), (3, long), (None, "a")])).collect()}
    assert rows == {1: (0, 0, False), 2: (0, 0, False), 3: (25000, 5000, True), None: (1, 1, False)}


def test_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(word_bpe, "CACHE", 5)
    monkeypatch.setattr(word_bpe, "BATCH_CHARS", 20)
    texts = [f"some text {i} " * 3 for i in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in word_bpe.Encoder().encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_pieces_are_bounded_in_size(monkeypatch, library):
    monkeypatch.setattr(word_bpe, "CACHE_SIZE", 50)
    monkeypatch.setattr(word_bpe, "BATCH_CHARS", 20)
    texts = [f"some text {i} " * 3 for i in range(30)]
    made = word_bpe.Encoder()
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(made.cache) < 10


def test_no_rows_repeated_rows_and_other_columns(spark):
    rows = documents(spark, [(1, "the cat"), (1, "the cat"), (2, None)])
    wide = rows.withColumn("n_tokens", F.lit("x")).withColumn("over_limit", F.lit("y"))
    got = sorted(map(tuple, word_bpe.count_tokens(wide).collect()))
    assert got == [(1, 7, 2, False), (1, 7, 2, False), (2, 0, 0, False)]
    assert word_bpe.count_tokens(rows.limit(0)).collect() == []


def test_packing(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = packing.op9_packing(spark, DATA).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d in docs.collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 2048))
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + 2048], "<u4")
            assert (p["length"], p["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= 1.03 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_odd_rows_and_parts(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (3, "word " * 5000)] + [(i, "x " * (i % 90)) for i in range(10, 300)]
    for per_part in (20, 10**6):
        got = packing.pack_documents(documents(spark, rows), per_part=per_part).collect()
        assert sum(r["length"] for r in got) == 3 + 2 + 5001 + sum(i % 90 + 1 for i in range(10, 300))
        places = {}
        for r in got:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for p in places.values():
            assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()]
    assert packing.pack_documents(documents(spark, rows).limit(0)).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.add(n) for n in (6, 3, 4)] == [(0, 0), (0, 6), (1, 0)]
    assert p.add(7) == (2, 0)  # bin 0, with 1 left, closed
    assert p.add(3) == (2, 7) and p.add(6) == (1, 4)
    rng = random.Random(1)
    plain, bins = packing.BestFit(50, 10**9), []
    for _ in range(2000):
        n = rng.randint(1, 50)
        fits = [i for i, used in enumerate(bins) if used + n <= 50]
        seq, offset = plain.add(n)
        if fits:
            assert 50 - bins[seq] == min(50 - bins[i] for i in fits) and offset == bins[seq]
            bins[seq] += n
        else:
            assert seq == len(bins)
            bins.append(n)


@pytest.fixture(scope="module")
def model():
    return unigram.Unigram(unigram.Pieces.read(public_tokenizers.path(unigram.MODEL)))


@pytest.fixture(scope="module")
def as_unigram():
    """The library on the same pieces with the unigram model."""
    with open(public_tokenizers.path(unigram.MODEL), "rb") as f:
        data = f.read()
    spec = next(v for n, v in unigram._fields(data) if n == 2)
    return sentencepiece.SentencePieceProcessor(model_proto=data.replace(spec, spec.replace(b"\x18\x02", b"\x18\x01", 1), 1))


def best_score(model, text):
    """Plain dynamic programming over all pieces."""
    data = ("▁" + text.replace(" ", "▁")) if text else ""
    pieces = {t: s for t, s, k in zip(model.pieces.text, model.score, model.pieces.kind) if k in (1, 4)}
    best = [0.0] + [float("-inf")] * len(data)
    for end in range(1, len(data) + 1):
        for start in range(max(0, end - 48), end):
            s = pieces.get(data[start:end], model.unknown_score if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def score_of(model, ids):
    total, run = 0.0, 0
    raw = bytearray()
    for i in ids:
        if i in model.byte_of:
            raw.append(model.byte_of[i])
        else:
            total += model.score[i]
    run = len(bytes(raw).decode("utf-8"))
    return total + run * model.unknown_score


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["the", "ing ", "abc", "  ", "\n", "中", "😀", "ß", "é", "qu", "\0"]), max_size=12).map("".join)))
def test_viterbi_is_optimal_and_round_trips(model, text):
    text = text.encode("utf-8", "ignore").decode().replace("▁", "_")
    ids = model.encode(text)
    assert score_of(model, ids) == pytest.approx(best_score(model, text), rel=1e-12)
    assert model.decode(ids) == text == next(model.encode_batch([text]))[1]


def test_first_of_the_library_n_best(model, as_unigram):
    for w in ("the", "Erthen", "entechein", "a the", "hello world", "x" * 20, "Étreré", "中文 ok"):
        assert model.encode(w) == as_unigram.nbest_encode_as_ids(w, 2)[0]
        assert model.decode(model.encode(w)) == as_unigram.decode(model.encode(w))


def test_long_chunks_agree(model):
    rng = random.Random(3)
    for n in (1, 50, 159, 160, 161, 400):
        text = "".join(rng.choice("abcthe中é") for _ in range(n))
        data = ("▁" + text).encode()
        assert model._long(data).tolist() == model._together([data])[0].tolist()


def test_long_chunks_settle_piece_by_piece(model, monkeypatch):
    rng = random.Random(5)
    for alphabet in ("abcthe中é", "a", "the", "😀x", "Ωж"):
        data = ("▁" + "".join(rng.choice(alphabet) for _ in range(3000))).encode()
        want = model._long(data).tolist()
        for places in (1, 7, 64, 500):
            monkeypatch.setattr(unigram, "SETTLE", places)
            assert model._long(data).tolist() == want
        monkeypatch.undo()


def test_long_chunks_take_little_memory(model):
    import tracemalloc

    data = ("▁" + "abcthe" * 100_000).encode()
    model._long(data[:1000])
    tracemalloc.start()
    ids = model._long(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 100_000 and peak < 30 * len(data)


def test_remembered_chunks_are_bounded_in_size(model, monkeypatch):
    monkeypatch.setattr(unigram, "CACHE_SIZE", 50)
    monkeypatch.setattr(unigram, "BATCH_CHARS", 20)
    texts = [f"some text {i} " * 3 for i in range(30)]
    fresh = unigram.Unigram(model.pieces)
    assert [a for a, _ in fresh.encode_batch(texts)] == [a for a, _ in model.encode_batch(texts)] and len(fresh.cache) < 10


def test_bad_bytes_decode(model):
    e4 = int(model.byte_id[0xE4])
    assert model.decode([e4]) == "�" and model.decode([int(model.byte_id[b]) for b in "中".encode()]) == "中"


def test_sentencepiece_documents(spark, model):
    got = unigram.op10_sentencepiece(spark, DATA).collect()
    assert all(r["round_trip"] for r in got) and all((r["n_pieces"] > 0) == (r["n_bytes"] > 0) for r in got)
    rows = {r["doc_id"]: r for r in unigram.encode_documents(documents(spark, [(1, None), (2, ""), (3, "a▁b"), (4, "the " * 3000)]), model).collect()}
    assert rows[1]["n_pieces"] == rows[2]["n_pieces"] == 0 and not rows[3]["round_trip"] and rows[4]["round_trip"]
