import random

import numpy as np
import pytest
from helpers import documents, edited, prose, roots, shingles, words
from pyspark.sql import functions as F

from lexspan.llm import components as components_module
from lexspan.llm import jaccard_join, substring_dedup
from lexspan.llm._text import mix, shingle_set, word_hashes
from lexspan.llm.components import components


@pytest.mark.parametrize("local", [0, 10**6])
@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 400, (200, 2)) if a != b] + [(5, 5), (None, 3)]])
def test_components(spark, monkeypatch, edges, local):
    monkeypatch.setattr(components_module, "LOCAL_EDGES", local)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)


def test_word_hashes():
    rng = random.Random(1)
    text = "".join(rng.choice("aBcé \n\t\x0b ") for _ in range(200_000))
    found, start, end = word_hashes(text, spans=True)
    data = text.encode()
    assert [data[a:b].decode() for a, b in zip(start[:500], end[:500])] == [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)[:500]]
    assert len(found) == len(words(text)) and len(set(found.tolist())) == len(set(words(text)))
    assert len(word_hashes("x" * 200_000 + " y")) == 2 and len(word_hashes(None)) == len(word_hashes(" \n")) == 0


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                links.append((a, b))
    comp = roots(list(sets), links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def near_copies():
    rng = random.Random(3)
    rows = []
    for n in [*range(1, 40, 3), 60, 100, 200]:
        base = prose(n, rng)
        rows += [" ".join(edited(base, rng.randint(0, max(1, n // 22)), rng)) for _ in range(10)]
        walk = base
        for _ in range(6):
            walk = edited(walk, max(1, n // 40), rng)
            rows.append(" ".join(walk).upper())
    rows += [rows[50]] * 20 + [None, "", " \n\t"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_join(spark):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_tiles(spark, monkeypatch):
    """Members of a bucket spread over several tiles, and a hot group in one map task."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = random.Random(9)
    base = prose(120, rng)
    rows = [(i, " ".join(edited(base, rng.randint(0, 9), rng))) for i in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(documents(spark, rows, 2)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_odd_rows(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b  c d e\nf"), (3, None)])
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("3", 0, 3), ("None", 2, 1)]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, d = int(rng.integers(1, 400)), int(rng.integers(0, 40))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[d:], rng.integers(0, 2**63, int(rng.integers(1, 40)), dtype=np.uint64))))
        assert jaccard_join.sketch_distance(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n", [20, 46, 90, 300])
def test_compact_windows_stand_for_all_subsequences(n):
    tokens, width = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64), 20
    seed = np.uint64(77)
    _, place, first, last = substring_dedup.compact_windows(tokens, seed, width)
    value = mix(tokens ^ seed)
    for a in range(n - width + 1):
        for b in range(a + width - 1, n):
            at = np.flatnonzero(place == a + int(np.argmin(value[a : b + 1])))
            assert len(at) == 1 and first[at[0]] <= a and last[at[0]] >= b


def passages():
    rng = random.Random(2)
    shared = [prose(n, rng) for n in (50, 55, 80, 200)]
    rows, held = [], {}
    for i in range(120):
        parts, held[i] = [prose(rng.randint(5, 200), rng)], []
        for j in rng.sample(range(4), rng.randint(0, 2)):
            held[i].append(j)
            parts += [shared[j], prose(rng.randint(5, 200), rng)]
        rows.append((i, " ".join(sum(parts, []))))
    return rows, held, shared


def test_repeated_passages(spark):
    rows, held, shared = passages()
    found = {}
    for r in substring_dedup.repeated_passages(documents(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["start_word"] + r["n_words"], r["source_doc_id"]))
    seen = set()
    for i, text in rows:
        w = text.split()
        for j in held[i]:
            at = next(x for x in range(len(w)) if w[x : x + len(shared[j])] == shared[j])
            covered = any(s <= at + 2 and e >= at + len(shared[j]) - 2 for s, e, _ in found.get(i, []))
            assert covered == (j in seen), (i, j)
        if not any(j in seen for j in held[i]):
            assert i not in found
        seen |= set(held[i])


def test_near_passage_and_copies(spark):
    rng = random.Random(5)
    p = prose(120, rng)
    q = list(p)
    q[60] = "changed"
    rows = [(1, " ".join(prose(40, rng) + p + prose(40, rng))), (2, " ".join(prose(30, rng) + q + prose(90, rng))), (3, " ".join(p)), (4, " ".join(p)), (4, " ".join(p)), (5, " ".join(p[:30])), (6, None), (7, ""), (None, " ".join(p)), (8, "same " * 500)]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(documents(spark, rows)).orderBy(F.desc("source_doc_id")).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2]["source_doc_id"] == 1 and abs(got[2]["start_word"] - 30) <= 2 and abs(got[2]["n_words"] - 120) <= 4 and 0.8 <= got[2]["similarity"] < 1
    assert substring_dedup.repeated_passages(documents(spark, rows).limit(0)).count() == 0


def test_shingle_set_sizes():
    for text in ("", "a", "a b c d", "a b c d e", "A a a a a a a", None, "é ü \xa0x y z"):
        assert len(shingle_set(text)) == len(shingles(text))


def spans_of(spark, rows):
    out = {}
    for r in substring_dedup.repeated_passages(documents(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append((r["start_word"], r["start_word"] + r["n_words"], r["source_doc_id"]))
    return out


def covers(spans, start, end):
    """Whether the words from start to end lie in spans, but for two at each border."""
    held = {i for s, e, _ in spans for i in range(s, e)}
    return held >= set(range(start + 2, end - 2))


def test_passages_at_several_shifts(spark):
    """A middle section that is missing, and two passages in the other order and far apart."""
    rng = random.Random(11)
    p, q, r = prose(350, rng), prose(300, rng), prose(350, rng)
    u, v = prose(60, rng), prose(60, rng)
    rows = [(1, " ".join(p + q + r)), (2, " ".join(p + r)), (3, " ".join(u + prose(300, rng) + v)), (4, " ".join(prose(80, rng) + v + prose(3, rng) + u + prose(80, rng)))]
    got = spans_of(spark, rows)
    assert set(got) == {2, 4}
    assert covers(got[2], 0, 350) and covers(got[2], 350, 700)
    assert covers(got[4], 80, 140) and covers(got[4], 143, 203)


def test_smallest_copy_is_a_source(spark):
    """A task that meets a copy before the document of the smallest id."""
    rng = random.Random(12)
    p = prose(80, rng)
    text = " ".join(prose(40, rng) + p + prose(40, rng))
    rows = spark.createDataFrame([(12, text), (11, " ".join(prose(60, rng) + p + prose(60, rng))), (10, text)], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["source_doc_id"]): (r["start_word"], r["n_words"]) for r in substring_dedup.repeated_passages(rows).collect()}
    assert got[12, 10] == (0, 160)
    assert abs(got[11, 10][0] - 60) <= 2 and abs(got[11, 10][1] - 80) <= 4


@pytest.mark.parametrize("tile", [8, 4096])
def test_repeats_behind_holders_of_the_min_hash(spark, monkeypatch, tile):
    """Smaller documents hold pieces of the passage, too short to count, and so take its buckets."""
    monkeypatch.setattr(substring_dedup, "TILE", tile)
    rng = random.Random(13)
    p = prose(60, rng)
    rows = [(i, " ".join(prose(60, rng) + p[x : x + 20] + prose(60, rng))) for i, x in enumerate([*range(0, 41, 2)] * 2)]
    rows += [(i, " ".join(prose(60, rng) + p + prose(60, rng))) for i in (100, 101, 102)]
    got = spans_of(spark, rows)
    assert set(got) == {101, 102}
    assert covers(got[101], 60, 120) and covers(got[102], 60, 120)


def test_exact_passages_behind_their_parts(spark):
    """60 times: documents 5 and 9 share 52 words, of which 1 and 2 hold the first and the last 29."""
    rng = random.Random(14)
    rows, at = [], {}
    for g in range(60):
        p = prose(52, rng)
        for i, part in ((1, p[:29]), (2, p[-29:]), (5, p), (9, p)):
            before = prose(rng.randint(5, 80), rng)
            rows.append((10 * g + i, " ".join(before + part + prose(rng.randint(5, 80), rng))))
            at[10 * g + i] = len(before)
    got = spans_of(spark, rows)
    assert set(got) == {10 * g + 9 for g in range(60)}
    assert all(covers(got[i], at[i], at[i] + 52) for i in got)


def test_the_same_passages_in_another_order(spark):
    rng = random.Random(15)
    p, q = prose(60, rng), prose(60, rng)
    rows = [(1, " ".join(p)), (2, " ".join(p + q)), (3, " ".join(q + p)), (4, " ".join(p + p)), (5, " ".join(prose(9, rng) + q))]
    got = spans_of(spark, rows)
    assert set(got) == {2, 3, 4, 5}
    assert covers(got[2], 0, 60) and covers(got[3], 0, 60) and covers(got[3], 60, 120) and covers(got[4], 0, 60) and covers(got[4], 60, 120) and covers(got[5], 9, 69)


def random_corpus(rng, near):
    """Documents of prose with passages, parts of passages, passages inside passages and changed ones."""
    shared = [prose(n, rng) for n in (50, 53, 60, 75, 120, 200)]
    shared += [shared[5][20:75], shared[4][30:] + shared[3], shared[0] + prose(2, rng) + shared[1]]
    rows = []
    for i in range(140):
        parts = [prose(rng.randint(0, 90), rng)]
        for p in rng.sample(shared, rng.randint(0, 3)):
            if rng.random() < 0.4:
                lo = rng.randint(0, len(p) - 20)
                p = p[lo : lo + rng.randint(20, 120)]
            parts += [edited(p, rng.randint(0, len(p) // 50), rng) if near else p, prose(rng.randint(0, 60), rng)]
        rows.append((i, " ".join(sum(parts, []))))
    return rows


def brute_passages(rows):
    """For each document the starts of its 46 shingles that an earlier document repeats exactly, and at similarity 0.8 or more."""
    ids, exact, near = {}, {}, {}
    tokens = {}
    for i, text in rows:
        w = words(text)
        tokens[i] = np.array([ids.setdefault(tuple(w[k : k + 5]), len(ids)) for k in range(len(w) - 4)], np.int64)
    for i, b in tokens.items():
        exact[i], near[i] = set(), set()
        for j, a in tokens.items():
            if j >= i or len(a) < 46 or len(b) < 46:
                continue
            place = {t: k for k, t in enumerate(a.tolist())}
            shifts = {place[t] - k for k, t in enumerate(b.tolist()) if t in place}
            for shift in shifts:
                for s in range(max(0, -shift), min(len(b), len(a) - shift) - 45):
                    x, y = a[s + shift : s + shift + 46], b[s : s + 46]
                    if x[45] != y[45] and x[0] != y[0] and x[23] != y[23]:
                        continue
                    both = len(np.intersect1d(x, y))
                    if both == 46:
                        exact[i].add(s)
                    if both >= 0.8 * (92 - both):
                        near[i].add(s)
    return exact, near


@pytest.mark.parametrize("near", [False, True])
def test_passages_against_brute_force(spark, near):
    rows = random_corpus(random.Random(16), near)
    got = spans_of(spark, rows)
    exact, similar = brute_passages(rows)
    held = {i: {k for a, b, _ in spans for k in range(a, b)} for i, spans in got.items()}
    assert sum(map(len, exact.values())) > 1000
    lost = [(i, s) for i in exact for s in exact[i] if not held.get(i, set()) >= set(range(s, s + 50))]
    assert not lost, lost
    wide = [(i, s) for i in similar for s in similar[i]]
    recall = sum(held.get(i, set()) >= set(range(s + 5, s + 45)) for i, s in wide) / len(wide)
    assert recall >= 0.97, recall
    assert all(similar[i] for i in got)  # no document without a repeat is reported
    shuffled = random.Random(17).sample(rows, len(rows))
    assert held == {i: {k for a, b, _ in spans for k in range(a, b)} for i, spans in spans_of(spark, shuffled).items()}


def test_tile_links_without_common_tokens():
    tokens = np.arange(3 * 81, dtype=np.uint32).reshape(3, 81)
    x, y = substring_dedup.tile_links(np.zeros(3, np.int64), np.arange(3), tokens, np.ones((3, 81), bool), 46)
    assert len(x) == len(y) == 0
    tokens[2] = tokens[0]
    tokens[2, 60] = 7777
    x, y = substring_dedup.tile_links(np.zeros(3, np.int64), np.arange(3), tokens, np.ones((3, 81), bool), 46)
    assert (x.tolist(), y.tolist()) == ([0], [2])
