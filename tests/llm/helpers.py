import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(3000)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, k=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def prose(n, rng=random):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(ws, k, rng=random):
    ws = list(ws)
    for _ in range(k):
        i, o = rng.randrange(len(ws)), rng.random()
        if o < 0.5:
            ws[i] = rng.choice(VOCABULARY)
        elif o < 0.75:
            ws.insert(i, rng.choice(VOCABULARY))
        elif len(ws) > 1:
            del ws[i]
    return ws


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark, rows, parts=4):
    """rows of (doc_id, text), with columns that clash with the operators' own names."""
    made = [(i, t, "en", "s", len(t or ""), "x", 1, b"y") for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, sketch binary").repartition(parts)
