"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from veldrin.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, `a.b` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 3 and len(w) >= 5}
    # all words that one deletion makes, so near words share one or the longer one makes the shorter
    made = defaultdict(set)
    for w in n:
        made[w].add(w)
        for k in range(len(w)):
            made[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in made.values():
        for a in group:
            for b in group:
                if a != b and (abs(len(a) - len(b)) == 1 or sum(x != y for x, y in zip(a, b, strict=False)) == 1) and distance_one(a, b):
                    near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x.encode()), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def distance_one(a, b):
    a, b = sorted((a, b), key=len)
    return any(a[:k] + b[k] + (a[k + 1 :] if len(a) == len(b) else a[k:]) == b for k in range(len(b)))


def got(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df).collect()), key=lambda r: r[0])


def corpus(seed, n_words=150, docs=400):
    rng = random.Random(seed)
    parts = ["th", "on", "ing", "er", "A", "é", "Ét", "a", "re"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(n_words)]
    rows = []
    for i in range(docs):
        ws = [base[min(int(rng.expovariate(0.01)), n_words - 1)] for _ in range(rng.randint(0, 200))]
        for k in range(len(ws)):
            if rng.random() < 0.2 and len(ws[k]) > 2:
                at = rng.randrange(len(ws[k]))
                ws[k] = rng.choice([ws[k][:at] + ws[k][at + 1 :], ws[k][:at] + "x" + ws[k][at:], ws[k][:at] + "o" + ws[k][at + 1 :]])
        rows.append((i, rng.choice([" ", ", ", "-1-"]).join(ws)))
    return rows


def test_brute_force(spark, monkeypatch):
    rows = corpus(1)
    want = brute(rows)
    assert sum(r[4] > 5 for r in want) > 20 and sum(r[1] is not None and r[2] != r[1] for r in want) > 5
    assert got(spark, rows) == want
    monkeypatch.setattr(spelling, "SHARD", 300)
    monkeypatch.setattr(spelling, "CHUNK", 500)
    assert got(spark, rows) == want


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    rows = [(1, None), (2, ""), (None, "alpha alpha Alpha alphq alphq alphq"), (3, "beta " * 5), (4, "tones " * 4 + "stone " * 4 + "stones " * 9), (4, "tones " * 4), (5, "Étage étage " * 3), (6, "q" * 100_000 + " "), (6, "q" * 100_000), (6, "q" * 100_000), (7, "one2three4 " * 3), (8, "aaaaa " * 3 + "aaaaaa " * 3 + "aaaaaaa " * 7)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_halves_find_each_pair_once():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 11))) for _ in range(1500)})
    halves = spelling.Halves(words)
    pairs = [(words[i], v) for v in words for i in halves.near(v)]
    assert len(pairs) == len(set(pairs)) > 1000
    at = set(words)
    want = {(u, v) for v in words for k in range(len(v) + 1) for c in "ab" for u in ([v[:k] + c + v[k:]] + ([v[:k] + c + v[k + 1 :]] if k < len(v) else [])) if u in at and u != v and (len(u) > len(v) or u > v)}
    assert set(pairs) == want
