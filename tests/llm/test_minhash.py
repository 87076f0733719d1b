"""Near duplicates against brute force; the linking of hot groups."""

import random
import re

import numpy as np
import pytest

from veldrin.llm import common, minhash


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else set(zip(*[w[i:] for i in range(k)])) if w else set()


def brute(rows, k):
    s = {i: sets_of(t, k) for i, t in rows}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i), top(i) == i) for i in ids}


def family(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", " x", "a\x1cb"]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 40, 120]))] for _ in range(14)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases[: 4 if i % 3 else 14]))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, rng.choice([" ", " \n", "\x0b"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t")]


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k):
    rows = family(k, 260)
    want = brute(rows, k)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words=k).collect()}
    assert got == want and sum(not w[2] for w in want.values()) > 40


def test_both_ends_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    b = np.sort(np.concatenate([a[:240], rng.integers(0, 1 << 63, 60).astype(np.uint64)]))
    same = (lambda s: s[:, 0] == s[:, 1])(minhash.signatures([a, b]))
    j = 240 / 360
    assert abs(same[::2].mean() - j) < 0.12 and abs(same[1::2].mean() - j) < 0.12


def test_nulls_ties_and_empty(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "A b c"), (9, "z")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect())
    assert got == [("1", 1, True), ("3", 1, False), ("3", 1, False), ("9", 9, True), ("None", None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=50)


@pytest.mark.parametrize("sent", [0, 1 << 16])
def test_components(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "BROADCAST_EDGES", sent)
    edges = [(i, i + 1) for i in range(50)] + [(100, 60 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {60 + i: 60 for i in range(30)} | {100: 60}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sent", [0, 1 << 16])
def test_random_components_by_union_find(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "BROADCAST_EDGES", sent)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 1000 + i) for i in range(50)]
    up = {i: i for e in edges if e[0] != e[1] for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}
