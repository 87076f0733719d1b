"""Vector near duplicates against brute force; recall is counted over all links."""

import numpy as np

from veldrin.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def brute(rows):
    ok = {}
    for i, v, label, _ in rows:
        if v is not None and label is not None and len(v) and None not in v:
            x = np.array(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ok[i] = (x / np.linalg.norm(x), label)
    n, up = dict.fromkeys([r[0] for r in rows], 0), {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= ed.COSINE:
                n[a] += 1
                n[b] += 1
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], top(i)) for i in n}


def make(seed, n=260, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 0.4, 2.0])
        rows.append((i * 3, [float(np.float32(x)) for x in v * rng.choice([1, 1e-3, 50])], int(rng.integers(3)), "r"))
    rows += [(1, None, 1, None), (2, [0.0] * dim, 1, None), (4, [1.0, None], 1, None), (5, [float("nan")] * dim, 0, None), (7, rows[0][1], None, None), (8, [], 1, None), (10, rows[0][1][:5], rows[0][2], None), (11, rows[0][1], rows[0][2], None)]
    return rows


def test_links_match_brute_force(spark, monkeypatch):
    rows = make(3)
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and sum(w[0] for w in want.values()) > 100


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    rng = np.random.default_rng(1)
    v = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in v + rng.normal(size=16) * 0.02 * (i % 3)], 1, None) for i in range(200)]
    got = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 200 and all(r.n_links == 199 and r.component_id == 0 and r.kept == (r.vec_id == 0) for r in got)


def test_nulls_and_empty(spark):
    rows = [(None, [1.0, 2.0], 1, None), (3, [1.0, 2.0], 1, None), (2, [1.0, 2.0], 1, None)]
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None].n_links == 0 and got[None].component_id is None and got[3].n_links == 1 and got[3].component_id == 2 and not got[3].kept
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(2)
    v, w = [1.0] * 16, [1.0] * 15 + [1.2]
    far = [[float(x) for x in rng.normal(size=16)] for _ in range(50)]
    rows = [(i, v, 1, None) for i in range(20_000)] + [(20_000 + i, w, 1, None) for i in range(3)] + [(30_000 + i, f, 1, None) for i, f in enumerate(far)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8).selectExpr("*", "1 as n", "2 as no", "3 as unit", "4 as rep", "5 as key", "6 as `vec.id`", "7 as id")
    got = {r.vec_id: r for r in ed.near_duplicates(df).collect()}
    assert len(got) == 20_053 and all(got[i].n_links == 20_002 and got[i].component_id == 0 for i in range(20_003))
    want = brute(rows[20_003:])
    assert all((got[i].n_links, got[i].component_id) == want[i] for i in want)


def test_repeated_ids_and_long_vectors(spark):
    rng = np.random.default_rng(5)
    a, b = ([float(x) for x in rng.normal(size=3000)] for _ in range(2))
    rows = [(5, a, 1, None), (5, b, 1, None), (9, b, 1, None), (7, a, 1, None), (8, [2 * x for x in a], 1, None), (6, a, 2, None)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (6, 0, 6), (7, 2, 5), (8, 2, 5), (9, 1, 5)]


def test_tables_keep_the_recall():
    for n in (1, 1000, 10**6, 10**9):
        bits, tables = ed.plan(n)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= ed.MISSED * 1.01 and 2**bits > min(n, 2**29)
