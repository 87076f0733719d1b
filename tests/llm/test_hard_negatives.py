"""Hard negatives against brute force and SQL."""

import math

import duckdb
import numpy as np

from veldrin.llm import hard_negatives as hn
from veldrin.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, block string, id string, `a.b` int"


def brute(rows):
    used = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(256 * x) for x in v)]
    anchors = {(i, lab, tuple(v)): (i, v, lab) for i, v, lab in used if i % 50 == 0}
    out = []
    for i, v, lab in anchors.values():
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, w, m in used if j != i and len(w) == len(v)]
        pos = sorted((-s, j) for s, j, m in scored if m == lab)[:5]
        for s, p in pos:
            s = -s
            neg = sorted((-t, j) for t, j, m in scored if m != lab and 50 * s <= 100 * t <= 95 * s)[:3]
            out += [(i, p, k + 1, j, hn._long(s), hn._long(-t)) for k, (t, j) in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "b", "i", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hn.mine(df).collect())


def rows_of(seed, n, dim=12, scale=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dim))
    return [(int(i) * 5, [float(np.float32(x)) for x in (base[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.3, 1.0])) * scale], int(rng.integers(4))) for i in range(n)]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 64)
    monkeypatch.setattr(hn, "ANCHORS", 8)
    monkeypatch.setattr(hn, "HELD", 2)
    rows = rows_of(1, 600)
    want = brute(rows)
    assert len(want) > 300 and mined(spark, rows) == want
    monkeypatch.setattr(hn, "SENT", 0)  # blocks of anchors shuffled, not broadcast
    assert mined(spark, rows) == want


def test_ties_nulls_repeats_and_lengths(spark):
    v, w = [0.5] * 6, [0.25, 0.5, 0.5, 0.25, 0.5, 0.25]
    rows = [(i, v, i % 2) for i in range(0, 120)] + [(200 + i, w, i % 3) for i in range(60)]
    rows += [(50, v, 0), (50, w, 1), (7, v, 1), (150, v[:3], 0), (151, v[:3], 0), (152, w[:3], 1), (250, [], 1), (251, [], 1), (252, [], 0)]
    rows += [(None, v, 1), (300, None, 1), (350, v, None), (400, [0.1, None], 0), (450, [float("nan")] * 6, 0), (500, [float("inf")] * 6, 0), (550, [-x for x in v], 0), (551, v, 0)]
    assert mined(spark, rows) == brute(rows) != []


def test_huge_and_negative_components(spark):
    rows = rows_of(3, 60, 5, 1e9) + [(1000 + 50 * i, [x * 1e30 for x in v], lab) for i, (_, v, lab) in enumerate(rows_of(4, 20, 5))] + [(2000 + i, [1.7e308 if i == 2 else 6e305] * 5, i % 2) for i in range(6)] + rows_of(5, 40, 5, 1e-4)
    assert mined(spark, rows) == brute(rows) != []


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = db.execute(queries.SQL["op13_hard_negatives"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf).select(*names).collect()) == want != []


def test_intervals_hold(monkeypatch):
    rng = np.random.default_rng(0)
    r, a = rng.integers(-300, 300, (200, 9)), rng.integers(-300, 300, (30, 9))
    exact = r @ a.T
    low, high = np.full(30, 50_000), np.full(30, 200_000)
    for allowed in (np.ones((200, 30), bool), rng.random((200, 30)) < 0.5, np.zeros((200, 30), bool)):
        x, y, s = hn.surviving(r, a, allowed, low, high)
        want = {(i, j, exact[i, j]) for i, j in zip(*np.nonzero(allowed & (exact >= 50_000) & (exact <= 200_000)), strict=True)}
        assert set(zip(x, y, s, strict=True)) == want
        x, y, s = hn.surviving(r, a, allowed, np.full(30, -(10**9)), best=4)
        for j in range(30):
            top = sorted(exact[allowed[:, j], j])[-4:]
            assert sorted(s[y == j])[-4:] == top
