import numpy as np

from veldrin.operators import nearest


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PACK", 40)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(f"v{i}", [float(x) for x in rng.integers(-3, 4, 6 if i % 10 else 4)]) for i in range(400)] + [("zero", [0.0] * 6), ("null", None), ("hole", [1.0, None])]
    asked = [r for r in rows if r[0].endswith("5") or r[0] in ("zero", "null")]

    def unit(v):
        return np.array(v) / (np.linalg.norm(v) or 1)

    want = []
    for q, w in asked:
        if w is not None:
            scored = sorted((-round(float(unit(v) @ unit(w)), 9) + 0.0, i) for i, v in rows if v is not None and None not in v and len(v) == len(w))[:5]
            want += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(scored)]
    df, queries = (spark.createDataFrame(x, "id string, v array<double>").repartition(3) for x in (rows, asked))
    for most in (1 << 20, 0):
        monkeypatch.setattr(nearest, "SENT", most)
        got = [(r.query_id, r.id, r.score + 0.0, r["rank"]) for r in nearest.cosine_topk(df, queries, "id", "v", "id", "v", 5).collect()]
        assert sorted(got) == sorted(want) and len(got) > 150
    assert nearest.cosine_topk(df.limit(0), queries, "id", "v", "id", "v", 5).count() == nearest.cosine_topk(df, queries.limit(0), "id", "v", "id", "v", 5).count() == 0
